"""What callers see: hydrated contexts, counts, receipts, token usage, ledgers and affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.scoring import clamp
from cairnlake.operators import graph
from cairnlake.operators.reports import meta


def hydrated(beliefs: DataFrame, recalled: DataFrame, k: int, k_beliefs: int = 3) -> DataFrame:
    """(id, score, origin): the best beliefs, then what was recalled, each id once, up
    to ``k``. Both are (id, score)."""
    first = beliefs.orderBy(F.desc("score"), "id").limit(k_beliefs).withColumn("origin", F.lit("belief"))
    both = first.unionByName(recalled.withColumn("origin", F.lit("recall")))
    best = both.groupBy("id").agg(F.min(F.struct((F.col("origin") != "belief").alias("o"), (-F.col("score")).alias("s"), "origin")).alias("m"))
    return best.orderBy("m.o", "m.s", "id").limit(k).select("id", (-F.col("m.s")).alias("score"), "m.origin")


def hydrated_each(neighbours: DataFrame, memories: DataFrame) -> DataFrame:
    """The neighbours (query_id, id, similarity, rank) of many queries with their rows."""
    return neighbours.join(memories, "id")


def activity(rows: DataFrame, key: str, ts: str, as_of: Column, seconds: int = 3600) -> DataFrame:
    """(key, n, active, last_at): rows per key, and those of the last hour."""
    lately = (F.unix_micros(ts) > F.unix_micros(as_of) - seconds * 1_000_000) & (F.col(ts) <= as_of)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(lately).alias("active"), F.max(ts).alias("last_at"))


def receipts(turns: DataFrame, column: str, kind: str, *keep: str) -> DataFrame:
    """A row per item of the JSON list ``receipts`` of each call of a JSON list of calls
    (name, receipts: [{kind, ref}]) whose kind is wanted."""
    schema = "array<struct<name:string,receipts:array<struct<kind:string,ref:string>>>>"
    calls = turns.select(*keep, F.explode(F.from_json(column, schema)).alias("c"))
    return calls.select(*keep, F.col("c.name").alias("tool"), F.explode("c.receipts").alias("r")).filter(F.col("r.kind") == kind).select(*keep, "tool", "r.ref")


def token_usage(answers: DataFrame, column: str, *keep: str) -> DataFrame:
    """Token counts of provider answers (JSON), under whichever of the common names they stand."""
    first = lambda *paths: F.coalesce(*[meta(p, "long", column) for p in paths], F.lit(0))
    return answers.select(
        *keep, first("usage.input_tokens", "usage.prompt_tokens").alias("input_tokens"), first("usage.output_tokens", "usage.completion_tokens").alias("output_tokens"),
        first("usage.cache_read_input_tokens", "usage.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
    )


def distinct_recent(rows: DataFrame, key: str, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """The different values of the last hours."""
    return rows.filter((F.unix_micros(ts) > F.unix_micros(as_of) - hours * 3_600_000_000) & (F.col(ts) <= as_of)).select(key).distinct()


def attributed(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Search hits (doc_id, score) with source and length of their document."""
    return hits.join(documents.select("doc_id", "source", F.length("text").alias("n_chars")), "doc_id")


def nested_stats(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, stats): a JSON object of counts by ``inner``, keys in order."""
    counted = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counted.groupBy(outer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string"), "n"))))).alias("stats"))


def deduped_references(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, key, ref, observed_at) of a JSON list of sources, one per key (ref, else
    label, else a digest of both), the latest observed; empty sources are left out."""
    schema = "array<struct<ref:string,label:string,observed_at:string>>"
    each = rows.select(*keep, F.explode(F.from_json(column, schema)).alias("s"))
    given = lambda c: F.nullif(F.col(f"s.{c}"), F.lit(""))
    each = each.filter(F.coalesce(given("ref"), given("label"), given("observed_at")).isNotNull())
    key = F.coalesce(given("ref"), given("label"), F.md5(F.to_json("s").cast("binary")))
    each = each.select(*keep, key.alias("key"), F.col("s.ref").alias("ref"), F.coalesce("s.observed_at", F.lit("")).alias("observed_at"))
    w = W.partitionBy(*keep, "key").orderBy(F.desc("observed_at"), F.col("ref").asc_nulls_last())
    return each.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def affect(states: DataFrame, column: str, *keep: str, rest_valence: float = 0.0, rest_arousal: float = 0.3) -> DataFrame:
    """Typed and clamped affect of JSON states; what is missing or no number is at rest."""
    of = lambda path, otherwise, low=0.0, high=1.0: clamp(F.coalesce(meta(path, "double", column), F.lit(otherwise)), low, high).alias(path)
    return states.select(*keep, of("valence", rest_valence, -1.0), of("arousal", rest_arousal), of("dominance", 0.5), of("intensity", 0.5), F.coalesce(F.nullif(meta("primary_emotion", "string", column), F.lit("")), F.lit("neutral")).alias("primary_emotion"))


def learned_triggers(held: DataFrame, met: DataFrame) -> DataFrame:
    """Triggers (id, delta, times, confidence) after responses (id, delta) met the nearest
    of them: a running mean, one more time, a little surer up to 0.95. Responses
    without a trigger near enough (null id) start new ones, which are not listed."""
    told = met.filter("id is not null").groupBy("id").agg(F.sum("delta").alias("_d"), F.count("*").alias("_n"))
    out = held.join(told, "id", "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_d": F.coalesce("_d", F.lit(0.0))})
    mean = F.try_divide(F.col("delta") * F.col("times") + F.col("_d"), F.col("times") + F.col("_n"))
    sure = F.when(F.col("_n") > 0, F.greatest(F.col("confidence"), F.least(F.lit(0.95), F.col("confidence") + 0.02 * F.col("_n")))).otherwise(F.col("confidence"))
    return out.select("id", F.coalesce(mean, F.col("delta")).alias("delta"), (F.col("times") + F.col("_n")).alias("times"), sure.alias("confidence"))


def spiked(memories: DataFrame, surprise: float, as_of: Column, minutes: int = 30, most: int = 50) -> DataFrame:
    """(id, boost, importance) of the latest memories after a reward surprise (-1 to 1)."""
    gain, weight = (surprise * 0.4, surprise * 0.12) if surprise > 0 else (surprise * 0.25, surprise * 0.05)
    some = memories.filter((F.col("status") == "active") & (F.unix_micros("created_at") >= F.unix_micros(as_of) - minutes * 60_000_000) & (F.col("created_at") <= as_of))
    some = some.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    boost = clamp(F.coalesce(meta("activation_boost", "double"), F.lit(0.0)) + gain)
    return some.select("id", boost.alias("boost"), clamp(F.col("importance") + weight, 0.1, 1.0).alias("importance"))


def spiked_tonic(tonic: Column, surprise: Column, alpha: float = 0.15) -> Column:
    """The slow level after a surprise: a moving mean; one half where there is none."""
    return clamp(F.coalesce(tonic, F.lit(0.5)) * (1 - alpha) + (0.5 + surprise * 0.5) * alpha)


def corrected(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, corrections, latest, invalid): the corrections (id, text, at, invalid) of each
    memory in order, the last of them, and whether any makes it a bad precedent."""
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    per = corrections.groupBy("id").agg(listed.alias("_c"), F.bool_or("invalid").alias("invalid"))
    out = memories.select("id").join(per, "id")
    texts = F.transform("_c", lambda x: x["text"])
    return out.select("id", F.array_join(texts, "; ").alias("corrections"), F.element_at(texts, -1).alias("latest"), "invalid")


def lifetime(memories: DataFrame, as_of: Column) -> DataFrame:
    """One row: when the first memory came (a first one of initialization, if any), the
    day of life, and the age in days."""
    born = F.coalesce(F.min(F.when((F.col("type") == "episodic") & (meta("type") == "initialization"), F.col("created_at"))), F.min("created_at"))
    age = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros("born")) / 86_400_000_000)).cast("long")
    return memories.agg(born.alias("born")).select("born", (F.date_diff(F.to_date(as_of), F.to_date("born")) + 1).alias("day_of_life"), age.alias("age_days"))


def context_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 10) -> DataFrame:
    """Up to ``most`` paths from each seed, the shortest and then the heaviest first."""
    found = graph.paths(edges, seeds, depth, most)
    steps = F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")
    w = W.partitionBy("seed").orderBy("depth", F.desc("weight"), "path")
    return found.select("seed", "node", "depth", "weight", steps).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def item_documents(items: DataFrame) -> DataFrame:
    """Source items (connection, item, content, sensitivity, at) as documents: one per
    connection and item, the latest, keyed by a digest of all three parts; private
    unless something else is said."""
    w = W.partitionBy("connection", "item").orderBy(F.desc("at"), F.desc("content"))
    latest = items.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    key = F.sha2(F.concat_ws("\x1e", F.col("connection").cast("string"), F.col("item").cast("string"), F.coalesce("content", F.lit(""))), 256)
    return latest.select("connection", "item", key.alias("content_hash"), F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("private")).alias("sensitivity"))


def ingestion_stats(metrics: DataFrame, since: Column, until: Column) -> DataFrame:
    """One row ``stats``: all of what came in since a time, as JSON, in one pass.

    ``metrics`` are (source_type, mode, created_at, word_count, extraction_count,
    memory_count, dedup_count, llm_calls, duration_seconds, valence, arousal,
    intensity). Grouping sets give the counts by source, by mode, and the totals;
    the rows of these few groups are then put into one object.
    """
    some = metrics.filter(F.col("created_at") >= since).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("source_type", "mode")})
    sums = {c: F.sum(c).alias(c) for c in ("word_count", "extraction_count", "memory_count", "dedup_count", "llm_calls", "duration_seconds")}
    means = {c: F.avg(c).alias(f"_{c}") for c in ("word_count", "extraction_count", "duration_seconds", "valence", "arousal", "intensity")}
    kind = F.grouping_id().alias("_kind")
    sets = some.groupingSets([[F.col("source_type")], [F.col("mode")], []], "source_type", "mode")
    found = sets.agg(kind, F.count("*").alias("n"), *sums.values(), *means.values())
    r = lambda c: F.round(F.col(c), 6)
    by_source = F.struct(F.col("n").alias("count"), r("_word_count").alias("avg_words"), r("_extraction_count").alias("avg_extractions"), r("_duration_seconds").alias("avg_duration"))
    totals = F.struct(
        F.col("word_count").alias("total_words"), F.col("extraction_count").alias("total_extractions"), F.col("memory_count").alias("total_memories"), F.col("llm_calls").alias("total_llm_calls"),
        r("duration_seconds").alias("total_duration_seconds"), r("_valence").alias("avg_valence"), r("_arousal").alias("avg_arousal"), r("_intensity").alias("avg_intensity"),
    )
    rate = F.when(F.col("extraction_count") > 0, r("_rate")).otherwise(F.lit(0.0))
    found = found.withColumn("_rate", F.try_divide(F.col("dedup_count").cast("double"), F.col("extraction_count").cast("double")))
    dedup = F.struct(F.col("dedup_count").alias("total_deduped"), rate.alias("dedup_rate"))
    pairs = lambda level, key, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_kind") == level, F.struct(F.col(key).alias("k"), value.alias("v"))))))
    whole = lambda value: F.max(F.when(F.col("_kind") == 3, value))
    out = found.agg(
        F.coalesce(whole(F.col("n")), F.lit(0)).alias("total_ingestions"), pairs(1, "source_type", by_source).alias("by_source_type"), pairs(2, "mode", F.col("n")).alias("by_mode"),
        whole(totals).alias("totals"), whole(dedup).alias("dedup_stats"),
    )
    told = F.struct(since.cast("string").alias("period_start"), until.cast("string").alias("period_end"), *out.columns)
    return out.select(F.to_json(told).alias("stats"))


def carryover(turns: DataFrame, as_of: Column, most: int = 8, window_minutes: int = 1440, max_chars: int = 5000, line_chars: int = 700) -> DataFrame:
    """(session, turns, chars, body): for each session its latest turns within the window,
    up to ``most`` and as many as fit ``max_chars`` when counted from the end, in order.

    ``turns`` are (session, turn, role, text, at). A line is the role and the text with
    blanks squeezed, cut to ``line_chars``. The last turn stays in any case, cut to the
    budget; sessions without a turn in the window have no row.
    """
    bare = F.btrim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     "), " +", " "))
    line = F.concat(F.col("role"), F.lit(": "), F.left(bare, F.lit(line_chars)))
    inside = F.col("at").isNull() | (F.unix_micros("at") >= F.unix_micros(as_of) - window_minutes * 60_000_000)
    some = turns.filter(inside).select("session", "turn", line.alias("line"))
    from_end = W.partitionBy("session").orderBy(F.desc("turn"))
    late = some.withColumn("_r", F.row_number().over(from_end)).filter(F.col("_r") <= most)
    # A line break stands before every line but the last.
    used = F.sum(F.length("line") + F.when(F.col("_r") > 1, 1).otherwise(0)).over(from_end.rowsBetween(W.unboundedPreceding, 0))
    fits = late.withColumn("_used", used).filter((F.col("_used") <= max_chars) | (F.col("_r") == 1))
    out = fits.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]).alias("lines"))
    body = F.left(F.array_join("lines", "\n"), F.lit(max_chars))
    return out.select("session", F.size("lines").alias("turns"), F.length(body).alias("chars"), body.alias("body"))
