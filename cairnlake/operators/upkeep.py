"""What retention and clean-up keep, move or drop, as DataFrames; nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.scoring import age_in_days, felt_intensity
from cairnlake.operators.reports import meta


def expired(rows: DataFrame, ts: Column, as_of: Column, days: float) -> DataFrame:
    """Rows older than so many days; rows without a time stay."""
    return rows.filter(F.unix_micros(ts) < F.unix_micros(as_of) - int(days * 86_400_000_000))


def lapsed(rows: DataFrame, as_of: Column, least_importance: float = 0.75, least_accesses: int = 3) -> DataFrame:
    """Rows past their expiry, with ``promote``: whether they move to long-term memory
    (asked for, important or often used) instead of going."""
    promote = F.coalesce(F.col("promote"), F.lit(False)) | (F.coalesce("importance", F.lit(0.0)) >= least_importance) | (F.coalesce("access_count", F.lit(0)) >= least_accesses)
    return rows.filter(F.unix_micros("expiry") < F.unix_micros(as_of)).withColumn("promote", promote)


def protected(importance: float = 0.85, intensity: float = 0.75, valence: float = 0.7) -> Column:
    """Memories that no retention pass touches: beliefs, goals, what is important,
    intense, strongly felt, marked, or taken from a document."""
    return (
        F.col("type").isin("worldview", "goal") | (F.coalesce("importance", F.lit(0.0)) >= importance)
        | (F.coalesce(meta("emotional_context.intensity", "double"), F.lit(0.0)) >= intensity)
        | (F.abs(F.coalesce(meta("emotional_valence", "double"), F.lit(0.0))) >= valence)
        | F.coalesce(meta("protected", "boolean"), F.lit(False)) | F.col("content_hash").isNotNull()
    )


def borderline(as_of: Column, margin: float = 0.15) -> Column:
    """Active memories that are not protected but within a margin of it, so that
    someone should look before they are merged."""
    felt = felt_intensity(meta("emotional_context.intensity", "double"), meta("emotional_valence", "double"), F.col("created_at"), F.col("last_reinforced"), as_of)
    near = (F.coalesce("importance", F.lit(0.0)) >= 0.85 - margin) | (felt >= 0.75 - margin) | (F.abs(F.coalesce(meta("emotional_valence", "double"), F.lit(0.0))) >= 0.7 - margin)
    return (F.col("status") == "active") & ~protected() & near


def merged_groups(memories: DataFrame, group: str) -> DataFrame:
    """(group, ids, content, importance, valence, private) of groups of two or more
    active episodes that are not protected: texts in order of time, the greatest
    importance, the mean valence, and whether any is private."""
    some = memories.filter((F.col("status") == "active") & (F.col("type") == "episodic") & ~protected())
    listed = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    out = some.groupBy(group).agg(listed.alias("_m"), F.max("importance").alias("importance"), F.avg(meta("emotional_valence", "double")).alias("valence"), F.bool_or(F.coalesce(F.col("sensitivity") == "private", F.lit(False))).alias("private"))
    out = out.filter(F.size("_m") >= 2)
    ids, texts = F.transform("_m", lambda x: x["id"].cast("string")), F.transform("_m", lambda x: x["content"])
    return out.select(group, F.array_join(ids, ",").alias("ids"), F.array_join(texts, "\n\n---\n\n").alias("content"), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5))).alias("importance"), "valence", "private")


def stale_documents(memories: DataFrame, requests: DataFrame, as_of: Column, old_days: float = 180, idle_days: float = 90) -> DataFrame:
    """(content_hash, memory_count) of documents whose oldest memory is old and whose
    latest use is long ago, without a pending request (content_hash, status)."""
    named = memories.filter((F.col("status") == "active") & F.col("content_hash").isNotNull() & ~F.coalesce(meta("protected", "boolean"), F.lit(False)))
    used = F.greatest("last_reinforced", "last_accessed", "created_at")
    per = named.groupBy("content_hash").agg(F.count("*").alias("memory_count"), F.max(age_in_days(F.coalesce(meta("observed_at", "timestamp"), F.col("created_at")), as_of)).alias("_old"), F.min(age_in_days(used, as_of)).alias("_idle"))
    per = per.filter((F.col("_old") >= old_days) & (F.col("_idle") >= idle_days)).drop("_old", "_idle")
    return per.join(requests.filter(F.col("status") == "pending").select("content_hash"), "content_hash", "left_anti")


def archive_reasons(units: DataFrame, tasks: DataFrame, as_of: Column, idle_days: int = 30, grace_days: int = 7) -> DataFrame:
    """(id, reason) of raw units to archive: consolidated ones after a grace time, raw or
    failed ones that have been idle, unless pinned or named by an open task
    (trigger_unit_id, source_unit_ids)."""
    before = lambda c, days: F.unix_micros(c) < F.unix_micros(as_of) - days * 86_400_000_000
    merged = F.col("route_status").isin("merged", "episode_created")
    settled = F.col("extraction_status").isin("extracted", "skipped", "failed")
    done = merged & F.col("consolidated_at").isNotNull() & before(F.greatest("last_accessed", "consolidated_at"), grace_days)
    unused = before(F.coalesce("last_accessed", "created_at"), idle_days)
    idle = F.col("route_status").isin("raw_only", "route_failed") & settled & before(F.coalesce("last_routed_at", "updated_at", "created_at"), idle_days) & unused
    failed = (F.col("embedding_status") == "failed") & settled & unused
    open_tasks = tasks.filter(F.col("status").isin("pending", "in_progress"))
    busy = open_tasks.select(F.explode(F.concat(F.array("trigger_unit_id"), F.coalesce("source_unit_ids", F.array().cast("array<long>")))).alias("id")).distinct()
    some = units.filter((F.col("status") == "active") & F.col("pinned_at").isNull() & F.coalesce(done | idle | failed, F.lit(False)))
    return some.join(busy, "id", "left_anti").select("id", F.when(merged, "consolidated").otherwise("idle_raw").alias("reason"))


def to_reroute(units: DataFrame, as_of: Column, days: int = 7, most: int = 100) -> DataFrame:
    """The raw-only units that were not routed for so long, the oldest first."""
    seen = F.coalesce("last_routed_at", "created_at")
    some = units.filter((F.col("status") == "active") & (F.col("route_status") == "raw_only") & (F.unix_micros(seen) < F.unix_micros(as_of) - days * 86_400_000_000))
    return some.orderBy(seen, "id").limit(most).select("id")


def rechunk_candidates(documents: DataFrame, chunks: DataFrame, version: str) -> DataFrame:
    """(doc_id, reason) of documents without chunks, or with some of another version."""
    per = chunks.groupBy("doc_id").agg(F.bool_or(~F.col("version").eqNullSafe(F.lit(version))).alias("_other"))
    out = documents.select("doc_id").join(per, "doc_id", "left")
    return out.filter(F.col("_other").isNull() | F.col("_other")).select("doc_id", F.when(F.col("_other").isNull(), "missing").otherwise("outdated").alias("reason"))


def presence(rows: DataFrame, as_of: Column, include_expired: bool = False) -> DataFrame:
    """The latest row per (channel, channel_id, kind), unless it has expired."""
    key = F.coalesce("channel_id", F.lit(""))
    w = W.partitionBy("channel", key, "kind").orderBy(F.desc("seen_at"), F.desc("id"))
    live = rows if include_expired else rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return live.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def newly_summarized(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of memories that are summarized in ``after`` and were not in ``before``."""
    done = lambda df: df.filter(F.coalesce(meta("consolidation.summarized", "boolean"), F.lit(False))).select("id")
    return done(after).join(done(before), "id", "left_anti")


def due(tasks: DataFrame, as_of: Column, most: int) -> DataFrame:
    """The active tasks whose time has come, in its order."""
    return tasks.filter((F.col("status") == "active") & (F.col("next_run_at") <= as_of)).orderBy("next_run_at", "id").limit(most)
