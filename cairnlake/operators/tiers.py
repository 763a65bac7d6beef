"""The whole of recall: units by their best vector, memories by tier, and what comes unasked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import scoring
from cairnlake.operators import recall
from cairnlake.operators.vectors import cosine
from cairnlake.shared import saved

#: What a unit loses as a bad precedent, and the least score.
PENALTY, FLOOR = 0.35, 0.001
COLUMNS = ("tier", "id", "content", "memory_type", "score", "created_at", "trust", "strength", "source")
_BEST = "id long, score double, at timestamp, kind int, part int"


class _BestOfTask:
    """Of the vectors of units that a task sees: each unit's best one, and of these the
    k best. A unit among the k best of all is among those of the task that has its best
    vector, so nothing is lost."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = self.best(rows if held is None else pa.concat_tables([held, rows]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    def best(self, rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        score, unit = column("score"), column("id")
        # Of equal scores a chunk goes before the whole unit, and an earlier chunk first.
        order = np.lexsort((column("part"), column("kind"), -score, unit))
        first = order[np.concatenate([[True], np.diff(unit[order]) != 0])] if len(order) else order
        late = column("at").astype("datetime64[us]").astype(np.int64)
        ranked = first[np.lexsort((unit[first], -late[first], -score[first]))][: self.k]
        return rows.take(pa.array(ranked))


def unit_hits(units: DataFrame, chunks: DataFrame, query: list[float], k: int, show_private: bool = True) -> DataFrame:
    """(id, score, source, part, char_start, char_end, parts): the k units nearest to a
    query by the best of their own vector and those of their chunks.

    ``units`` are (id, embedding, status, embedding_status, sensitivity, created_at, ..),
    ``chunks`` (unit_id, chunk_index, char_start, char_end, embedding, embedding_status).
    Every task keeps its k best units, so what is moved does not grow with the table;
    only the winners' chunks are looked at again. ``source`` is chunk_vector or vector.
    """
    live = units.filter("status = 'active' and embedding_status = 'embedded'")
    live = live if show_private else live.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    own = live.select("id", cosine(F.col("embedding"), query).alias("score"), F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("part"))
    parts = chunks.filter("embedding_status = 'embedded'").select(F.col("unit_id").alias("id"), cosine(F.col("embedding"), query).alias("score"), F.col("chunk_index").cast("int").alias("part"))
    parts = parts.filter("score is not null").join(live.select("id", F.col("created_at").alias("at")), "id")
    both = own.filter("score is not null").unionByName(parts.select("id", "score", "at", F.lit(0).alias("kind"), "part"))
    both = both.select(F.col("id").cast("long"), "score", F.coalesce("at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "kind", "part")
    # The winners of the tasks, k of each, are compared as any other rows.
    won = both.mapInArrow(_BestOfTask(k), _BEST).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "part", "at")).alias("b"))
    won = won.select("id", (-F.col("b.s")).alias("score"), F.col("b.at").alias("at"), F.col("b.kind").alias("kind"), F.col("b.part").alias("part"))
    best = saved(won.orderBy(F.desc("score"), F.desc("at"), "id").limit(k), "unit-hits")
    counts = chunks.join(F.broadcast(best.select(F.col("id").alias("unit_id"))), "unit_id", "left_semi")
    counts = counts.groupBy(F.col("unit_id").alias("id")).agg(F.count("*").cast("int").alias("parts"), F.collect_list(F.struct("chunk_index", "char_start", "char_end")).alias("_c"))
    hit = F.element_at(F.filter("_c", lambda c: c["chunk_index"] == F.col("part")), 1)
    chosen = best.join(counts, "id", "left").withColumn("_h", F.when((F.col("kind") == 0), hit))
    source = F.when(F.col("kind") == 0, "chunk_vector").otherwise("vector")
    part = F.when(F.col("kind") == 0, F.col("part"))
    return chosen.select("id", "score", source.alias("source"), part.alias("part"), F.col("_h.char_start").alias("char_start"), F.col("_h.char_end").alias("char_end"), F.coalesce("parts", F.lit(0)).alias("parts"))


def warned(content: Column, invalid: Column, correction: Column) -> Column:
    """The content, with a warning before it where it is a bad precedent."""
    more = F.when(F.nullif(correction, F.lit("")).isNotNull(), F.concat(F.lit("; correction: "), correction)).otherwise("")
    return F.when(F.coalesce(invalid, F.lit(False)), F.concat(F.lit("[INVALID PRECEDENT - do not imitate"), more, F.lit("] "), content)).otherwise(content)


def _matching_span(content: Column, part: str) -> Column:
    """What is shown of a unit: the chunk with a line that tells its place, if the
    unit is more than 200 characters longer, else the whole."""
    place = F.concat(F.lit("[Matching RecMem span: chunk "), F.col("part").cast("string"), F.lit(", chars "), F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string"), F.lit(" of unit "), F.col("id").cast("string"), F.lit("]\n\n"))
    return F.when(F.col("part").isNotNull() & (F.length(content) > F.length(part) + 200), F.concat(place, F.col(part))).otherwise(content)


def subconscious(units: DataFrame, chunks: DataFrame, query: list[float], k: int, show_private: bool = True) -> DataFrame:
    """The subconscious tier: ``unit_hits`` with what is shown of each, in COLUMNS."""
    hits = unit_hits(units, chunks, query, k, show_private)
    told = units.join(F.broadcast(hits), "id")
    shown = F.substr(F.col("content"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    told = told.withColumn("_shown", F.when(F.col("part").isNotNull(), shown))
    content = warned(_matching_span(F.col("content"), "_shown"), F.col("invalid_precedent"), F.col("correction"))
    score = F.greatest(F.lit(FLOOR), F.col("score") - F.when(F.coalesce("invalid_precedent", F.lit(False)), PENALTY).otherwise(0.0))
    return told.select(
        F.lit("subconscious").alias("tier"), "id", content.alias("content"), F.lit(None).cast("string").alias("memory_type"), score.alias("score"), "created_at",
        F.col("trust_level").alias("trust"), F.lit(1.0).alias("strength"), "source",
    )


def not_yet_embedded(units: DataFrame, session, show_private: bool = True, most: int = 3) -> DataFrame:
    """The latest units of a session that have no vector yet, in COLUMNS."""
    some = units.filter((F.col("session") == session) & (F.col("status") == "active") & (F.col("embedding_status") != "embedded"))
    some = some if show_private else some.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    some = some.orderBy(F.desc("created_at"), "id").limit(most)
    return some.select(
        F.lit("subconscious").alias("tier"), "id", "content", F.lit(None).cast("string").alias("memory_type"), F.lit(0.2).alias("score"), "created_at",
        F.col("trust_level").alias("trust"), F.lit(1.0).alias("strength"), F.lit("temporal").alias("source"),
    )


def spontaneous(memories: DataFrame, as_of: Column, called: DataFrame, show_private: bool = True, least_boost: float = 0.3, most: int = 2) -> DataFrame:
    """The live memories with the greatest boost above ``least_boost``, but for private
    ones and those that were ``called`` (id) already, in COLUMNS."""
    live = memories.filter((F.col("status") == "active") & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)) & (F.col("activation_boost") > least_boost))
    top = live.orderBy(F.desc("activation_boost"), "id").limit(most)
    top = top if show_private else top.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    strong = scoring.strength(F.col("importance"), F.col("decay_rate"), F.col("created_at"), F.col("last_reinforced"), as_of)
    return top.join(called.select("id"), "id", "left_anti").select(
        F.lit("spontaneous").alias("tier"), "id", "content", F.col("type").alias("memory_type"), F.least(F.lit(1.0), "activation_boost").alias("score"), "created_at",
        F.col("trust_level").alias("trust"), strong.alias("strength"), F.lit("spontaneous").alias("source"),
    )


def recall_context(
    units: DataFrame, chunks: DataFrame, memories: DataFrame, query: list[float], as_of: Column, neighbours: DataFrame, edges: DataFrame, open_members: DataFrame,
    session=None, k_units: int = 10, ks: dict[str, int] | None = None, mood: tuple[float, float, str] = (0.0, 0.5, "neutral"), least_trust: float = 0.0, show_private: bool = True,
) -> DataFrame:
    """All that a query calls up, in COLUMNS: the nearest units, those of the session
    without a vector yet, memories of each tier (``recall.in_context``), and the two
    that come unasked. Every part is a bounded table before it is joined to its rows.
    """
    called = recall.in_context(memories, query, as_of, neighbours, edges, open_members, ks, mood, least_trust, show_private)
    strong = scoring.strength(F.col("importance"), F.col("decay_rate"), F.col("created_at"), F.col("last_reinforced"), as_of)
    told = memories.join(F.broadcast(called.drop("rank")), "id")
    content = warned(F.col("content"), F.col("invalid_precedent"), F.col("correction"))
    tiered = told.select("tier", "id", content.alias("content"), F.col("type").alias("memory_type"), "score", "created_at", F.col("trust_level").alias("trust"), strong.alias("strength"), "source")
    out = subconscious(units, chunks, query, k_units, show_private)
    if session is not None:
        out = out.unionByName(not_yet_embedded(units, session, show_private))
    return out.unionByName(tiered).unionByName(spontaneous(memories, as_of, called, show_private))
