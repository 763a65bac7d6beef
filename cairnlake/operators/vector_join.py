"""Joins of two tables of vectors by similarity, with both sides dealt in blocks.

Every block of queries meets every block of rows in one task, as a matrix
product of bounded size; a row is repeated once a block of the other side, and a
task returns only the best of each query, or a count a row. No vector passes
through the driver, and the work is spread over blocks times blocks tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.operators.vectors import ROWS_AT_ONCE, _matrix, _unit

#: Vectors of a block, on average.
BLOCK_ROWS = 8192


def _dealt(queries: DataFrame, rows: DataFrame, block_rows: int) -> DataFrame:
    """(i, j, side, id, vector), sorted so that a task meets the queries (side 0) of
    a pair of blocks before its rows (side 1)."""
    blocks = [max(1, -(-df.count() // block_rows)) for df in (queries, rows)]

    def side(df: DataFrame, own: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(blocks[own])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))
        names = ("i", "j") if own == 0 else ("j", "i")
        return df.select(mine.alias(names[0]), other.alias(names[1]), F.lit(own).alias("side"), "id", "vector").select("i", "j", "side", "id", "vector")

    both = side(queries, 0).unionByName(side(rows, 1))
    return both.repartition("i", "j").sortWithinPartitions("i", "j", "side")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, query vectors, row ids, row vectors) with one block of queries and
    some rows of the block beside it; vectors have length one."""
    at: tuple[int, int] | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    queries: tuple[np.ndarray, np.ndarray] | None = None
    for whole in batches:
        keys = np.stack([whole.column(c).to_numpy() for c in ("i", "j", "side")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
            if begin == end:
                continue
            i, j, side = keys[:, begin].tolist()
            if (i, j) != at:
                at, held, queries = (i, j), [], None
            for low in range(begin, end, ROWS_AT_ONCE):
                batch = whole.slice(low, min(ROWS_AT_ONCE, end - low))
                widths = batch.column("vector").value_lengths().drop_null().to_numpy()
                for width in np.unique(widths):
                    usable, x = _matrix(batch.column("vector"), int(width))
                    x, some = _unit(x)
                    found = batch.column("id").to_numpy(zero_copy_only=False)[usable[some]], x[some]
                    if side == 0:
                        held.append(found)
                        queries = None
                        continue
                    if queries is None:
                        queries = _stacked(held)
                    for ids, vectors in queries:
                        if vectors.shape[1] == width and len(ids) and len(found[0]):
                            yield ids, vectors, *found


def _stacked(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The held queries, one table for each width of vectors."""
    widths = sorted({x.shape[1] for _, x in held})
    return [tuple(np.concatenate([pair[k] for pair in held if pair[1].shape[1] == w]) for k in (0, 1)) for w in widths]


class _Best:
    """For each query of a pair of blocks its k best rows of the block beside it.

    The best so far are held; of each lot of rows only those are looked at that
    reach the k-th of them.
    """

    def __init__(self, k: int, least: float) -> None:
        self.k, self.least = k, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: np.ndarray | None = None
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for mine, x, others, y in _pairs(batches):
            if mine is not ids:
                yield from self._told(ids, best)
                ids, best = mine, {}
            for low in range(0, len(mine), ROWS_AT_ONCE):
                some = mine[low : low + ROWS_AT_ONCE]
                similarity = x[low : low + ROWS_AT_ONCE] @ y.T
                similarity[some[:, None] == others[None]] = -2
                best[low] = self._best(similarity, others, best.get(low))
        yield from self._told(ids, best)

    def _best(self, similarity: np.ndarray, others: np.ndarray, held: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        """(place of the query, id, similarity) of the k best of each, in order."""
        n = len(similarity)
        floor = np.full(n, -np.inf)
        if held is None:
            if len(others) > self.k:
                floor = -np.partition(-similarity, self.k - 1, axis=1)[:, self.k - 1]
                floor = np.where(np.isnan(floor), -np.inf, floor)
        else:
            last = np.flatnonzero(np.bincount(held[0], minlength=n) == self.k)
            floor[last] = held[2][np.searchsorted(held[0], last, "right") - 1]
        q, r = np.nonzero(similarity >= np.maximum(floor, self.least)[:, None])
        found = q, others[r], similarity[q, r]
        if held is not None:
            found = tuple(np.concatenate(pair) for pair in zip(held, found, strict=True))
        order = np.lexsort((found[1], -found[2], found[0]))
        q, r, s = (v[order] for v in found)
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[kept], r[kept], s[kept]

    @staticmethod
    def _told(ids: np.ndarray | None, best: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for low, (q, r, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[low + q]), pa.array(r), pa.array(s)], ["query_id", "id", "similarity"])


class _Counts:
    """For each row the number of queries of a block that are as near as asked."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, others, y in _pairs(batches):
            n = sum(((x[low : low + ROWS_AT_ONCE] @ y.T) >= self.least).sum(0) for low in range(0, len(x), ROWS_AT_ONCE))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(others[hit]), pa.array(n[hit].astype(np.int64))], ["id", "n"])


def _named(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return kept.filter("id is not null and vector is not null")


def nearest_of_all(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, similarity, rank): for each query its k most similar other rows
    of at least that similarity, ties by id. Vectors of zeros and null ones are left
    out; vectors of unlike lengths don't meet."""
    found = _dealt(_named(queries, id_col, vector_col), _named(rows, id_col, vector_col), block_rows)
    found = found.mapInArrow(_Best(k, least), "query_id long, id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def times_near(rows: DataFrame, queries: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n): how many queries are at least so similar to each row, where any is."""
    found = _dealt(_named(queries, id_col, vector_col), _named(rows, id_col, vector_col), block_rows)
    return found.mapInArrow(_Counts(least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def renewed_neighbourhoods(memories: DataFrame, held: DataFrame, as_of, k: int = 20, least: float = 0.5, most: int | None = None) -> DataFrame:
    """(id, neighbours, computed_at): the neighbourhoods in ``held`` (id, is_stale,
    computed_at) that are stale, computed again among the live embedded memories.

    With ``most`` only those computed longest ago, such as never were first. A
    memory without a neighbour that near has an empty map.
    """
    stale = held.filter("is_stale").select("id", F.col("computed_at").alias("_at"))
    if most is not None:
        stale = stale.orderBy(F.asc_nulls_first("_at"), "id").limit(most)
    live = memories.filter("status = 'active' and embedding_status = 'embedded'").select("id", "embedding")
    asked = memories.join(stale, "id", "left_semi").select("id", "embedding")
    near = nearest_of_all(live, asked, k, least, "id")
    maps = near.groupBy(F.col("query_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("id", "similarity"))).alias("neighbours"))
    empty = F.create_map().cast("map<bigint,double>")
    return stale.select("id").join(maps, "id", "left").select("id", F.coalesce("neighbours", empty).alias("neighbours"), as_of.alias("computed_at"))


def resolved_searches(memories: DataFrame, pending: DataFrame, as_of, most: int = 10, boost: float = 0.45, boost_least: float = 0.5, tell_least: float = 0.5, told_before: int = 0, tell_most: int = 3) -> tuple[DataFrame, DataFrame]:
    """What searches left for later bring back: (boosts, notes).

    ``pending`` is (id, embedding, asked, started_at, created_at); the ``most`` oldest
    that have waited thirty seconds are looked at. boosts (id, activation_boost): every
    live memory near enough to any of them, raised once for each, up to one. notes
    (search, id, similarity, note): the nearest live memory of each that is not private,
    if near enough, in order, as many as a day allows.
    """
    due = pending.filter(F.col("started_at") <= as_of - F.expr("INTERVAL 30 SECONDS")).orderBy("created_at", "id").limit(most)
    live = memories.filter((F.col("status") == "active") & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))
    n = times_near(live, due, boost_least, "id")
    boosts = live.join(n, "id").select("id", F.least(F.lit(1.0), F.coalesce("activation_boost", F.lit(0.0)) + boost * F.col("n")).alias("activation_boost"))
    public = live.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    # Ids of searches and memories are not the same: a search is numbered below zero.
    asked = due.filter("asked is not null").withColumn("id", -F.col("id") - 1)
    best = nearest_of_all(public, asked, 1, tell_least, "id").select((-F.col("query_id") - 1).alias("search"), "id", "similarity")
    told = best.join(due.select(F.col("id").alias("search"), "asked", "created_at"), "search").join(public.select("id", "content"), "id")
    note = F.concat(F.lit('Earlier I couldn\'t remember this: "'), F.left("asked", F.lit(160)), F.lit('". It came back to me — '), F.left("content", F.lit(400)))
    told = told.orderBy("created_at", "search").limit(max(tell_most - told_before, 0))
    return boosts, told.select("search", "id", "similarity", note.alias("note"))
