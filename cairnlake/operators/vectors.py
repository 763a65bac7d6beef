"""Exact vector search: one query, a set of queries, clusters and routing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that travel to the tasks together; a larger set is searched in more passes.
QUERY_BLOCK = 4096
#: Rows that meet a block of queries at once.
ROWS_AT_ONCE = 1024


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a constant; null for vectors of zeros or another length."""
    norm = float(np.sqrt(np.sum(np.square(np.asarray(query, np.float64)))))
    q = F.lit([float(x) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((own > 0) & (F.size(vector) == len(query)) & F.lit(norm > 0), dot / (own * norm))


def nearest(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """The k rows most similar to ``query``, ties by id; adds ``similarity``."""
    out = df.withColumn("similarity", cosine(F.col(vector_col), query)).filter(F.col("similarity").isNotNull())
    if least is not None:
        out = out.filter(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), id_col).limit(k)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows that have ``width`` numbers, from the flat buffer."""
    sizes = np.diff(column.offsets.to_numpy())
    usable = np.flatnonzero((sizes == width) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[usable] - column.offsets.to_numpy()[0]
    flat = flat[column.offsets.to_numpy()[0] :] if len(usable) else flat
    return usable, flat[starts[:, None] + np.arange(width)] if len(usable) else np.zeros((0, width))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them had any length."""
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _first_k(similarity: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k greatest of each row, ties by the lesser id."""
    order = np.lexsort((np.broadcast_to(ids, similarity.shape), -similarity), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(similarity)), order.shape[1])
    columns = order.ravel()
    kept = similarity[rows, columns] >= least
    return rows[kept], columns[kept]


class _Search:
    """For each query of a block its k best rows of every lot of rows."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int, least: float) -> None:
        self.ids, self.k, self.least = np.array(ids), k, least
        self.vectors, self.some = _unit(vectors)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                usable, x = _matrix(batch.column(1), self.vectors.shape[1])
                x, some = _unit(x)
                other = batch.column(0).to_numpy(zero_copy_only=False)[usable[some]]
                similarity = self.vectors @ x[some].T
                similarity[self.ids[:, None] == other[None]] = -2
                similarity[~self.some] = -2
                if not len(other):
                    continue
                q, r = _first_k(similarity, other, self.k, self.least)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(other[r]), pa.array(similarity[q, r])], ["query_id", "id", "similarity"])


class _Near:
    """For each row its ``most`` best of a block of centroids."""

    def __init__(self, names: list[int], vectors: np.ndarray, most: int, least: float) -> None:
        self.names, self.most, self.least = np.array(names), most, least
        self.vectors, self.some = _unit(vectors)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                usable, x = _matrix(batch.column(1), self.vectors.shape[1])
                x, some = _unit(x)
                own = batch.column(0).to_numpy(zero_copy_only=False)[usable[some]]
                similarity = x[some] @ self.vectors[self.some].T
                r, c = _first_k(similarity, self.names[self.some], self.most, self.least)
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(self.names[self.some][c]), pa.array(similarity[r, c])], ["id", "cluster", "similarity"])


def nearest_of_each(df: DataFrame, queries: DataFrame, k: int, least: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): for each query its k most similar other rows.

    Up to ``QUERY_BLOCK`` queries, counted first, go to the tasks as one block, and
    each batch of rows is a matrix product that leaves the best k of each query.
    More of them are joined block by block (``vector_join``).
    """
    some = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).filter("v is not null and i is not null")
    if some.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        from cairnlake.operators.vector_join import nearest_of_all

        return nearest_of_all(df, queries, k, least, id_col, vector_col)
    listed = some.orderBy("i").collect()
    if not listed:
        return df.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    rows, parts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col), []
    for width in sorted({len(r["v"]) for r in listed}):
        block = [r for r in listed if len(r["v"]) == width]
        search = _Search([r["i"] for r in block], np.array([r["v"] for r in block], np.float64), k, least)
        parts.append(rows.mapInArrow(search, "query_id long, id long, similarity double"))
    found = reduce(DataFrame.unionByName, parts)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def routed(neighbours: DataFrame, duplicate: float = 0.92, related: float = 0.8) -> DataFrame:
    """What to do with each query by its nearest neighbour: duplicate, related or create."""
    best = neighbours.filter("rank = 1")
    decision = F.when(F.col("similarity") >= duplicate, "duplicate").when(F.col("similarity") >= related, "related").otherwise("create")
    return best.select("query_id", "id", "similarity", decision.alias("decision"))


def centroids(df: DataFrame, cluster_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(cluster, centroid, members): mean vectors, with map-side sums by dimension."""
    each = df.select(F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("dim", "x"))
    mean = each.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("members"))


def assigned(df: DataFrame, centers: DataFrame, most: int = 3, least: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, similarity): up to ``most`` clusters whose centroid is near, ties
    by cluster. Centroids go to the tasks in blocks of ``QUERY_BLOCK``."""
    rows = centers.select("cluster", "centroid").orderBy("cluster").collect()
    parts = []
    for at in range(0, len(rows), QUERY_BLOCK):
        some = rows[at : at + QUERY_BLOCK]
        found = _Near([r["cluster"] for r in some], np.array([r["centroid"] for r in some], np.float64), most, least)
        parts.append(df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(found, "id long, cluster long, similarity double"))
    if not parts:
        return df.sparkSession.createDataFrame([], "id long, cluster long, similarity double")
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        order = W.partitionBy("id").orderBy(F.desc("similarity"), "cluster")
        out = out.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    return out.select("id", F.col("cluster").cast(centers.schema["cluster"].dataType).alias("cluster"), "similarity")


def nearest_of_type(df: DataFrame, query: list[float], k: int, wins: Column, tries: Column) -> DataFrame:
    """The k nearest rows with ``success_rate``, null for what was never tried."""
    rate = F.when(F.coalesce(tries, F.lit(0)) > 0, F.try_divide(wins.cast("double"), tries.cast("double")))
    return nearest(df.withColumn("success_rate", rate), query, k)


def route_decisions(neighbours: DataFrame, episodes: DataFrame, merge: float = 0.78, near: float = 0.7, enough: int = 5, looked_at: int = 20) -> DataFrame:
    """(query_id, decision, episode): a unit joins its nearest episode if that is near;
    else it starts one if enough of its nearest units are; else it stays raw. Both
    tables are (query_id, id, similarity, rank)."""
    best = episodes.filter("rank = 1").select("query_id", F.col("id").alias("_e"), F.col("similarity").alias("_s"))
    around = neighbours.filter(F.col("rank") <= looked_at).groupBy("query_id").agg(F.count_if(F.col("similarity") >= near).alias("_n"))
    both = around.join(best, "query_id", "full")
    joins = F.coalesce(F.col("_s") >= merge, F.lit(False))
    decision = F.when(joins, "merge").when(F.coalesce("_n", F.lit(0)) >= enough, "create").otherwise("raw_only")
    return both.select("query_id", decision.alias("decision"), F.when(joins, F.col("_e")).alias("episode"))


def contradiction_candidates(neighbours: DataFrame, open_pairs: DataFrame, least: float = 0.55) -> DataFrame:
    """(query_id, id, similarity) of near pairs that are not in the ledger (a, b), in
    whichever order."""
    pair = lambda x, y: [F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b")]
    some = neighbours.filter(F.col("similarity") >= least).select("query_id", "id", "similarity", *pair("query_id", "id"))
    return some.join(open_pairs.select(*pair("a", "b")).distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def new_facts(neighbours: DataFrame, facts: DataFrame, same: float = 0.92) -> DataFrame:
    """The facts (query_id) that no held vector is as good as equal to."""
    return facts.join(neighbours.filter(F.col("similarity") >= same).select("query_id").distinct(), "query_id", "left_anti")


def boundary_hits(boundaries: DataFrame, query: list[float], said: str, least: float = 0.75) -> DataFrame:
    """(vec_id, similarity) of boundaries (vec_id, embedding, patterns) that a text
    touches: by similarity, or wholly where it has one of the patterns, without case."""
    by_vector = boundaries.select("vec_id", cosine(F.col("embedding"), query).alias("similarity")).filter(F.col("similarity") > least)
    named = F.exists("patterns", lambda p: F.contains(F.lit(said.lower()), F.lower(p)))
    by_word = boundaries.filter(F.coalesce(named, F.lit(False))).select("vec_id", F.lit(1.0).alias("similarity"))
    return by_vector.unionByName(by_word).groupBy("vec_id").agg(F.max("similarity").alias("similarity"))


def availability(df: DataFrame, query: list[float], floor: float = 0.5) -> DataFrame:
    """One row: how much there is to remember about a query: ``matches`` above the
    floor, the ``best`` of them (null without any), and both in words."""
    out = df.select(cosine(F.col("embedding"), query).alias("s")).filter(F.col("s") > floor).agg(F.count("*").alias("matches"), F.max("s").alias("best"))
    n, best = F.col("matches"), F.col("best")
    sense = F.when(n == 0, "nothing").when(n <= 2, "vague").when(n <= 5, "something").when(n <= 10, "familiar").otherwise("rich")
    known = F.when(n == 0, "unknown").when(best > 0.8, "well known").when(best > 0.6, "familiar").otherwise("not at once")
    return out.withColumns({"sense": sense, "known": known})
