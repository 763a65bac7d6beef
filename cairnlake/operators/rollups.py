"""Report aggregates: latest, mode and top rows per key, prices by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order (make it total)."""
    others = [c for c in df.columns if c not in keys]
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, *others)


def top_of_each(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Up to k rows per key with their rank; Spark cuts groups before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, ties by value."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def priced(names: DataFrame, prices: list[tuple[str, float]], name_col: str) -> DataFrame:
    """Adds ``price_key`` and ``price`` of the listed key that equals the name, or
    else of the longest that begins it or that it begins; null without one. The
    list of prices is a constant of the plan."""
    name = F.col(name_col)
    fits = F.array(*[F.when(F.startswith(name, F.lit(k)) | F.startswith(F.lit(k), name), F.struct((name == k).alias("e"), F.lit(len(k)).alias("n"), F.lit(k).alias("k"), F.lit(float(p)).alias("p"))) for k, p in prices])
    return names.withColumn("_fit", F.array_max(fits)).withColumns({"price_key": F.col("_fit.k"), "price": F.col("_fit.p")}).drop("_fit")
