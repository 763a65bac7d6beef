"""Point-in-time state, validity intervals, snapshots' differences and change kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid_at(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Rows whose interval holds ``at``: open ends are null, the end is excluded."""
    return df.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at)))


def state_as_of(df: DataFrame, changes: DataFrame, at: Column, key: str = "id", value: str = "value") -> DataFrame:
    """``df`` with the values of an earlier time: the prior value of the first
    change (key, changed_at, change_no, prior) after ``at``, else the present one."""
    first = changes.filter(F.col("changed_at") > at).groupBy(key).agg(F.min_by("prior", F.struct("changed_at", "change_no")).alias("_prior"), F.count("*").alias("_n"))
    return df.join(first, key, "left").withColumn(value, F.when(F.col("_n") > 0, F.col("_prior")).otherwise(F.col(value))).drop("_prior", "_n")


def difference(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): keys that came ('added') and went ('expired')."""
    came = after.select(key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("added"))
    return came.unionByName(before.select(key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("expired")))


def changes(old: DataFrame, new: DataFrame, key: str = "id", value: str = "value", threshold: float = 0.1) -> DataFrame:
    """Classified differences of two snapshots: created, removed, strengthened or weakened."""
    o, n = old.select(key, F.col(value).alias("was")), new.select(key, F.col(value).alias("now"))
    both = o.join(n, key, "full")
    kind = (
        F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed")
        .when(F.col("now") - F.col("was") >= threshold, "strengthened").when(F.col("was") - F.col("now") >= threshold, "weakened")
    )
    return both.withColumn("kind", kind).filter("kind is not null")


def counted_within(df: DataFrame, key: str, ts: str, window_seconds: int, name: str) -> DataFrame:
    """``df`` with the number of rows of the same key from ``window_seconds`` before a
    row's time up to it, both included.

    Time is cut into cells of the window's length, so a window is the part of a row's
    cell up to it and the part of the cell before from the window's begin on. Both are
    running sums over a cell of a key, so work is linear however many rows a window
    has, and cells are spread over tasks.
    """
    width = window_seconds * 1_000_000
    at = F.col("_at")
    cell = at - F.pmod(at, F.lit(width))
    times = df.groupBy(F.col(key).alias("_key"), F.unix_micros(ts).alias("_at")).agg(F.count("*").alias("_n"))
    # A window's begin counts what comes before it, so it stands before equal times.
    own = F.struct(cell.alias("cell"), (at * 2 + 1).alias("x"), F.col("_n").alias("n"), F.lit(True).alias("own"))
    begin = F.struct((cell - width).alias("cell"), ((at - width) * 2).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("own"))
    each = times.select("_key", "_at", F.explode(F.when(at.isNull(), F.array(own)).otherwise(F.array(own, begin))).alias("_e")).select("_key", "_at", "_e.*")
    of_cell = W.partitionBy("_key", "cell").orderBy("x")
    so_far, whole = F.sum("n").over(of_cell), F.sum("n").over(of_cell.rangeBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = each.select("_key", "_at", F.when(F.col("own"), so_far).otherwise(whole - so_far).alias("_part"))
    found = parts.groupBy("_key", "_at").agg(F.sum("_part").alias(name))
    rows = df.withColumn("_t", F.unix_micros(ts))
    return rows.join(found, F.col(key).eqNullSafe(F.col("_key")) & F.col("_t").eqNullSafe(F.col("_at"))).select(*df.columns, name)
