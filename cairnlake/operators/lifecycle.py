"""Sessions, queue leases, storms, spaced reinforcement and capacity retention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnlake.operators.temporal import counted_within
from cairnlake.shared import saved


def sessions(df: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", gap_seconds: int = 1800) -> DataFrame:
    """(key, session, start, end, events): a new session begins after a gap longer than given."""
    w = W.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(ts)
    fresh = (micros - F.lag(micros).over(w) > gap_seconds * 1_000_000).cast("int")
    numbered = df.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))


def idle(found: DataFrame, as_of: Column, idle_seconds: int = 1800) -> DataFrame:
    """Sessions without events for the given time at ``as_of``."""
    return found.filter(F.unix_micros("end") < F.unix_micros(as_of) - idle_seconds * 1_000_000)


def lease(tasks: DataFrame, as_of: Column, k: int, timeout_seconds: int = 600) -> DataFrame:
    """The k oldest tasks that are pending, or in progress for longer than the
    timeout, as they are once claimed: (task_id, status, attempts, claimed_at)."""
    stale = (F.col("status") == "in_progress") & (F.unix_micros("claimed_at") < F.unix_micros(as_of) - timeout_seconds * 1_000_000)
    free = tasks.filter((F.col("status") == "pending") | stale).orderBy("created_at", "task_id").limit(k)
    return free.select("task_id", F.lit("in_progress").alias("status"), (F.col("attempts") + 1).alias("attempts"), as_of.alias("claimed_at"))


def storms(starts: DataFrame, key: str, ts: str = "ts", window_seconds: int = 120, most: int = 5) -> DataFrame:
    """Starts that come as more than ``most`` of a key within the window before them."""
    return counted_within(starts, key, ts, window_seconds, "starts").filter(F.col("starts") > most)


class _Spaced:
    """Rows (key, micros) in order: per key the number of events and of those that
    follow the last counted one by the spacing. State is one key's last time."""

    def __init__(self, spacing: int, schema: pa.Schema) -> None:
        self.spacing, self.schema = spacing, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, events, spaced, last, begun = None, 0, 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0))
            times, low, done = batch.column(1).to_numpy(), 0, []
            for value, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if begun and value != key:
                    done.append((key, events, spaced))
                if not begun or value != key:
                    key, events, spaced, last, begun = value, 0, 0, None, True
                some = times[low:high]
                events += len(some)
                at = 0 if last is None else int(np.searchsorted(some, last + self.spacing))
                while at < len(some):
                    last, spaced = int(some[at]), spaced + 1
                    at = int(np.searchsorted(some, last + self.spacing))
                low = high
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), self.schema, strict=True)], schema=self.schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, events, spaced), self.schema, strict=True)], schema=self.schema)


def spaced_counts(df: DataFrame, key: str = "user_id", ts: str = "ts", spacing_seconds: int = 43_200, scale: float = 4.0) -> DataFrame:
    """(key, events, spaced, score): events count only if they follow the last
    counted one by the spacing. Events go by in order of their key and time, so
    memory does not grow with a key's events; events without a time are left out."""
    kind = df.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("events", pa.int64()), ("spaced", pa.int64())])
    rows = df.select(key, F.unix_micros(ts).alias("_t")).filter("_t is not null").repartition(key).sortWithinPartitions(key, "_t")
    out = rows.mapInArrow(_Spaced(spacing_seconds * 1_000_000, schema), f"`{key}` {kind.simpleString()}, events long, spaced long")
    return out.withColumn("score", 1 - F.exp(-F.col("spaced") / scale))


def over_capacity(df: DataFrame, capacity: float, size: str = "strength", id_col: str = "id") -> DataFrame:
    """The weakest rows that must go until the rest sums to ``capacity`` at most, ties by id.

    Rows are dealt to ranges of (size, id), so equal sizes are split too; sums of
    the ranges run over a small table, and rows run within their range.
    """
    total = df.agg(F.sum(size)).first()[0]
    if not total or total <= capacity:
        return df.limit(0)
    ranged = df.repartitionByRange(size, id_col).sortWithinPartitions(size, id_col).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_s"))
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy(size, id_col).rowsBetween(W.unboundedPreceding, -1)
    put = ranged.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0.0))).join(sums, "_range")
    return put.filter(F.lit(total) - F.col("_before") - F.col("_own") > capacity).drop("_range", "_own", "_before")
