"""A work queue kept by a stream of commands, with batches that may come twice.

A batch is folded to one row an item and written to a folder named by its number,
over what an earlier try may have left there. The queue is the fold of all these
rows, so a batch that is repeated after a crash changes nothing; every so many
batches are folded into one. Folding is by greatest time, so commands may come in
any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What becomes of an item by its latest command.
STATUS = {"submit": "pending", "start": "processing", "complete": "completed", "fail": "failed"}
#: A fold: the latest command, first submission, number of starts, latest start and end, last error.
COLUMNS = "item long, latest struct<at:timestamp,seq:long,action:string>, created_at timestamp, attempts long, started_at timestamp, completed_at timestamp, error struct<at:timestamp,text:string>"
#: Batches that are folded into one.
FOLD_EVERY = 8


def folded(commands: DataFrame) -> DataFrame:
    """One row an item of ``commands`` (item, seq, action, at, error), in COLUMNS; commands
    of other names, or without an item or a time, don't count."""
    known = commands.filter(F.col("action").isin(*STATUS) & F.col("item").isNotNull() & F.col("at").isNotNull())
    when = lambda *actions: F.when(F.col("action").isin(*actions), F.col("at"))
    return known.groupBy(F.col("item").cast("long").alias("item")).agg(
        F.max(F.struct("at", F.col("seq").cast("long").alias("seq"), "action")).alias("latest"), F.min(when("submit")).alias("created_at"), F.count_if(F.col("action") == "start").alias("attempts"),
        F.max(when("start")).alias("started_at"), F.max(when("complete", "fail")).alias("completed_at"),
        F.max(F.when(F.col("action") == "fail", F.struct("at", F.col("error").alias("text")))).alias("error"),
    )


def _merged(folds: DataFrame) -> DataFrame:
    return folds.groupBy("item").agg(
        F.max("latest").alias("latest"), F.min("created_at").alias("created_at"), F.sum("attempts").alias("attempts"), F.max("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"), F.max("error").alias("error"),
    )


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) batch of the complete folds to read, none of them inside another."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = []
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("fold-") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            first, last = name[len("fold-") :].split("-")
            found.append((int(first), int(last)))
    whole: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda x: (x[0], -x[1])):
        if not whole or last > whole[-1][1]:
            whole.append((first, last))
    return whole


def _read(spark: SparkSession, path: str, folders: list[tuple[int, int]]) -> DataFrame:
    reader = spark.read.schema(COLUMNS)
    return reader.parquet(*[f"{path}/fold-{a}-{b}" for a, b in folders])


def queue(spark: SparkSession, path: str) -> DataFrame:
    """(item, status, created_at, attempts, started_at, completed_at, error) as it stands."""
    folders = _folders(spark, path)
    rows = _merged(_read(spark, path, folders)) if folders else spark.createDataFrame([], COLUMNS)
    status = F.coalesce(*[F.when(F.col("latest.action") == a, F.lit(s)) for a, s in STATUS.items()])
    return rows.select("item", status.alias("status"), "created_at", "attempts", "started_at", "completed_at", F.col("error.text").alias("error"))


def upsert(path: str, fold_every: int = FOLD_EVERY):
    """The function of a stream's batches that brings commands into the queue."""

    def write(batch: DataFrame, number: int) -> None:
        folded(batch).write.mode("overwrite").parquet(f"{path}/fold-{number}-{number}")
        if (number + 1) % fold_every == 0:
            spark = batch.sparkSession
            first = number + 1 - fold_every
            # An earlier try may have left the whole; it is written anew from its parts.
            parts = [(a, a) for a in range(first, number + 1)]
            _merged(_read(spark, path, parts)).write.mode("overwrite").parquet(f"{path}/fold-{first}-{number}")

    return write


def follow(commands: DataFrame, path: str, fold_every: int = FOLD_EVERY) -> DataFrame:
    """Everything that the stream of commands has now brought into the queue."""
    writer = commands.writeStream.foreachBatch(upsert(f"{path}/queue", fold_every)).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return queue(commands.sparkSession, f"{path}/queue")


def claimed(rows: DataFrame, as_of: Column, k: int, stale_seconds: int = 600) -> DataFrame:
    """The commands that claim the k items longest pending, or stale in processing, as
    they are submitted to the stream: (item, action, at)."""
    stale = (F.col("status") == "processing") & (F.unix_micros("started_at") < F.unix_micros(as_of) - stale_seconds * 1_000_000)
    free = rows.filter((F.col("status") == "pending") | stale).orderBy(F.asc_nulls_last("created_at"), "item").limit(k)
    return free.select("item", F.lit("start").alias("action"), as_of.alias("at"))


def cleaned(rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The queue without items that ended longer ago."""
    old = F.col("status").isin("completed", "failed") & (F.unix_micros("completed_at") < F.unix_micros(as_of) - days * 86_400_000_000)
    return rows.filter(~F.coalesce(old, F.lit(False)))
