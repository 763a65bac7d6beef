"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions, by application.
_local_dirs: dict[str, str] = {}
#: What an application has stored and may use again, by its folder and a name.
_kept: dict[tuple[str, ...], object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session has none, a local one (all tasks in the driver's process, as in
    tests) gets a temporary folder; on a cluster that is an error, since executors
    elsewhere would not see a folder of the driver's machine.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[context.applicationId]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/cairnlake-{spark.sparkContext.applicationId}"


def clear_saved(spark: SparkSession) -> None:
    """Remove all that this application saved; results that read it are void then."""
    for key in [k for k in _kept if k[0] == own_dir(spark)]:
        del _kept[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``by`` names a
    column with few values, each of which gets a folder of its own.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and several consumers share one computation. The files stay until the caller
    is done with all results and calls ``clear_saved``.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: tuple[str, ...], make):
    """What ``make`` gives, made once for an application and a name, until
    ``clear_saved``: for tables that many queries read, such as a word index."""
    key = (own_dir(spark), *name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
