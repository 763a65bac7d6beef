"""Streams that take what is there and stop, on the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_provider(spark: SparkSession) -> None:
    """Timers and lists of state need the store that keeps them on disk."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def appended(stream: DataFrame, path: str) -> DataFrame:
    """Everything that the stream's source has now, appended to a table under ``path``;
    the next call goes on from there. Each batch is written once, also after a restart."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
