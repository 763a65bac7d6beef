"""JSON Lines interchange: an envelope line, typed records and a footer with counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def export_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Write the tables as lines {"kind", "section", "record"}; the envelope and the
    footer (rows per section) are files of their own, so no task gathers rows."""
    spark = next(iter(sections.values())).sparkSession
    record = lambda name, df: df.select(F.to_json(F.struct(F.lit("record").alias("kind"), F.lit(name).alias("section"), F.struct(*df.columns).alias("record"))).alias("value"))
    reduce(DataFrame.unionByName, [record(n, df) for n, df in sections.items()]).write.text(f"{path}/records")
    counts = spark.read.json(f"{path}/records", schema="section string").groupBy("section").count()
    spark.createDataFrame([("envelope", VERSION, sorted(sections))], "kind string, version string, sections array<string>").coalesce(1).write.json(f"{path}/envelope")
    counts.select(F.lit("footer").alias("kind"), "section", F.col("count").alias("rows")).coalesce(1).write.json(f"{path}/footer")


def import_section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The records of a section; an incomplete export is refused."""
    lines = spark.read.json(f"{path}/records", schema=f"section string, record struct<{schema}>").filter(F.col("section") == name)
    told = spark.read.json(f"{path}/footer", schema="section string, rows long").filter(F.col("section") == name).first()
    if lines.count() != (told["rows"] if told else 0):
        raise ValueError(f"section {name} is incomplete")
    return lines.select("record.*")
