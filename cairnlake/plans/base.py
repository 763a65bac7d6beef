"""Registration of queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"
QUERY_ID = 0
#: Cosine with vector 0 in SQL.
SQL_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


#: White space of Unicode as DuckDB's patterns name it, and texts as they are compared.
SQL_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_CANONICAL = f"lower(regexp_replace(regexp_replace(coalesce({{0}}, ''), '^{SQL_WHITE.replace('{', '{{').replace('}', '}}')}+|{SQL_WHITE.replace('{', '{{').replace('}', '}}')}+$', '', 'g'), '{SQL_WHITE.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"
SQL_NORMALIZED = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce({0}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g'), '^\n+', ''), '\n+$', '')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_ID) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0]
