"""Every query with SQL against DuckDB; sinks, streams and odd inputs."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__
from cairnlake.functions import scoring, text
from cairnlake.operators import graph, lifecycle, vectors
from cairnlake.plans import catalog
from cairnlake.sources import jsonl
from cairnlake.streaming import flows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "score", "source"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scores_of_nulls(spark):
    from pyspark.sql import functions as F

    none = F.lit(None).cast("double")
    now = F.lit("2024-01-02").cast("timestamp")
    r = spark.range(1).select(
        scoring.strength(none, F.lit(-1.0), F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("timestamp"), now).alias("s"), scoring.clamp(none).alias("c"),
        scoring.revised_confidence(F.lit(0.98), F.lit("supports"), F.lit(1.0)).alias("r"), scoring.semantic_trust(F.lit(0.5), F.lit(0.0), F.lit(-1.0)).alias("t"),
    ).first()
    assert r["s"] == 0.5 and r["c"] is None and math.isclose(r["r"], 0.987) and r["t"] == 0.0
    assert spark.range(1).select(text.trigram_similarity(F.lit(None).cast("string"), F.lit("a"))).first()[0] == 0.0


def test_vectors_of_odd_shape(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest(df, [1.0, 0.0], 9).collect()] == [0, 4, 5]
    got = vectors.nearest_of_each(df, df.filter("vec_id in (0, 5)"), 1).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(0, 4), (5, 0)}
    assert vectors.nearest_of_each(df, df.limit(0), 3).count() == 0


def test_graph_of_loops(spark):
    edges = spark.createDataFrame([(1, 2, "r", 0.5), (2, 1, "r", 0.5), (2, 3, "r", 0.5), (3, 3, "r", 1.0)], "src long, dst long, rel string, weight double")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.reached(edges, seeds, 5).collect()} == {(1, 0, 1.0), (2, 1, 0.5), (3, 2, 0.25)}
    assert {tuple(r["path"]) for r in graph.paths(edges, seeds, 5).collect()} == {(1, 2), (1, 2, 3)}


def test_capacity(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "id long, strength double")
    gone = lifecycle.over_capacity(df, 20.0)
    assert 40 - sum(r["strength"] for r in gone.collect()) <= 20 and lifecycle.over_capacity(df, 40.0).count() == 0


def test_export_and_import(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, " \"", 0.5)], "id long, content string, trust double")
    jsonl.export_sections({"memories": df, "none": df.limit(0)}, str(tmp_path / "x"))
    back = jsonl.import_section(spark, str(tmp_path / "x"), "memories", "id long, content string, trust double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert jsonl.import_section(spark, str(tmp_path / "x"), "none", "id long").count() == 0


def test_streamed_sessions(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id")
    last = spark.createDataFrame([(10**9, dt.datetime(2025, 1, 1), -1)], events.schema)
    events.write.parquet(f"{tmp_path}/in/a")
    last.write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    query = flows.closed_sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("closed").filter("user_id >= 0")
    assert got.count() == lifecycle.sessions(events).count() and got.columns == ["user_id", "start", "end", "events"]
    batch = lifecycle.sessions(events)
    assert flows.closed_sessions(events).count() == batch.count()


def test_no_oracle_is_empty():
    """Rows to compare on the tables that results are held against."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    empty = [name for name, sql in catalog.ORACLES.items() if con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0]
    assert empty == []
