"""Joins, windows, run times and indexes whose work must not outgrow their input."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairnlake.functions import schedule
from cairnlake.operators import chunk_search, filters, lifecycle, postings, review, search, temporal, vector_join
from cairnlake.plans import lexical


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_within_a_window(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice(["a", "b", None]), None if n % 17 == 3 else rng.randrange(-5_000_000, 5_000_000, 250_000)) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {r["id"]: r["n"] for r in temporal.counted_within(df, "k", "ts", 2, "n").collect()}
    near = lambda x, y: x is y if x is None or y is None else x - 2_000_000 <= y <= x
    assert got == {i: sum(q == k and near(t, u) for _, q, u in rows) for i, k, t in rows}


def test_windows_do_not_slide(spark):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "id long, k string, ts timestamp")
    for out in (review.running_totals(df, "k", "ts", 60, 1), lifecycle.storms(df, "k")):
        assert "RangeFrame, -" not in plan(out)


def test_pairs_by_any_key_without_a_shuffle_of_pairs(spark):
    rng = random.Random(6)
    some = lambda m: rng.choice([None, *range(m)])
    rows = [(n if n < 30 else rng.randrange(30), some(6), some(4)) for n in range(45)]
    keys = [(n if n < 12 else rng.randrange(12), some(6), some(4)) for n in range(20)]
    left, right = spark.createDataFrame(rows, "id long, a long, b long"), spark.createDataFrame(keys, "key_id long, x long, y long")
    out = filters.any_key_join(left, right, "id", {"a": "x", "b": "y"})
    same = lambda p, q: p is not None and p == q
    assert sorted(map(tuple, out.collect())) == sorted({(i, k) for i, a, b in rows for k, x, y in keys if same(a, x) or same(b, y)})
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_pairs_of_one_value_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(filters, "BLOCK", 32, raising=False)
    monkeypatch.setattr(filters, "TASK_PAIRS", 4096, raising=False)
    # As with tables that are too large to be sent to each task.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left, right = spark.range(500).selectExpr("id", "id AS a", "7 AS b"), spark.range(300).selectExpr("id AS key_id", "id AS x", "7 AS y")
    out = filters.any_key_join(left, right, "id", {"a": "x", "b": "y"})
    try:
        assert out.distinct().count() == out.count() == 500 * 300
        most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert most < 500 * 300 / 8


def test_pairs_by_blocks_of_any_size(spark, monkeypatch):
    """Null and repeated ids on both sides, and pairs that several columns and values give."""
    monkeypatch.setattr(filters, "BLOCK", 2, raising=False)
    monkeypatch.setattr(filters, "TASK_PAIRS", 40, raising=False)
    rng = random.Random(8)
    some = lambda m: rng.choice([None, *range(m)])
    rows = [(None if n % 30 == 7 else rng.randrange(60), some(90), some(5), some(4)) for n in range(90)]
    keys = [(None if n % 30 == 7 else rng.randrange(30), some(90), some(5), some(4)) for n in range(50)]
    left, right = spark.createDataFrame(rows, "id long, a long, b long, c long"), spark.createDataFrame(keys, "key_id long, x long, y long, z long")
    out = filters.any_key_join(left, right, "id", {"a": "x", "b": "y", "c": "z"}).collect()
    want = {(r[0], k[0]) for r in rows for k in keys if any(p is not None and p == q for p, q in zip(r[1:], k[1:], strict=True))}
    assert {(i, None) for i, k in want if k is None} and {(None, k) for i, k in want if i is None}
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_cron_by_brute_force(spark):
    rng = random.Random(7)
    times = [datetime(2023, 12, 1) + timedelta(seconds=rng.randrange(150_000_000)) for _ in range(40)] + [datetime(2024, 2, 29, 12), datetime(2024, 2, 29, 11, 59), datetime(2024, 1, 5, 18, 45), datetime(2024, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    asked = {
        "*/15 8-18 * * MON-FRI": lambda d: d.weekday() < 5 and 8 <= d.hour <= 18 and d.minute % 15 == 0,
        "0 12 29 2 *": lambda d: (d.month, d.day, d.hour, d.minute) == (2, 29, 12, 0),
        "30 6 31 * *": lambda d: (d.day, d.hour, d.minute) == (31, 6, 30),
        "59 23 1 JAN,JUN *": lambda d: d.month in (1, 6) and (d.day, d.hour, d.minute) == (1, 23, 59),
        "0 0 31 2 *": lambda d: False,
    }
    for cron, fits in asked.items():
        for t, got in df.select("ts", schedule.next_cron(cron, F.col("ts"))).collect():
            d = t.replace(second=0) + timedelta(minutes=1)
            days = (d.replace(hour=0, minute=0) + timedelta(days=n) for n in range(1501))
            each = (x + timedelta(minutes=m) for x in days if any(fits(x + timedelta(minutes=m)) for m in (0, 390, 720, 1439, 480)) for m in range(1440))
            assert got == next((x for x in each if x >= d and fits(x) and (x - t).days <= 1501), None), (cron, t)
    # The first look is at a week, not at all the days to come.
    assert "7" in str(schedule.next_cron("0 0 * * *", F.col("ts"))).split("sequence")[1]


def test_index_is_built_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id long, text string")
    for stemmed in (False, True):
        assert "Exchange" not in plan(postings.listed(docs, ("the",), stemmed))


def test_runs_of_many_batches(spark, monkeypatch):
    """Runs and batches of a few words hold the same postings."""
    docs = spark.createDataFrame([(n, f"alpha w{n % 7} The Ünd beta{n}") for n in range(50)] + [(60, ""), (61, "x" * 300 + " alpha")], "id long, text string")
    rows = lambda out: sorted((t, x["id"], x["n_terms"], str(x["at"])) for b in out for t, held in zip(*b.to_pydict().values(), strict=True) for x in held)
    batches = docs.coalesce(1).toArrow().to_batches()
    whole = rows(postings._Runs(("the",))(iter(batches)))
    monkeypatch.setattr(postings, "RUN_BYTES", 64)
    monkeypatch.setattr(postings, "RUN_POSTINGS", 3)
    assert rows(postings._Runs(("the",))(iter(batches))) == whole and len(whole) == 50 * 4 + 2


def test_texts_are_looked_up_for_shown_rows(spark, sf, monkeypatch):
    journal = spark.createDataFrame([(n, f"alpha {n}", "k", n) for n in range(30)], "id long, text string, kind string, at long")
    index, seen, real = postings.build(journal, True), {}, chunk_search.saved
    monkeypatch.setattr(chunk_search, "saved", lambda df, tag: seen.setdefault(tag, df.columns) and real(df, tag))
    assert chunk_search.found_entries(journal, index, search.web_query("alpha"), 3).count() == 3
    assert "text" not in seen["journal-hits"]
    rows, _, _ = lexical._chunks(spark, sf)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_a_pair_of_blocks_gives_k_rows_a_query(spark, monkeypatch):
    """However many lots of rows a block has; ties go to the lesser id."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (90, 3)).astype(float)
    rows = [(0, 0, side, n, vectors[n].tolist()) for side in (0, 1) for n in range(90)]
    monkeypatch.setattr(vector_join, "ROWS_AT_ONCE", 7)
    batch = pa.RecordBatch.from_pylist([dict(zip(("i", "j", "side", "id", "vector"), r, strict=True)) for r in rows])
    got = sorted((r["query_id"], r["id"]) for b in vector_join._Best(4, 0.3)(iter([batch])) for r in b.to_pylist())
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1) > 0, np.linalg.norm(vectors, axis=1), 1)[:, None]
    each = unit @ unit.T
    want = [(q, r) for q in range(90) for _, r in sorted((-round(each[q, r], 9), r) for r in range(90) if r != q and each[q, r] >= 0.3)[:4]]
    rounded = lambda pairs: sorted((q, round(each[q, r], 9)) for q, r in pairs)
    assert rounded(got) == rounded(want) and len(got) == len(set(got))
