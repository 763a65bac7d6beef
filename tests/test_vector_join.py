"""Blocked joins of vectors against numpy, in many blocks and in one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import vector_join, vectors

WIDTH = 6


def made(n, seed):
    x = np.round(np.random.default_rng(seed).normal(size=(n, WIDTH)), 1)
    x[n // 2] = 0
    x[1] = x[0]
    return x


def frame(spark, x, base=0):
    rows = [(base + k, [float(y) for y in v]) for k, v in enumerate(x)] + [(base + 900, None), (None, [1.0] * WIDTH), (base + 901, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def cosines(a, b):
    norm = lambda x: x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    return norm(a) @ norm(b).T


def brute(x, k, least):
    s, out = cosines(x, x), []
    dead = np.flatnonzero(~x.any(1))
    for q in range(len(x)):
        some = sorted((-round(s[q, j], 9), j) for j in range(len(x)) if j != q and j not in dead and q not in dead and s[q, j] >= least)
        out += [(q, j, r + 1) for r, (_, j) in enumerate(some[:k])]
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_of_all(spark, block_rows):
    x = made(40, 1)
    df = frame(spark, x)
    got = vector_join.nearest_of_all(df, df, 3, 0.1, block_rows=block_rows).collect()
    keyed = [(r["query_id"], r["id"], r["rank"]) for r in got if r["query_id"] < 900]
    want = brute(x, 3, 0.1)
    sims = cosines(x, x)
    # Equal similarities may differ in the last bit, so compare what was found by value.
    assert sorted((q, r) for q, _, r in keyed) == sorted((q, r) for q, _, r in want)
    by_want = {(q, r): j for q, j, r in want}
    assert all(abs(sims[q, j] - sims[q, by_want[q, r]]) < 1e-9 for q, j, r in keyed)
    assert vector_join.nearest_of_all(df.limit(0), df, 3).count() == 0 == vector_join.nearest_of_all(df, df.limit(0), 3).count()


def test_many_queries_leave_the_driver(spark, monkeypatch):
    df = frame(spark, made(40, 2))
    few = {(r["query_id"], r["rank"]): r["similarity"] for r in vectors.nearest_of_each(df, df, 2).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    many = vectors.nearest_of_each(df, df, 2)
    assert "vec_id" in df.columns and {k: pytest.approx(v) for k, v in few.items()} == {(r["query_id"], r["rank"]): r["similarity"] for r in many.collect()}


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_times_near(spark, block_rows):
    x, q = made(30, 3), made(12, 4)
    s = cosines(q, x)
    s[:, ~x.any(1)] = -2
    s[~q.any(1)] = -2
    got = {r["id"]: r["n"] for r in vector_join.times_near(frame(spark, x), frame(spark, q, 5000), 0.3, block_rows=block_rows).collect() if r["id"] < 900}
    assert got == {k: n for k, n in enumerate((s >= 0.3).sum(0).tolist()) if n}


def test_neighbourhoods_and_searches(spark):
    x = np.eye(WIDTH)[[0, 0, 1, 2, 3, 0]]
    rows = [(k, [float(y) for y in v], "active" if k != 5 else "archived", "embedded", None, "private" if k == 0 else None, f"m{k}", 0.5 if k == 1 else None) for k, v in enumerate(x)]
    memories = spark.createDataFrame(rows, "id long, embedding array<double>, status string, embedding_status string, valid_until timestamp, sensitivity string, content string, activation_boost double")
    held = spark.createDataFrame([(0, True, "2024-01-02"), (1, True, None), (2, True, "2024-01-01"), (3, False, None)], "id long, is_stale boolean, at string")
    now = F.lit("2024-02-01").cast("timestamp")
    held = held.select("id", "is_stale", F.col("at").cast("timestamp").alias("computed_at"))
    got = {r["id"]: dict(r["neighbours"]) for r in vector_join.renewed_neighbourhoods(memories, held, now, most=2).collect()}
    assert got == {1: {0: 1.0}, 2: {}}
    pending = spark.createDataFrame([(1, [1.0] + [0.0] * 5, "q1", "2024-01-01"), (2, [2.0] + [0.0] * 5, None, "2024-01-02"), (3, [0.0, 1.0] + [0.0] * 4, "q3", "2024-03-01")], "id long, embedding array<double>, asked string, at string")
    pending = pending.select("id", "embedding", "asked", F.col("at").cast("timestamp").alias("started_at"), F.col("at").cast("timestamp").alias("created_at"))
    boosts, notes = vector_join.resolved_searches(memories, pending, now)
    assert {r["id"]: round(r["activation_boost"], 6) for r in boosts.collect()} == {0: 0.9, 1: 1.0}
    assert [(r["search"], r["id"], r["note"]) for r in notes.collect()] == [(1, 1, 'Earlier I couldn\'t remember this: "q1". It came back to me — m1')]
    assert vector_join.resolved_searches(memories, pending, now, told_before=3)[1].count() == 0
