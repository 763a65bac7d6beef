"""Subgraphs, layers, carry-over, statistics and retention cycles on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import graph, retention, surface
from cairnlake.plans import passes


def brute_subgraph(edges, dead, seeds, depth, budget, rels):
    some = [(a, b, r, 1.0 if w is None else w) for a, b, r, w in edges if r in rels and a not in dead and b not in dead]
    best = {}

    def walk(node, d, weight, visited):
        if node not in best or d < best[node][0]:
            best[node] = (d, max(weight, best.get(node, (0, 0.0))[1]))
        else:
            best[node] = (best[node][0], max(weight, best[node][1]))
        if d < depth:
            for a, b, _, w in some:
                for x, y in ((a, b), (b, a)):
                    if x == node and y not in visited:
                        walk(y, d + 1, weight * w, visited | {y})

    for s in seeds:
        if s not in dead:
            walk(s, 0, 1.0, {s})
    kept = sorted(best.items(), key=lambda x: (x[1][0], -round(x[1][1], 9), x[0]))[:budget]
    names = {n for n, _ in kept}
    return {n: (d, round(w, 6)) for n, (d, w) in kept}, {(a, b, r, w) for a, b, r, w in some if a in names and b in names}


@pytest.mark.parametrize(("depth", "budget"), [(0, 5), (2, 500), (3, 4), (3, 9)])
def test_subgraph(spark, depth, budget):
    rng = random.Random(depth * 10 + budget)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice(["A", "B", "C"]), rng.choice([0.25, 0.5, 1.0, None])) for _ in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    dead, seeds = {3, 7}, [0, 3, 5]
    frame = spark.createDataFrame(edges, "src long, dst long, rel string, weight double")
    live = spark.createDataFrame([(n, n not in dead) for n in range(8)], "node long, alive boolean")
    nodes, between = graph.subgraph(frame, live, spark.createDataFrame([(s,) for s in seeds], "node long"), depth, budget, ["A", "B"])
    want, inner = brute_subgraph(edges, dead, seeds, depth, budget, ("A", "B"))
    assert {r["node"]: (r["depth"], round(r["relevance"], 6)) for r in nodes.collect()} == want
    assert {tuple(r) for r in between.collect()} == inner


def test_layers_of_a_long_chain_and_a_circle(spark):
    chain = [(k, k - 1) for k in range(1, 12)] + [(11, 3), (11, 0), (50, 51), (51, 50), (52, 51), (60, 99)]
    steps = spark.createDataFrame([(k,) for k in [*range(12), 50, 51, 52, 60, 60]], "step long")
    got = dict(map(tuple, graph.plan_layers(steps, spark.createDataFrame(chain, "step long, needs long")).collect()))
    assert got == {k: k for k in range(12)}
    assert graph.plan_layers(steps.limit(0), spark.createDataFrame([], "step long, needs long")).count() == 0


def test_dangling_keeps_repeated_and_null_ends(spark):
    edges = spark.createDataFrame([(1, 2), (1, 9), (1, 9), (None, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    assert sorted(map(str, map(tuple, graph.dangling(edges, nodes).collect()))) == ["(1, 9)", "(1, 9)", "(None, 2)"]


def test_carryover_at_under_and_over_the_budget(spark):
    turns = [("at", 0, "u", "abcd"), ("at", 1, "a", "ef"), ("under", 0, "u", "x"), ("over", 0, "u", "12345678"), ("over", 1, "a", "9"), ("long", 0, "u", "z" * 50), ("null", 0, "u", None), ("many", 0, "u", "a"), ("many", 1, "u", "b"), ("many", 2, "u", " c\n\t d ")]
    df = spark.createDataFrame([(*t, None) for t in turns] + [("old", 0, "u", "gone", "2020-01-01")], "session string, turn int, role string, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["session"]: (r["turns"], r["chars"], r["body"]) for r in surface.carryover(df, F.lit("2024-01-01").cast("timestamp"), most=2, max_chars=13, line_chars=40).collect()}
    assert got == {
        "at": (2, 13, "u: abcd\na: ef"), "under": (1, 4, "u: x"), "over": (1, 4, "a: 9"), "long": (1, 13, "u: " + "z" * 10), "null": (1, 3, "u: "), "many": (2, 11, "u: b\nu: c d"),
    }


def test_statistics_of_nothing_and_of_one(spark):
    schema = "source_type string, mode string, created_at timestamp, word_count long, extraction_count long, memory_count long, dedup_count long, llm_calls long, duration_seconds double, valence double, arousal double, intensity double"
    at = lambda x: F.lit(x).cast("timestamp")
    empty = spark.createDataFrame([], schema)
    one = json.loads(surface.ingestion_stats(empty, at("2024-01-01"), at("2024-02-01")).first()[0])
    assert one["total_ingestions"] == 0 and one["by_mode"] == {} and one["period_start"].startswith("2024-01-01")
    row = empty.unionByName(spark.sql("select null source_type, 'm' mode, timestamp'2024-01-02' created_at, 10L word_count, 0L extraction_count, 1L memory_count, 0L dedup_count, 2L llm_calls, 1.5D duration_seconds, 0.5D valence, null arousal, null intensity"), allowMissingColumns=True)
    told = json.loads(surface.ingestion_stats(row, at("2024-01-01"), at("2024-02-01")).first()[0])
    assert told["by_source_type"] == {"unknown": {"count": 1, "avg_words": 10.0, "avg_extractions": 0.0, "avg_duration": 1.5}} and told["dedup_stats"]["dedup_rate"] == 0.0
    plan = surface.ingestion_stats(row, at("2024-01-01"), at("2024-02-01"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Join" not in plan


def test_a_dry_run_changes_nothing_and_tells_what_would(spark, sf):
    state = passes._state(spark, sf)
    told = {r["measure"]: (r["before"], r["after"]) for r in retention.dry_run(state, passes._late(), capacity=40.0).collect()}
    assert told["active"][0] > told["active"][1] and told["mass"][1] <= 40.0 < told["mass"][0]
    assert {r["measure"]: r["amount"] for r in retention.status(state, passes._late()).collect()} == {k: v[0] for k, v in told.items()}
    kept = retention.gc_pass(state, passes._late(), capacity=1.0, irreversible=False)
    assert kept is state
    # Groups under review are left, and without a budget nothing is put up for review.
    rested = retention.rest_pass(state, passes._late(), budget=0)
    assert rested.reviews.filter("episode <> 3").count() == 0
    assert rested.memories.filter("episode = 3 and superseded_by < 0").count() == 0
    gists = rested.memories.filter("id < 0").collect()
    merged = rested.memories.filter("status = 'archived' and superseded_by < 0").groupBy("superseded_by").agg(F.count("*").alias("n")).collect()
    assert {r["id"]: r["content"].count("\n\n---\n\n") + 1 for r in gists} == {r["superseded_by"]: r["n"] for r in merged}


def test_paths_are_cut_hop_by_hop(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(30)})
    weight = {e: rng.choice([0.5, 1.0]) for e in edges}
    df = spark.createDataFrame([(a, b, weight[a, b]) for a, b in edges], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(0,), (4,), (77,)], "node long")
    rows = graph.paths(df, seeds, 4).collect()
    for most in (1, 5, 20):
        want = []
        for seed in (0, 4):
            mine = sorted((r["depth"], -r["weight"], ">".join(map(str, r["path"]))) for r in rows if r["seed"] == seed)
            want += [(seed, p) for *_, p in mine[:most]]
        got = surface.context_paths(df, seeds, 4, most).collect()
        assert sorted((r["seed"], r["path"]) for r in got) == sorted(want)
