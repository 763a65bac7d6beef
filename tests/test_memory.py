"""Odd inputs of recall, intake, review and schedules."""

import datetime as dt
import math

from pyspark.sql import functions as F

from cairnlake.functions import schedule, scoring
from cairnlake.operators import intake, recall, review


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_recall_of_nothing_and_of_islands(spark):
    schema = "id long, tier string, embedding array<double>, strength double, felt double, age_days int, trust double, boost double, invalid boolean, mood double"
    edges = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    some = spark.createDataFrame([(1, "a", [1.0, 0.0], 1.0, 0.0, 0, 0.0, 0.0, False, 0.0), (2, "a", [0.0, 1.0], 1.0, 0.0, 0, 0.0, 0.0, True, 0.0), (3, "b", None, 1.0, 0.0, 0, 0.0, 0.0, False, 0.0)], schema)
    got = recall.tiered(some, [1.0, 0.0], edges, 5).collect()
    assert {r["id"]: round(r["score"], 6) for r in got} == {1: 1.1, 2: 0.001}
    assert recall.tiered(some.limit(0), [1.0, 0.0], edges, 5).count() == 0


def test_chunk_ranking_without_words(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, score double")
    facts = spark.createDataFrame([(1, 0.0, 0.0, False), (2, 0.0, 0.0, True)], "id long, recency double, trust double, desk boolean")
    got = recall.chunk_ranking(scores, scores.limit(0), facts, 5).collect()
    assert [(r["id"], round(r["score"], 6), r["lexical_score"]) for r in got] == [(2, 0.35, None), (1, 0.3, None)]


def test_first_of_equal(spark):
    df = spark.createDataFrame([(1, "k", "A  b"), (2, "k", " a b "), (3, "k", None), (4, "k", ""), (5, "j", "a b")], "id long, kind string, content string")
    assert [r[0] for r in rows(recall.first_of_equal(df, "kind", "content", F.col("id")))] == [1, 3, 4, 5]


def test_upsert_of_nulls(spark):
    held = spark.createDataFrame([(1, "a", None), (2, None, False), (3, "c", True), (4, "d", False)], "k long, v string, f boolean")
    new = spark.createDataFrame([(1, None), (2, None), (3, "x"), (5, "e")], "k long, v string")
    assert rows(intake.upserted(held, new, "k", "v", "f")) == [(1, None, "updated"), (2, None, "unchanged"), (3, "c", "kept"), (4, "d", "kept"), (5, "e", "inserted")]


def test_conflicts_of_copies(spark):
    held = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "ref long, content string")
    new = spark.createDataFrame([(1, "A\n"), (2, "b"), (4, "a"), (5, "z"), (6, "")], "ref long, content string")
    assert rows(intake.import_conflicts(held, new)) == [(1, "same"), (2, "conflict"), (4, "duplicate"), (5, "new"), (6, "duplicate")]


def test_violations(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id long, n long")
    assert rows(intake.violations(df, {"few": F.col("n") < 10, "some": F.col("n") > 9})) == [(2, 5, "some"), (3, 50, "few")]


def test_status_without_success(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "a", "failed", t, t), (2, "a", "running", t, None)], "run_id long, task_type string, status string, started_at timestamp, finished_at timestamp")
    assert rows(review.task_status(runs)) == [("a", "running", None, 1, 1)]


def test_claims_of_empty_texts(spark):
    turns = spark.createDataFrame([(1, None), (2, ""), (3, "I searched. I will not search! I searched")], "id long, text string")
    deeds = spark.createDataFrame([(4, "search")], "id long, tool string")
    got = review.unsupported_claims(turns, deeds, {"search": "search"}, "will")
    assert rows(got) == [(3, "search", "I searched"), (3, "search", "I searched")]


def test_hours_and_grid(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    one = spark.range(1)
    inside = [one.select(schedule.within_hours(at(f"2024-01-01 {h}"), w)).first()[0] for h, w in (("09:00", "09:00-17:00"), ("17:00", "09:00-17:00"), ("23:30", "22:00-06:00"), ("12:00", "x"), ("12:00", None), ("12:00", "25:00-26:00"))]
    assert inside == [True, False, True, True, True, True]
    grid = one.select(schedule.next_on_grid(at("2024-01-01 00:00"), F.lit(3600), at("2024-01-01 02:00")).alias("a"), schedule.next_on_grid(at("2024-01-02 00:00"), F.lit(3600), at("2024-01-01 02:00")).alias("b"), schedule.next_on_grid(at("2024-01-01"), F.lit(0), at("2024-01-02")).alias("c")).first()
    assert tuple(map(str, grid)) == ("2024-01-01 03:00:00", "2024-01-02 00:00:00", "None")


def test_scores_of_nulls(spark):
    none = F.lit(None).cast("double")
    got = spark.range(1).select(scoring.mood_match(none, none, F.lit(None).cast("string"), 0.0, 0.0, "calm"), scoring.cadence_minutes(none)).first()
    assert math.isclose(got[0], 0.5) and got[1] == 90.0
