"""Chunk search with filters, without a vector, and without a query; people and journals."""

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import chunk_search, postings, search

ROWS = [
    # id, doc, index, text, vector, status, path, type, locator, sheet, first, last, created, updated, trust, desk, sensitivity
    (1, 1, 0, "alpha beta gamma", [1.0, 0.0], "active", "/A/x.TXT", "file", "page", None, 1, 2, 1, 10, 0.5, False, None),
    (2, 1, 1, "alpha alone here", [0.0, 1.0], "active", "/A/x.TXT", "file", "page", None, 3, 4, 1, 10, 0.5, True, None),
    (3, 2, 0, "beta runs alpha", [0.7, 0.7], "active", "/B/y", "email", "sheet", "S1", None, None, 5, 20, 0.0, False, "private"),
    (4, 3, 0, "nothing of it", None, "active", "/B/z", "email", "sheet", "S2", 7, 9, 9, 30, 1.0, False, None),
    (5, 4, 0, "alpha beta", [1.0, 0.0], "archived", "/A/w", "file", "page", None, 1, 1, 1, 40, 1.0, True, None),
]


def day(n):
    return F.timestamp_seconds(F.lit(86_400 * n))


def frame(spark):
    df = spark.createDataFrame(ROWS, "id long, doc long, chunk_index int, text string, embedding array<double>, status string, path string, source_type string, locator_kind string, sheet string, first_page int, last_page int, c int, u int, trust double, desk boolean, sensitivity string")
    return df.withColumns({"created_at": F.timestamp_seconds(F.col("c") * 86_400), "updated_at": F.timestamp_seconds(F.col("u") * 86_400)})


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark):
    return postings.build(frame(spark), stemmed=True)


@pytest.mark.parametrize(("wanted", "want"), [
    ({}, {1, 2, 3, 4}), ({"show_private": False}, {1, 2, 4}), ({"path": "a/X"}, {1, 2}), ({"source_type": "email"}, {3, 4}), ({"locator_kind": "sheet", "sheet": "S1"}, {3}), ({"sheet": "  "}, {1, 2, 3, 4}),
    ({"first_page": 2}, {1, 2, 4}), ({"first_page": 2, "last_page": 3}, {1, 2}), ({"after": 5}, {3, 4}), ({"before": 5}, {1, 2}),
])
def test_filters(spark, wanted, want):
    wanted = {k: day(v) if k in ("after", "before") else v for k, v in wanted.items()}
    assert set(ids(chunk_search.Wanted(**wanted).of(frame(spark)))) == want


def test_browse_mode(spark, index):
    got = chunk_search.found_chunks(frame(spark), index, None, None, day(50), 2, 1).collect()
    assert sorted(r["id"] for r in got) == [1, 3] and all(r["rank"] == 0 and not r["degraded"] for r in got)
    assert len(chunk_search.found_chunks(frame(spark), index, search.web_query("the of"), None, day(50), 9).collect()) == 4  # no words are no query


def test_words_alone_and_both(spark, index):
    query = search.web_query("alphas beta")
    words = {r["id"]: r for r in chunk_search.found_chunks(frame(spark), index, query, None, day(50)).collect()}
    assert set(words) == {1, 3} and all(r["degraded"] and r["vector"] is None for r in words.values()) and max(r["lexical"] for r in words.values()) == 1.0
    both = {r["id"]: r for r in chunk_search.found_chunks(frame(spark), index, query, [1.0, 0.0], day(50)).collect()}
    assert set(both) == {1, 2, 3} and both[2]["lexical"] is None and both[1]["vector"] == pytest.approx(1.0) and not both[1]["degraded"]
    recency = 2 ** (-40 / 30)
    assert both[1]["rank"] == pytest.approx(0.6 + 0.4 * both[1]["lexical"] + 0.1 * recency + 0.05)
    assert both[1]["snippet"] == "alpha beta gamma" and both[2]["snippet"] == "alpha alone here"
    near = chunk_search.found_chunks(frame(spark), index, None, [0.0, 1.0], day(50), 1).collect()
    assert [r["id"] for r in near] == [2]


def test_people(spark):
    rows = [(1, "Ann", ["@a"], None, 5), (2, "Joann", None, None, 9), (3, "Bob", ["ANN"], None, None), (4, "Cy", [], "knows ann", 7), (5, None, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, name string, handles array<string>, notes string, last_seen long")
    assert [(r["id"], r["how"]) for r in chunk_search.found_people(df, " ann ").collect()] == [(1, "name"), (3, "handle"), (2, "part"), (4, "notes")]
    assert chunk_search.found_people(df, "  ").count() == 0


def test_journal(spark):
    rows = [(1, "ran today", "day", 1), (2, "Running and running", "day", 3), (3, "run", "week", 2), (4, None, "day", 4)]
    df = spark.createDataFrame(rows, "id long, text string, kind string, at int")
    built = postings.build(df, stemmed=True)
    assert ids(chunk_search.found_entries(df, built, search.web_query("runs"), kinds=["day"])) == [2]
    assert sorted(ids(chunk_search.found_entries(df, built, search.web_query("runs")))) == [2, 3]
    late = chunk_search.found_entries(df, built, search.web_query(""), 2, before=F.lit(4)).collect()
    assert sorted(r["id"] for r in late) == [2, 3] and all(r["score"] == 0 for r in late)
