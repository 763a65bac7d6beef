"""The pipeline's rows against brute force, stage by stage on its own input."""

import pytest
from brute import leaks, near, repeats

import corpus_pipeline
from cairnlake.llm import decontamination, language_id, ngram_join
from cairnlake.llm.common import saved

ENGLISH = "the river runs past the old mill and the people of the town walk there every evening"
ENTRY = "one two three four five six seven eight nine ten eleven"
ROWS = "doc_id long, text string, lang string, source string"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = saved(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs.count()
        if name != "mixing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert len(after) >= 0.95 * len(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for c, _ in near(list(before.items())).values()}
        elif name == "suffix_array_dedup":
            want = {d: n - gone for d, n, gone, _, _ in repeats(list(before.items()))}
            # A cut through a character takes its other bytes along.
            assert set(after) == set(want) and all(0 <= want[d] - len(t.encode()) <= 40 for d, t in after.items())
        elif name == "benchmark_decontamination":
            assert set(after) == {r[0] for r in leaks(list(before.items()), items) if not r[5]}
    got = docs.collect()
    size = {d: len((t or "").split()) for d, t in after.items()}
    assert sum(r["n_words"] for r in got) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    assert {d for r in got for d in r["doc_ids"]} <= {d for d, n in size.items() if n}
    assert all(len(r["text"].split(" ")) == r["n_words"] for r in got) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("block_bytes", [64 << 20, 40])
def test_clean_documents_by_row(spark, block_bytes):
    """Rows without a doc_id are searched too; a hit takes its own row only."""
    rows = [(None, f"x {ENTRY} y"), (None, ENGLISH), (3, ENTRY), (3, ENGLISH), (4, "alpha beta"), (None, "alpha, BETA"), (5, None), (None, None), (6, ENGLISH), (6, ENGLISH)]
    bench = spark.createDataFrame([(1, ENTRY), (2, "alpha beta"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "en", f"s{i}") for i, r in enumerate(rows)], ROWS)
    out = decontamination.clean_documents(docs, bench, block_bytes=block_bytes)
    assert out.columns == docs.columns and sorted(r["source"] for r in out.collect()) == ["s1", "s3", "s6", "s7", "s8", "s9"]


def test_known_language_by_row(spark):
    """Rows without a doc_id are judged too; a row stays by its own text only."""
    rows = [*((i, f"{ENGLISH} {i}") for i in range(100, 140)), (None, ENGLISH), (None, "123 456"), (None, None), (3, ENGLISH), (3, "%%% 77"), (4, "")]
    docs = spark.createDataFrame([(*r, "en", f"s{i}") for i, r in enumerate(rows)], ROWS)
    out = language_id.known_language(docs)
    assert out.columns == docs.columns and {r["source"] for r in out.collect()} == {f"s{i}" for i in [*range(41), 43]}
    assert language_id.known_language(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("text = ''")).count() == 0


def test_keep_one_by_row(spark):
    """Of each class of texts one row stays, whatever the rows' ids."""
    base = [f"{x}{i}" for x in "abcd" for i in range(80)]
    a, b, c, d = (" ".join(base[k : k + 80]) for k in range(0, 320, 80))
    rows = [(5, f"{a} tail"), (5, b), (2, a), (None, a), (None, c), (None, f"{c} tail"), (None, c), (None, None), (7, d), (7, d), (7, " "), (7, None), (9, f"{b} tail")]
    docs = spark.createDataFrame([(*r, "en", f"s{i:02d}") for i, r in enumerate(rows)], ROWS).repartition(3)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    got = {r["source"]: (r["doc_id"], r["text"]) for r in out.collect()}
    assert all(got[s] == rows[int(s[1:])] for s in got) and len(set(got) & {"s04", "s05", "s06"}) == 1
    assert set(got) - {"s04", "s05", "s06"} == {"s01", "s02", "s07", "s08", "s10", "s11"}
