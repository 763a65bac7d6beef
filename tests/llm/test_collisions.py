"""Texts made to collide under hashes modulo powers of two, and texts that are hard on memory."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near, repeats

import corpus_pipeline
from cairnlake.llm import bytehash, decontamination, ngram_join, suffix_dedup

#: 1024 bytes over two letters, and the same with the letters changed round.
A = "".join("ab"[i.bit_count() & 1] for i in range(1024))
B = A.translate(str.maketrans("ab", "ba"))


def rows(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_hashes_tell_thue_morse_words_apart():
    data = np.frombuffer((A + B).encode(), np.uint8)
    for kind in (0, 1):
        sums = bytehash.Prefix(data, kind)
        one, two = sums.substring(np.array([0, 1024]), np.array([1024, 2048]))
        assert one != two
        assert len({int(sums.lane(k, np.array([x]), np.array([x + 1024]))[0]) for k in (0, 1) for x in (0, 1024)}) == 4


@pytest.mark.parametrize("kind", [0, 1])
def test_hashes_are_polynomials(kind):
    rng = random.Random(kind)
    data = np.array([rng.randrange(256) for _ in range(300)], np.uint8)
    sums = bytehash.Prefix(data, kind)
    for k in (0, 1):
        lane = sums.lanes[k]
        base, table = bytehash.BASES[lane], bytehash._table(lane).tolist()
        for start, end in ((0, 0), (0, 300), (17, 18), (100, 251)):
            want = sum(table[data[i]] * pow(base, i - start, bytehash.P) for i in range(start, end)) % bytehash.P
            assert int(sums.lane(k, np.array([start]), np.array([end]))[0]) == want
    part = bytehash.Prefix(data[50:90].copy(), kind)
    assert part.substring(np.array([0]), np.array([40]))[0] == sums.substring(np.array([50]), np.array([90]))[0]


def test_jaccard_keeps_them_apart(spark):
    texts = [(1, A), (2, B), (3, A), (4, f"{A} {B} x y z"), (5, f"{B} {A} x y z")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_groups(rows(spark, texts)).collect()}
    assert got == near(texts) == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0), 5: (5, 0)}
    assert {r["doc_id"] for r in ngram_join.keep_one(rows(spark, texts)).collect()} == {1, 2, 4, 5}


def test_shingles_of_equal_hash_are_told_apart(monkeypatch):
    """The second hash decides where the first one fails."""
    real = ngram_join.shingles
    monkeypatch.setattr(ngram_join, "shingles", lambda *x, kind=0: (real(*x)[0] * np.uint64(0), real(*x)[1]) if kind == 0 else real(*x, kind=kind))
    data, at = bytehash.flat(pa.array(["a b c d e f", "a b c d e g", "q"]))
    number, first = ngram_join._numbered(data, at)
    assert first.tolist() == [0, 2, 4, 5] and number[0] == number[2] and len(set(number.tolist())) == 4


def test_benchmark_items_are_told_apart(spark):
    items = spark.createDataFrame([("1", A), ("2", B)], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.find_benchmark(rows(spark, [(1, A), (2, B), (3, "c")]), items).collect()}
    assert got == {1: ["1"], 2: ["2"], 3: []}
    only = items.filter("item_id = '1'")
    assert {r["doc_id"] for r in decontamination.clean_documents(rows(spark, [(1, A), (2, B)]), only).collect()} == {2}


def test_windows_with_equal_hashes(monkeypatch):
    """With a hash that is the same for all words, characters decide alone."""
    real = decontamination.word_hashes

    def flat_hash(data, at, kinds):
        words, *rest = real(data, at, kinds)
        return words * np.uint64(0), *rest

    monkeypatch.setattr(decontamination, "word_hashes", flat_hash)
    items = [("i", "one two three"), ("j", "two one three"), ("k", "One two, three"), ("l", "three"), (None, "x")]
    tables = decontamination.Tables(items, 3)
    texts = ["so one two three it is", "two one three", "", "three three", "nothing"]
    counts, opens, closes, text, number = tables.occurrences(*bytehash.flat(pa.array(texts)))
    assert counts.tolist() == [6, 3, 0, 2, 1]
    assert list(zip(opens.tolist(), closes.tolist(), strict=True)) == [(1, 4), (6, 9), (9, 11)]
    found = sorted((t, tables.names[n]) for t, n in zip(text.tolist(), number.tolist(), strict=True))
    assert found == [(0, "i"), (0, "k"), (0, "l"), (1, "j"), (1, "l"), (3, "l")]


def test_one_word_item_in_a_long_text(spark):
    """Half a million occurrences in one text, and spans over two blocks of the benchmark."""
    texts = [(1, "the cat " * 500_000), (2, "no"), (3, "A " + "w" * 5000 + " the")]
    items = [("x", "The"), ("y", "cat the " * 5), ("z", "w" * 5000), ("w", "w" * 4999 + "v")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 24, 4000):
        got = {r["doc_id"]: r.asDict() for r in decontamination.find_benchmark(rows(spark, texts), frame, block_bytes=block).collect()}
        assert [tuple(x) for x in got[1]["hits"]] == [(0, 999_999)] and got[1]["n_words"] == 1_000_000
        assert got[1]["items"] == ["x", "y"] and got[3]["items"] == ["x", "z"] and [tuple(x) for x in got[3]["hits"]] == [(1, 3)] and not got[2]["hits"]


def test_string_ids(spark):
    frame = spark.createDataFrame([("x1", "one two"), ("x2", "two"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([("i", "one")], "item_id string, text string")
    assert {(r["doc_id"], len(r["hits"])) for r in decontamination.find_benchmark(frame, items).collect()} == {("x1", 1), ("x2", 0), (None, 0)}


def test_leaks_of_random_texts(spark):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "Dd", "é1"]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 14])))) for k in range(12)]
    texts = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(60)]
    for block in (1 << 24, 60):
        found = decontamination.find_benchmark(rows(spark, texts), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block).collect()
        got = sorted((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), tuple(r["items"])) for r in found)
        want = sorted((d, n, hit, tuple(found)) for d, n, hit, found in leaks_with_items(texts, items))
        assert got == want
        assert all(a["end"] < b["start"] for r in found for a, b in zip(r["hits"], r["hits"][1:], strict=False))


def leaks_with_items(texts, items):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    for d, text in texts:
        words, hit, names = low(text), set(), set()
        for name, item in items:
            w = low(item)
            for window in ([w[i : i + 10] for i in range(len(w) - 9)] or [w]) if w else []:
                for i in range(len(words) - len(window) + 1):
                    if words[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        names.add(name)
        yield d, len(words), len(hit), sorted(names, key=str.encode)


def test_suffix_dedup_keeps_them_apart(spark):
    tail = "0123456789" * 30
    texts = [(1, A), (2, B), (3, "x" + A[:400]), (4, tail + A), (5, tail + B)]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(rows(spark, texts)).selectExpr(
        "doc_id", "n_bytes", "aggregate(removed, 0L, (s, x) -> s + x.end - x.start)", "cast(size(removed) as long)", "kept_sha256").collect())
    assert got == sorted(repeats(texts))


def test_pipeline_stages_keep_them_apart(spark):
    frame = spark.createDataFrame([(1, A, "en", "s", 1024), (2, B, "en", "s", 1024)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["ngram_jaccard_join"](spark, frame, "").count() == 2
    left = {r["doc_id"]: len(r["text"]) for r in stages["suffix_array_dedup"](spark, frame, "").collect()}
    assert left == {d: n - gone for d, n, gone, *_ in repeats([(1, A), (2, B)])}


def test_large_texts_are_chunked_by_bytes(spark, monkeypatch):
    """Near copies of a megabyte and more in chunks of few bytes give the same classes."""
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 300_000)
    base = [f"w{i}" for i in range(40_000)]
    texts = [(k, " ".join([*base[: 20_000 + k], f"own{k}", *base[20_000 + k :]])) for k in range(6)] + [(9, "short text")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_groups(rows(spark, texts)).collect()}
    assert got == near(texts) and got[0] == (0, 5)


def test_other_operators_keep_the_type_of_ids(spark):
    from cairnlake.llm import language_id, line_dedup, weak_quality

    frame = spark.createDataFrame([("x1", "one two. three"), ("x2", None), (None, "one two. three")], "doc_id string, text string")
    for out in (weak_quality.score_quality(frame), line_dedup.repeated_units(frame, ("line",), 1), language_id.identify(frame, None)):
        assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["None", "x1", "x2"]
    spans = {r["doc_id"]: len(r["removed"]) for r in line_dedup.repeated_units(frame, ("line",), 1).collect()}
    assert spans == {"x1": 0, "x2": 0, None: 1}


def test_archives_stay_small(spark, tmp_path, monkeypatch):
    from cairnlake.llm import warc

    monkeypatch.setattr(warc, "MOST_BYTES", 1 << 20)
    monkeypatch.setattr(warc, "SMALL", 1 << 14)
    rng = random.Random(1)
    html = lambda n: "".join(chr(rng.randrange(33, 1000)) for _ in range(n))
    pages = [(k, f"http://h{k}.org/", html(n)) for k, n in enumerate([10] * 90 + [20_000] * 40 + [90_000] * 12 + [900_000])] + [(500, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_captures(df, f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").glob("*.gz"), key=lambda f: f.stat().st_size)
    # All but the one payload over the limit are in archives under it.
    assert files[-2].stat().st_size < 1 << 20 < files[-1].stat().st_size and len(files) > 5
    records = warc.read_records(spark, f"file://{tmp_path}/out")
    assert warc.transactions(records).count() == len(pages)


def test_rows_without_ids_are_spread(spark):
    from pyspark.sql import functions as F

    from cairnlake.llm import mixing
    from cairnlake.llm.common import saved

    rows = spark.range(0, 30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("two words").alias("text"), F.lit(2).cast("long").alias("size"), F.xxhash64("id").alias(mixing.SPREAD))
    sources = mixing._sources(rows.drop(mixing.SPREAD), (1.0,), 1.5, 2.0)
    known = saved(rows, "spread")
    places = mixing._packed(known, sources, 7).select("start").collect()
    assert len({r["start"] for r in places}) == 30_000 and max(r["start"] for r in places) == 59_998
    bins = F.pmod(F.xxhash64(F.lit(7), "doc_id", "size", mixing.SPREAD), F.lit(8))
    assert max(r["count"] for r in known.groupBy(bins).count().collect()) < 5000
    texts = known.drop(mixing.SPREAD).withColumn("text", F.monotonically_increasing_id().cast("string"))
    assert len({r["start"] for r in mixing._packed(saved(texts, "spread"), sources, 7).select("start").collect()}) == 30_000
