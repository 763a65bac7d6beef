"""The operators' queries against brute force, on given tables and on odd ones."""

import gzip
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pytest
from brute import leaks, near, passages, quality, repeats, told, weak_posteriors, weak_statistics

from cairnlake.llm import bytehash, decontamination, language_id, line_dedup, mixing, ngram_join, quality_rules, suffix_dedup, url_filters, warc, weak_quality
from cairnlake.llm.common import words, word_count

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, component long, links long, removed string, th int"
LONG = " ".join(f"w{i % 977}x{i * i % 1013}" for i in range(30_000))
BASE = " ".join(f"term{i}" for i in range(120))
NEAR = BASE.replace("term60 ", "other ")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, BASE), (7, NEAR), (8, BASE), (9, LONG), (10, LONG + " tail"),
    (11, "é" * 300), (12, "é" * 300), (13, "ab" * 400), (14, "x\n\nx\nX\n" + "same line of five words\n" * 3), (15, "Same  line of five words"),
    (16, "%%% ### *** $$$"), (17, "123 456"), (18, "no\u00a0break \U0001f600 smile"),
]


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def odd(spark, rows=ODD):
    return spark.createDataFrame([(d, t, "en", "a" if d % 3 else None, len(t or ""), "k", 1, 2, "r", 3) for d, t in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark, sf):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_words(spark):
    df = odd(spark)
    for r in df.select("text", words(df["text"]).alias("w"), word_count(df["text"]).alias("n")).collect():
        assert len(r["w"]) == r["n"] == quality(r["text"])[0]


def test_quality_statistics(spark, sf, docs):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality_rules.op1_quality_rules(spark, sf)
    assert rows_of(out, *columns) == sorted((d, *quality(t)) for d, t in docs)
    labels = spark.createDataFrame([(6, 1), (9, 1), (None, 0), (13, None)], "doc_id long, quality int")
    judged, rules = quality_rules.judge(odd(spark), labels)
    assert rows_of(judged, *columns) == sorted((d, *quality(t)) for d, t in ODD)
    assert not rules and all(r["kept"] != r["base_failed"] for r in judged.collect())
    assert quality_rules.judge(odd(spark).limit(0), labels.limit(0))[0].count() == 0


def test_quality_rules_learn(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.op1_quality_rules(spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert sum((r["quality"] == 1) == r["kept"] for r in got) >= 0.95 * len(got) and labels.count()


def test_near_copies(spark, sf, docs):
    assert {r[0]: r[1:] for r in rows_of(ngram_join.op4_ngram_jaccard_join(spark, sf), "doc_id", "class_id", "n_links")} == near(docs)
    assert {r[0]: r[1:] for r in rows_of(ngram_join.jaccard_groups(odd(spark)), "doc_id", "class_id", "n_links")} == near(ODD)
    kept = ngram_join.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and {r["doc_id"] for r in kept.collect()} == {c for c, _ in near(ODD).values()}
    assert ngram_join.jaccard_groups(odd(spark).limit(0)).count() == 0


def test_near_copies_in_chunks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(200) if k != 3 * (i % 17) + 20) + f" end{i % 29}") for i in range(300)]
    monkeypatch.setattr(ngram_join, "CHUNK", 32)
    monkeypatch.setattr("cairnlake.llm.common.LEAST_HOT", 11)
    got = {r[0]: r[1:] for r in rows_of(ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links")}
    assert got == near(rows)


def test_chain_of_loose_copies(spark):
    """Neighbours share two thirds of their text: no links, and few groups to verify."""
    rows = [(i, " ".join(f"w{k}" for k in range(20 * i, 20 * i + 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.jaccard_groups(df), "doc_id", "class_id", "n_links") == [(i, i, 0) for i, _ in rows]
    keyed = df.selectExpr("doc_id", "unhex(md5(text)) as key", "text")
    signed = keyed.mapInArrow(ngram_join._signatures, "key binary, values binary, bands array<bigint>")
    assert ngram_join._near(signed.selectExpr("*", "xxhash64(key) as node")).count() <= len(rows) // 20


def test_near_copies_of_odd_rows(spark):
    """Null and repeated ids, repeated rows and columns of clashing names."""
    rows = [(None, BASE), (None, NEAR), (7, BASE), (7, LONG), (7, LONG), (None, None), (7, "")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, copies int")
    got = sorted(((r["doc_id"] or 0, r["n_links"]) for r in ngram_join.jaccard_groups(df).collect()), key=str)
    assert got == sorted([(0, 2), (0, 2), (7, 2), (7, 1), (7, 1), (0, 0), (7, 0)], key=str)


def test_repeated_bytes(spark, sf, docs):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffix_dedup.op10_suffix_array_dedup(spark, sf), *columns) == sorted(repeats(docs))
    out = suffix_dedup.remove_repeats(odd(spark)).collect()
    got = sorted((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in out)
    assert got == sorted(repeats(ODD))
    assert suffix_dedup.remove_repeats(odd(spark).limit(0)).count() == 0
    assert suffix_dedup.without_repeats(odd(spark)).columns == odd(spark).columns


@pytest.mark.parametrize("most", [0, 16_384])
def test_repeated_bytes_of_hot_keys(spark, monkeypatch, most):
    """Many texts round one shared passage: by sorting, and counted one by one."""
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", most)
    shared = "".join(chr(97 + i * i * 7 % 26) for i in range(260))
    rows = [(i, f"{i:04d}" * (i % 9) + shared[i % 40 :] + f"{i * 7919:09d}" * (i % 5)) for i in range(120)] + [(500, "periodic " * 90), (None, shared), (501, shared), (501, shared)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in out]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(repeats(rows), key=key)


def test_repeated_bytes_of_colliding_rows(spark):
    """Rows that share an id, or have none, and a 32-bit hash of their texts."""
    from pyspark.sql import functions as F

    seen, pair = {}, None
    texts = spark.range(400_000).select(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("x" * 3)).alias("t")).select("t", F.hash("t").alias("h"))
    for t, h in texts.toPandas().itertuples(index=False):
        if h in seen:
            pair = (seen[h], t)
            break
        seen[h] = t
    tail = "".join(chr(97 + i * i * 7 % 26) for i in range(253))
    # Equal ends after equal lengths keep the hash equal.
    a, b = (x + tail for x in pair)
    rows = [(None, a), (None, b[:150] + "?"), (7, "zz" + a), (7, b), (7, None), (8, ""), (8, "")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, key int, th string")).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in out]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(repeats(rows), key=key)


def test_repeated_bytes_in_pieces(spark, monkeypatch):
    """A long text is listed in pieces; where they are cut makes no difference."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    long = "".join(chr(97 + (i * i * 7 + i // 31) % 26) for i in range(5_000))
    rows = [(1, long), (2, long[1200:2600]), (3, "y" * 90 + long[690:910]), (4, long[3000:3199]), (5, "ab" * 900)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in out) == sorted(repeats(rows))


def test_benchmark_windows(spark, sf, docs, items):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontamination.op9_decontamination(spark, sf), *columns) == sorted(leaks(docs, items))


def test_words_in_segments(monkeypatch):
    """Hashes of words do not depend on where a long text is cut."""
    import numpy as np

    text = (" ".join("x" * (i * i % 90) + str(i) for i in range(900)) + " " + "long" * 3000 + " end").encode()
    data, at = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), len(text), 2 * len(text)])
    want = bytehash.word_hashes(data, at)
    monkeypatch.setattr(bytehash, "SEGMENT", 1000)
    assert all((a == b).all() for a, b in zip(want, bytehash.word_hashes(data, at), strict=True))


def test_no_benchmark(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_benchmark(docs, none).filter("size(hits) > 0 or size(items) > 0").count() == 0
    assert decontamination.find_benchmark(docs.limit(0), none).count() == 0
    out = decontamination.clean_documents(docs, none)
    assert out.columns == docs.columns and out.count() == len(ODD)
    rows = [(None, "alpha beta"), (None, "gamma"), (3, "alpha beta"), (3, "alpha beta"), (3, None)]
    found = decontamination.find_benchmark(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, hits int"), spark.createDataFrame([(None, "Alpha, beta")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["items"] == [""]) for r in found) == [(0, 1, False), (0, 2, True), (3, 0, False), (3, 2, True), (3, 2, True)]


@pytest.mark.parametrize("block_bytes", [64 << 20, 40])
def test_benchmark_windows_of_odd_texts(spark, block_bytes):
    bench = [(1, "One, TWO"), (2, "w"), (3, None), (4, "..."), (5, BASE[:200]), (6, "one two"), (10, "caf\u00e9 \u2014 x")]
    texts = [*ODD, (30, "one two one-two ONE.TWO"), (31, "w w w"), (32, "Caf\u00e9 \u2014 X")]
    found = decontamination.find_benchmark(odd(spark, texts), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes)
    got = sorted((r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), len(r["items"])) for r in found.collect())
    assert got == sorted(x[:4] for x in leaks(texts, bench))


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.op2_mixing(spark, sf).collect()
    again = rows_of(mixing.op2_mixing(spark, sf), "doc_id", "taken")
    assert again == sorted((r["doc_id"], r["taken"]) for r in got) and len(got) == docs.count()
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = sources[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(size.values()), set(order), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 2 * size[s]}
        if not over:
            want |= {s: left * weights[s] / total for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 260 + 0.02 * want[s]


def test_mix_of_odd_tables(spark):
    from pyspark.sql import functions as F

    sized = odd(spark).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixing.plan_mix(sized)
    got = mixing.taken_words(mix).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.taken_words(mixing.plan_mix(sized.limit(0))).count() == 0
    assert mixing.taken_words(mixing.plan_mix(sized.filter("size = 0"))).filter("taken <> 0").count() == 0
    texts = odd(spark).select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    blocks = mixing.mixed_blocks(mixing.plan_mix(texts)).collect()
    assert sum(r["n_words"] for r in blocks) == sum(r["taken"] for r in got)
    assert all(len(r["text"].split(" ")) == r["n_words"] for r in blocks)
    # The words of each document in the mix are those that are counted.
    mine = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in ODD}
    assert all(w in {x for d in r["doc_ids"] for x in mine[d]} for r in blocks for w in r["text"].split(" "))
    clash = sized.withColumns({c: F.lit(1) for c in ("start", "target", "blocks", "_words", "slots")})
    assert rows_of(mixing.taken_words(mixing.plan_mix(clash)), "doc_id", "taken") == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_of_small_sources(spark):
    """Sources of less than a block meet their targets; repeated rows and null ids."""
    sized = spark.createDataFrame([(1, "a", 100), (2, "b", 100), (3, "c", 60), (3, "c", 40), (None, "c", None)], "doc_id long, source string, size long")
    got = mixing.taken_words(mixing.plan_mix(sized)).collect()
    by = defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3}[r["source"]])
    assert len(got) == 5 and dict(by) == {"a": 200, "b": 83, "c": 167}


def test_mix_by_brute_force(spark):
    """Slots, permutations and words of the plan: every slot's block is a real one,
    epochs are whole permutations, and ``taken`` is what walking the slots gives."""
    rows = [(i, "abc"[i % 3] if i % 10 else None, (i * 37) % 900) for i in range(160)]
    mix = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    docs, picks = mix.docs.collect(), sorted(mix.picks.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in picks] == list(range(len(picks)))
    words = defaultdict(dict)
    for r in docs:
        words[r["source_no"]] |= {k: r["doc_id"] for k in range(r["start"], r["start"] + r["size"])}
    taken, times, length = defaultdict(int), defaultdict(lambda: defaultdict(int)), {r["source_no"]: r["n_block"] for r in docs}
    for r in picks:
        no, n = r["source_no"], length[r["source_no"]]
        times[no][r["block"]] += 1
        for k in range(r["block"] * n, r["block"] * n + (r["n_take"] or n)):
            if k in words[no]:
                taken[words[no][k]] += 1
    for no, w in words.items():
        assert sorted(w) == list(range(len(w)))
        epochs = sorted(times[no].get(b, 0) for b in range(-(-len(w) // length[no])))
        assert sum(epochs) == sum(times[no].values()) and epochs[-1] - epochs[0] <= 1
    assert {r["doc_id"]: r["taken"] for r in mixing.taken_words(mix).collect()} == {d: taken[d] for d, _, _ in rows}
    # No tail: in either half of the slots a source has its share.
    half = len(picks) // 2
    for no in words:
        first = sum(r["source_no"] == no for r in picks[:half])
        assert abs(first - sum(times[no].values()) / 2) <= 5 * len(picks) ** 0.5 / 2


def test_targets_of_many_sources(spark):
    """The level found round by round gives the targets of the rule itself."""
    rows = [(i, f"s{i:04d}", (i * i * 7919) % 5000 // (1 + i % 13)) for i in range(700)]
    got = {r["source"]: r["target"] for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).docs.collect()}
    size = {s: n for _, s, n in rows}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    left, free, want = 1.5 * sum(size.values()), set(size), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}:
        want |= {s: 2 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert got == pytest.approx(want)


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


def test_urls(spark):
    from pyspark.sql import functions as F

    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/71", "https://a.example.com/en/8", "http://x.net/de/1?x#y", "http://example.net/de/8", "ftp://x.org#/es/", "http://x.org/es/", "http://www.spam-farm.io/a", "http://notorg/es/", "http://com/en/", "http://casino-win.biz?x", "http://a/b/adserver/c", "u://h\n/p", "http://a.io/casino-win/x", "http://www.FREE.bets.com", "http://mycasinos.net/fr/"]
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages.select("page_id", F.col("url"))).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/71", "example.com/en/7", "allow") == got[18]
    assert got[4] == ("a.example.com", "/en/8", "com/en/", "block") and got[5][2:] == ("net/de/", "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7] == ("x.org", "", None, "allow") and got[8][2:] == ("org/es/", "block")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][2:] == ("com/en/", "block")
    assert got[12][2:] == got[13][2:] == got[16][2:] == (None, "block") and got[14][:2] == ("h\n", "/p")
    assert got[15][2:] == got[17][2:] == (None, "allow")
    with pytest.raises(ValueError):
        url_filters.pattern_hits(pages, (url_filters.PatternRule("all", "x", ()),))
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    long = "a\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(3, "http://a/x", long), (1, "http://b\r\n/", long), (2, None, "short"), (4, "http://c/?q#f", "short"), (5, "", None), (None, "http://n/", long), (6, "http://u/", "é" * 60), (7, "http://u/", "é" * 60), (1, "http://b\r\n/", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_captures(df, f"file://{tmp_path}/out")
    records = warc.read_records(spark, f"file://{tmp_path}/out")
    found = warc.transactions(records).collect()
    assert records.count() == 3 * len(pages) and len(found) == len(pages)
    assert all(r["request"] and r["metadata"] for r in found)
    got = sorted((r["metadata"]["page_id"] or 99, r["response"]["record_type"], r["refers_to"], r["response"]["payload_bytes"]) for r in found)
    n = len(long)
    assert got == [(1, "response", None, n), (1, "response", None, n), (2, "response", None, 5), (3, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 120), (7, "revisit", 6, 120), (99, "revisit", 1, n)]
    assert {bytes(r["response"]["payload"]).decode() for r in found if r["response"]["record_type"] == "response"} == {long, "short", "", "é" * 60}
    warc.write_captures(df.limit(0), f"file://{tmp_path}/none")
    assert warc.transactions(warc.read_records(spark, f"file://{tmp_path}/none")).count() == 0


def test_warc_files_of_others():
    """Plain, whole-file gzip and one member a record; a cut file is an error."""
    one = lambda i, body: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    parts = [one(1, b"abc"), one(2, b""), one(3, b"\r\n\r\nWARC/1.0\r\n" * 9_000)]
    want = [len(b) for b in (b"abc", b"", b"\r\n\r\nWARC/1.0\r\n" * 9_000)]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [len(block) for _, block in warc.parse(data)] == want
    with pytest.raises((ValueError, EOFError, zlib.error)):
        list(warc.parse(b"".join(parts)[:-40]))


def spans_of(df):
    return {r["doc_id"]: (r["n_units"], [(x["start"], x["end"]) for x in r["removed"]]) for r in df.collect()}


def test_lines(spark):
    line = {"kinds": ("line",), "least_words": 5}
    got = spans_of(line_dedup.repeated_units(odd(spark), **line))
    assert got[14][0] == 3 and len(got[14][1]) == 2 and got[15] == (1, [(0, 24)])
    assert got[8][1] == [(0, len(BASE))] and got[6][1] == [] and got[1] == got[2] == (0, [])
    cut = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_units(odd(spark), **line).collect()}
    assert cut[8] == "" and cut[6] == BASE and cut[1] is None and cut[14].count("same line") == 1
    assert line_dedup.repeated_units(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_units(odd(spark), kinds=("page",))


@pytest.mark.parametrize(("kinds", "least"), [(("line", "paragraph"), 25), (("paragraph",), 3), (("block",), 1), (("line", "block", "paragraph"), 5)])
def test_passages(spark, docs, kinds, least):
    """Against brute force: the given table, and texts that overlap their own copies."""
    passage = "Here begins a passage. It has some sentences! Are they units? They are, if long enough."
    more = [(20, f"half a sentence {passage} and on it goes"), (21, f"other start {passage}\n\n{passage}"), (22, "Again. " * 40), (23, "One. Two. " * 30), (24, f"x\n\n{passage.upper()}\n  \ny")]
    for rows in ([*ODD, *more], docs):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert spans_of(line_dedup.repeated_units(df, kinds, least)) == {d: (n, some) for d, n, some in passages(sorted(rows), kinds, least)}


def test_lines_of_a_hot_digest(spark, monkeypatch):
    """A line that most rows share is dealt to several tasks, with the same result."""
    monkeypatch.setattr("cairnlake.llm.common.LEAST_HOT", 7)
    rows = [(i, f"a line that nearly all rows share\nrow {i % 50} has a line of its own") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans_of(line_dedup.repeated_units(df, ("line",), 5))
    assert got == {d: (n, some) for d, n, some in passages(rows, ("line",), 5)} and got[0][1] == [] and len(got[60][1]) == 2


@pytest.mark.parametrize("least_words", [1, 5])
def test_lines_of_rows_that_share_an_id(spark, least_words):
    """Null ids, repeated ids and equal rows: every row has its own spans."""
    line, other = "the same line of six words", "another line that occurs just once"
    rows = [(None, f"{line}\n{other}"), (None, f"{line}\nshort"), (None, f"{other} more\nshort\n{line}"), (7, f"x\n{line}"), (7, f"clean text under a shared id\n{line}"), (8, other), (8, other), (None, None), (9, "")]
    units = [[(m.lower(), m) for m in (t or "").split("\n") if len(m.split()) >= least_words] for _, t in rows]
    again = sum(map(len, units)) - len({u for some in units for u, _ in some})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.repeated_units(df, ("line",), least_words).collect()
    assert sorted((str(r["doc_id"]), r["n_units"]) for r in out) == sorted((str(d), len(u)) for (d, _), u in zip(rows, units, strict=True))
    assert sum(len(r["removed"]) for r in out) == again and all(len(r["removed"]) <= r["n_units"] for r in out)
    assert sorted(len(r["removed"]) for r in out if r["doc_id"] == 8) == [0, 1]
    cut = [(r["doc_id"], r["text"]) for r in line_dedup.without_repeated_units(df, ("line",), least_words).collect()]
    left = "\n".join(t or "" for _, t in cut).split("\n")
    assert len(cut) == len(rows) and [left.count(x) for x in (line, other, f"{other} more", "clean text under a shared id")] == [1] * 4
    assert left.count("short") == (1 if least_words == 1 else 2) and left.count("x") == 1
    assert next(t for d, t in cut if d == 7 and t.startswith("x")) == f"x\n{line}"


def test_language(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    net = language_id.learn(docs)
    got = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in language_id.identify(docs, None).collect())
    found = {r["doc_id"]: r for r in language_id.identify(odd(spark), net).collect()}
    assert len(found) == len(ODD) and {d for d, r in found.items() if r["lang_pred"] == "und"} == {1, 2, 3, 16, 17}
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.learn(docs.limit(0)) is None and language_id.identify(docs.limit(0), net).count() == 0
    assert language_id.known_language(odd(spark)).columns == odd(spark).columns


def test_weak_quality(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = weak_quality.op5_weak_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    assert sum((r["quality"] == 1) == r["kept"] for r in got) >= 0.95 * len(got)
    found = {r["doc_id"]: r for r in weak_quality.score_quality(odd(spark)).collect()}
    assert len(found) == len(ODD) and not found[1]["kept"] and not found[2]["kept"] and found[6]["score"] == found[8]["score"]
    assert weak_quality.score_quality(odd(spark).limit(0)).count() == 0


def test_language_by_brute_force(spark, sf, docs):
    """Predictions against the network itself, filter by filter and place by place."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(d, t) for d, t in [*docs[:12], *ODD] if len(t or "") < 1500]
    windows = np.stack([np.frombuffer((t or "").encode().ljust(384, b"\0")[:384], np.uint8) for _, t in rows])
    net = language_id.train(windows, rng.integers(0, 3, len(rows)), ["de", "en", "fr"], epochs=2)
    rows += [(None, rows[0][1]), (77, rows[1][1]), (77, rows[1][1]), (77, rows[0][1])]
    got = language_id.identify(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, letters int, lang string"), net).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    assert sorted(key((r["doc_id"], r["lang_pred"], r["score"])) for r in got) == sorted(key((d, *told(net, t))) for d, t in rows)


def test_sample_is_bounded(spark):
    """Rows that share an id and text do not exceed the sample."""
    rows = [(None, "the same text for all of them", "en")] * 400 + [(i, f"anderer text nummer {i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.learn(df, sample_texts=20)
    assert net.languages in (["de"], ["de", "en"], ["en"])
    assert weak_quality.score_quality(df.select("doc_id", "text"), sample_texts=10).count() == 450


def test_weak_labels_by_brute_force(spark, docs):
    """Votes and posteriors against plain Python, over the table and odd texts."""
    import numpy as np

    rows = [*docs, *ODD, (None, docs[0][1]), (None, None), (5, docs[1][1])]
    stats = [weak_statistics(t) for _, t in rows]
    votes = [[int(v) for v in weak_quality.votes({k: np.array([x]) for k, x in s.items()})[0]] for s in stats]
    got = weak_quality.score_quality(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")).collect()
    key = lambda d, p: (str(d), round(p, 5))
    assert sorted(key(r["doc_id"], r["posterior"]) for r in got) == sorted(key(d, p) for (d, _), p in zip(rows, weak_posteriors(votes), strict=True))


def test_features_in_bounded_batches(spark):
    """Many tiny texts are scored some at a time, each as if alone."""
    import numpy as np
    import pyarrow as pa

    data, at = bytehash.flat(pa.array(["tiny text", None, "", "x\ny\nx", "A!! b?? " * 50]))
    together, votes = weak_quality.features(data, at)
    for k in range(5):
        alone, one = weak_quality.features(data[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]))
        assert np.allclose(together[k], alone[0]) and (votes[k] == one[0]).all()
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["tiny text"] * 10_000)], ["doc_id", "text"])
    assert max(b.num_rows for b in bytehash.pieces([batch], "text", rows=weak_quality.ROWS)) == weak_quality.ROWS


def test_quality_of_odd_labels(spark):
    """Repeated rows and null ids are judged alike; ties and single classes give rules or none."""
    rows = [(None, LONG), (6, LONG), (6, LONG), (6, None), (7, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, bad int")
    judged, _ = quality_rules.judge(df, spark.createDataFrame([(6, 0), (6, 1), (7, 0)], "doc_id long, quality int"))
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in judged.collect()) == [(0, True), (6, False), (6, True), (6, True), (7, False)]
    flat = spark.range(40).selectExpr("id % 2 as y", *[f"cast(0.5 as double) as {f}" for f in quality_rules.FEATURES])
    assert quality_rules.learn_rules(flat, "y") == [] and quality_rules.learn_rules(flat.filter("y = 0"), "y") == []
    split = spark.range(300).selectExpr("cast(id % 10 < 3 as int) as y", *[f"cast((id % 10 + {k}) / 10.0 as double) as {f}" for k, f in enumerate(quality_rules.FEATURES)])
    rules = quality_rules.learn_rules(split, "y")
    kept, _ = quality_rules.verdict(rules)
    assert rules and split.select("y", kept.alias("k")).filter("k = (y = 0)").count() == 0


def test_saved_is_cleared(spark):
    from cairnlake.llm.common import clear_saved, own_dir, saved, shared_dir

    assert saved(spark.range(3), "some").count() == 3
    clear_saved(spark)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    # A local session may have a folder of its own; on a cluster none is an error.
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="local[4]", applicationId="x"))
    assert shared_dir(bare) == shared_dir(bare) and shared_dir(bare).startswith("file:")
    bare.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(bare)
