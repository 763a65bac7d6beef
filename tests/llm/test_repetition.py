"""Periodic runs, source divergence and frequent lines against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from brute import WORD

from cairnlake.llm import frequent_lines, runs, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_lines int, dropped int, runs int, copies int, _text int, batch int"
LONG = " ".join(f"w{i % 977}x{i * i % 1013}" for i in range(20_000)) + " la" * 3000
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r", None, None), (None, "one two", "en", "b"), (None, "one two", "en", "b"),
    (6, "a b " * 7 + "c", "en", "c"), (6, "A  b\n" * 12, None, "c"), (8, LONG, "de", "a"), (9, LONG + " tail", "de", "b"),
    (10, "é" * 300 + "\n" + "é" * 300, "fr", "a"), (11, "x\n\nx\nX \n\x0bx\n" + "same line\n" * 3, "en", "a"),
    (12, " " * 5000 + "x" + "\n" * 5000, "en", "a"), (13, "w" * 4000 + " " + "w" * 4000, "en", "b"), (14, "no break \U0001f600 Äé", "de", None),
]


def brute_runs(t, least_length=6, least_exponent=4):
    out = []
    for p in range(1, len(t) // 2 + 1):
        i = 0
        while i + p < len(t):
            if t[i] != t[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            part = t[start : i + p]
            smaller = any(part[q:] == part[:-q] for q in range(1, p))
            if len(part) >= max(least_length, least_exponent * p) and not smaller:
                out.append((start, len(part), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = (None, None, None, None)
    for s, n, q in found:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    return (doc_id, len(found), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_numbers():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3])
        t = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            p = rng.randint(1, n // 2)
            t = [t[i % p] if rng.random() < 0.96 else t[i] for i in range(n)]
        for least in ((2, 2), (6, 4), (7, 3)):
            assert runs.all_runs(t, *least) == brute_runs(t, *least), t


def test_lyndon_words_end_at_next_smaller():
    rng = random.Random(4)
    for _ in range(500):
        t = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        following, agree = runs.next_smaller(t)
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert following[i] == j
            assert agree[i] == next((k for k in range(len(t) - j) if t[i + k] != t[j + k]), len(t) - j)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: [0] * n, lambda n: [0] * (n - 1) + [1], lambda n: [i.bit_count() & 1 for i in range(n)]])
def test_work_grows_slowly(make):
    class Counting(list):
        reads = 0

        def __getitem__(self, k):
            Counting.reads += 1
            return list.__getitem__(self, k)

    reads = []
    for n in (4000, 32_000):
        Counting.reads = 0
        runs.next_smaller(Counting(make(n)))
        reads.append(Counting.reads / n)
    assert max(reads) < 20 and reads[1] < 1.3 * reads[0] + 1


def test_periodic_runs_query(spark, sf):
    out = runs.op11_periodic_runs(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r[c] for c in RUN_COLUMNS) for r in out) == sorted(brute_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r["n_runs"] > 0 for r in out) > 5


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], DOC)


def test_periodic_runs_of_odd_texts(spark):
    out = runs.periodic_runs(odd(spark))
    assert out.columns[:1] == ["doc_id"] and out.columns[-3:] == ["n_words", "runs_1", "collapsed"]
    key = lambda r: str(r)
    got = [(r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs_1"]], digest(r["collapsed"])) for r in out.collect()]
    want = []
    for doc_id, text, *_ in ODD:
        words = WORD.findall(text or "")
        stretch = brute_runs(words) if len(words) < 5000 else [(20_000, 3000, 1)]
        gone = {i for s, n, q in stretch for i in range(s + q, s + n)}
        want.append((doc_id, len(words), stretch, digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert runs.periodic_runs(odd(spark).limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in runs.without_runs(odd(spark)).collect()}
    assert kept[6] in ("a b c", "A b") and kept[2] == "" and kept[1] is None and runs.without_runs(odd(spark)).columns == odd(spark).columns
    with pytest.raises(ValueError):
        runs.periodic_runs(odd(spark), 2, 1)


def test_segments_share_numbers(monkeypatch):
    import numpy as np

    from cairnlake.llm import bytehash

    monkeypatch.setattr(bytehash, "SEGMENT", 64)
    text = " ".join(f"w{i % 7}" for i in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    numbers, starts, ends, first = runs.word_numbers(data, np.array([0, len(data)]))
    assert numbers.tolist() == [i % 7 for i in range(500)] and first.tolist() == [0, 500]
    assert [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == text.split()


def brute_divergence(rows, least, top=50):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]) for lang, source, text in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    groups = sorted(counts)
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    for lang in {x[0] for x in groups}:
        terms, v = kept.get(lang, []), len(kept.get(lang, []))
        own = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * v) for t in terms}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in own if o != s]
            found = [(q[t] - p[s][t], t.encode(), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(some)]
    return sorted(out)


def test_divergence(spark, sf):
    rng = random.Random(5)
    vocabulary = ["Apfel", "apfel", "b-c", "ü", "Ü", "the", "x1y", "zz"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "ß", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for _ in range(200)]
    rows += [("la", "s1", None), ("la", "s2", "solus"), ("xx", "only", "apfel"), ("en", "s1", "zz " * 500), (None, None, None)] + [("it", "s9", "uno")] * 40
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "lang string, source string, text string, term int, item string, value int")
    for least, top in ((3, 50), (30, 2)):
        got = source_divergence.divergence(df, least, top)
        assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, top)
    assert source_divergence.divergence(df.limit(0)).count() == 0
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()
    assert sorted(map(tuple, source_divergence.op12_source_divergence(spark, sf).collect())) == brute_divergence(whole, 30)


def test_shares_of_large_counts(spark):
    cases = [(7 * 10**14, 9 * 10**14, 10**7), (0, 0, 1), (9 * 10**14, 9 * 10**14, 3), (5, 1234567891234, 99)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(source_divergence.share(df["c"], df["n"], df["v"])).collect()]
    assert got == [1 + (10**9 * (c + 5)) // (n + 5 * v) for c, n, v in cases]


def brute_lines(rows, least, least_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    df = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if len(k) >= least_chars)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [i for i, x in enumerate(lines) if df[key(x)] >= least]
        out.append((doc_id, len(lines), gone, "\n".join(x for i, x in enumerate(lines) if i not in set(gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "chars", "batches", "fanout"), [(2, 1, 8, 2), (3, 2, 3, 2), (1, 0, 2, 4)])
def test_frequent_lines(spark, least, chars, batches, fanout):
    rng = random.Random(6)
    rows = ODD + [(100 + i, "\n".join(rng.choice([" Head", "HEAD ", "", "foot", f"own {i}", " ", "É", "é"]) for _ in range(rng.randint(1, 6))), "en", "a") for i in range(60)]
    rows += [(500, "hot\nline", "en", "a")] * 70
    out = frequent_lines.drop_frequent_lines(odd(spark, rows), least, chars, batches, fanout)
    assert out.columns == [*odd(spark).columns, "n_lines_1", "dropped_1"]
    got = [(r["doc_id"], r["n_lines_1"], r["dropped_1"], r["text"] or "") for r in out.collect()]
    assert sorted(got, key=str) == brute_lines([r[:2] for r in rows], least, chars)
    assert all((r["copies"], r["_text"], r["n_lines"]) == (4, 5, 1) for r in out.collect())
    assert frequent_lines.drop_frequent_lines(odd(spark).limit(0)).count() == 0


def test_frequent_lines_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, n, len(gone), digest(text)) for d, n, gone, text in brute_lines([tuple(r) for r in rows], 10)]
    assert sorted(map(tuple, frequent_lines.op13_line_dedup(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_runs_are_levelled(spark):
    lines = frequent_lines.LineRuns(spark, 3, fanout=2)
    keys = lambda *x: spark.createDataFrame(list(x), "digest string, n long")
    for k in range(5):
        lines.add(keys(("a", 1), ("a", 1), ("b", 1), (f"c{k}", 2)))
        assert [len(level) for level in lines.levels] == [int(bit) for bit in reversed(f"{k + 1:b}")]
    # Two batches bring a to 4, b to 2; the third leaves a out and brings b to 3.
    counts = {r["digest"]: r["n"] for r in frequent_lines._summed(lines.runs).collect()}
    assert counts["a"] == 4 and counts["b"] == 4 and {r[0] for r in lines.settled().collect()} == {"a", "b"}
    assert {r["digest"] for r in lines.fresh(keys(("a", 1), ("b", 1), ("c0", 1))).collect()} == {"c0", "b"} - {"b"}
    plan = lines.fresh(keys(("z", 1)).groupBy("digest").agg({"n": "sum"}))._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    with pytest.raises(ValueError):
        frequent_lines.LineRuns(spark, 3, fanout=1)
