"""Readers, canonical JSON, cron fields, layers and filters on odd inputs."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import canonical, schedule, speech, text
from cairnlake.operators import filters, graph, intake, rollups, search, upkeep, vectors
from cairnlake.sources import documents


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_documents(spark, tmp_path):
    w = 'xmlns:w="w"'
    files = {
        "a.md": b"# Title\nbody", "b.py": b"print(1)", "empty.txt": b"", "c.json": b'[{"x": 1}, 2]', "d.jsonl": b'{"y": "\xc3\xa9"}\n\n', "e.xml": b"<a><b>one</b><c> </c></a>",
        "f.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "y"]}]}).encode(),
        "h.xls": b"\xd0\xcf", "i.bin": b"\0", "j.tex": rb"\begin{document}intro % no" + b"\n" + rb"\section{One} \emph{text}\end{document}", "k.bib": b"@Article{key1,\n title = {A {B}},\n year = \"2020\"\n}\n",
        "l.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 caf\'e9\par two}", "broken.json": b"{",
    }
    files["g.docx"] = zipped(**{"word__document.xml": f"<w:d {w}><w:p><w:t>He</w:t><w:t>llo</w:t></w:p><w:p/><w:p><w:t>x</w:t></w:p></w:d>"})
    files["m.pptx"] = zipped(**{"ppt__slides__slide10.xml": "<s><p><t>ten</t></p></s>", "ppt__slides__slide2.xml": "<s><p><t>two</t></p></s>"})
    files["n.xlsx"] = zipped(**{"xl__sharedStrings.xml": "<s><si><t>name</t></si></s>", "xl__worksheets__sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>7</v></c></row></s>'})
    files["o.epub"] = zipped(**{"c1.xhtml": "<html><head><title>t</title></head><body><p>Once</p> upon</body></html>"})
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {}
    rows = documents.read_documents(spark, f"file://{tmp_path}").collect()
    for r in rows:
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["section"], r["text"], r["error"]))
    assert set(got) == set(files) - {"empty.txt"}
    assert got["a.md"] == [("", "# Title\nbody", None)] and got["b.py"][0][1] == "Language: python\n\nprint(1)"
    assert [t for _, t, _ in got["c.json"]] == ['{"x": 1}', "2"] and got["d.jsonl"] == [("line 1", '{"y": "é"}', None)] and got["e.xml"][0][1] == "b: one"
    assert got["f.ipynb"] == [("code 1", "x = 1\ny", None)] and got["g.docx"][0][1] == "Hello\nx"
    assert [t for _, t, _ in got["m.pptx"]] == ["two", "ten"] and got["n.xlsx"] == [("sheet 1", "name\t7", None)] and got["o.epub"][0][1] == "Once upon"
    assert [s for s, _, _ in got["j.tex"]] == ["", "One"] and "no" not in got["j.tex"][0][1] and got["k.bib"] == [("key1", "article\ntitle: A B\nyear: 2020", None)]
    assert got["l.rtf"][0][1] == "café\ntwo" and got["h.xls"][0][2].startswith("save") and "no reader" in got["i.bin"][0][2] and got["broken.json"][0][2]
    assert documents.described(documents.read_documents(spark, f"file://{tmp_path}")).count() == len(files) - 1


def test_canonical_json(spark):
    cases = {'{"b":1,"a":[1.0,2.5000005,1e2,-0,1e-7]}': '{"a":[1.0,2.500001,100,0,0.0],"b":1}', '"é\\u0001\U0001f600"': '"\\u00e9\\u0001\\ud83d\\ude00"', "{": None, "null": "null", "12345678901234567890": "12345678901234567890"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", canonical.canonical_json(F.col("t")).alias("c")).collect()} == cases | {None: None}
    one = spark.createDataFrame([("s", '{"a":1,"b":2}'), ("s", "3"), ("t", "3")], "section string, doc string")
    two = spark.createDataFrame([("s", "3"), ("t", "3"), ("s", '{ "b":2, "a":1}')], "section string, doc string")
    assert sorted(map(tuple, canonical.section_digests(one, "section", "doc").collect())) == sorted(map(tuple, canonical.section_digests(two, "section", "doc").collect()))


def test_cron(spark):
    assert schedule.cron_values("1-10/3,59", 0, 59) == [1, 4, 7, 10, 59] and schedule.cron_values("50/5", 0, 59) == [50, 55]
    assert schedule.cron_values("mon-WED", 0, 7, schedule.WEEKDAYS) == [1, 2, 3]
    for bad in ("", "60", "5-1", "*/0", "x", "1,,2"):
        with pytest.raises(ValueError):
            schedule.cron_values(bad, 0, 59)
    with pytest.raises(ValueError):
        schedule.next_cron("* * *", F.lit(None).cast("timestamp"))
    after = F.lit("2024-02-28 23:59:30").cast("timestamp")
    crons = {"* * * * *": "2024-02-29 00:00", "0 12 29 2 *": "2024-02-29 12:00", "0 0 30 2 *": None, "0 0 1 * 5": "2024-03-01 00:00", "0 9 * * 0": "2024-03-03 09:00", "0 9 * * 7 30": "2024-03-03 09:00"}
    row = spark.range(1).select(*[schedule.next_cron(c, after).alias(str(k)) for k, c in enumerate(crons)]).first()
    assert [x and x.strftime("%Y-%m-%d %H:%M") for x in row] == list(crons.values())


def test_texts_of_nulls(spark):
    none = F.lit(None).cast("string")
    r = spark.range(1).select(
        text.normalized(F.lit("\n\na \t\r\nb  \n\n")).alias("n"), text.normalized(none).alias("e"), text.canonical(F.lit("\u2003A\u00a0\u3000b ")).alias("c"),
        text.fingerprint(F.lit("  Do it -- now!! ")).alias("f"), text.error_shape(none).alias("s"), speech.standing_instruction(none).alias("i"), speech.turn_importance(none, none, none).alias("t"),
        speech.weekday(F.lit("8")).alias("w"), speech.embedding_prefix(none).alias("p"), speech.address(none, none).alias("a"), intake.embedding_input(F.lit("x" * 3000), 600).alias("m"), intake.embedding_input(none).alias("mn"),
    ).first()
    assert (r["n"], r["e"], r["c"], r["f"], r["s"]) == ("a\nb", "", "a b", "do it -- now", "") and r["i"] is None and r["t"] == 0.5
    assert r["w"] is None and r["p"] is None and r["a"] == "" and len(r["m"]) == 600 and r["m"].startswith("x" * 350) and r["mn"] == ""


def test_prices_either_way(spark):
    names = spark.createDataFrame([("ab",), ("abc-1",), ("z",), (None,), ("abc",)], "n string")
    got = {r["n"]: r["price_key"] for r in rollups.priced(names, [("abc", 1.0), ("abc-1", 2.0), ("a", 3.0)], "n").collect()}
    assert got == {"ab": "abc-1", "abc-1": "abc-1", "z": None, None: None, "abc": "abc"}


def test_rows_that_share_a_key(spark):
    held = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "c", None)], "k int, v string, frozen boolean")
    new = spark.createDataFrame([(1, "x"), (2, "d"), (2, "e"), (3, None)], "k int, v string")
    assert sorted(map(tuple, intake.upserted(held, new, "k", "v", "frozen").collect())) == [(1, "b", "kept"), (2, "e", "updated"), (3, None, "inserted")]
    a = spark.createDataFrame([(1, "same"), (2, "old"), (2, "older")], "ref int, content string")
    b = spark.createDataFrame([(1, " SAME "), (1, " same"), (2, "new"), (3, "Same"), (4, None)], "ref int, content string")
    assert sorted(map(tuple, intake.import_conflicts(a, b).collect())) == [(1, "same"), (2, "conflict"), (3, "duplicate"), (4, "new")]


def test_filters_of_odd_values(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1},"l":["x",2],"t":true,"n":null}'), (2, '{"a":1,"l":"x"}'), (3, None), (4, "no json")], "id int, m string")
    m = F.col("m")
    ids = lambda c: [r["id"] for r in df.filter(c).orderBy("id").collect()]
    assert ids(filters.json_holds(m, {"a": {"b": 1}, "l": ["x"], "t": True})) == [1] and ids(filters.json_holds(m, {"l": ["x"]})) == [1] and ids(filters.json_has(m, "n")) == [1]
    assert ids(filters.optional(id=None)) == [1, 2, 3, 4] and ids(filters.not_private(F.lit(None).cast("string"))) == [1, 2, 3, 4]
    assert ids(filters.ranges_meet(F.col("id"), F.col("id") + 1, None, F.lit(2))) == [1, 2] and ids(filters.like_any(m, [])) == []
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate([0.0, 0.5, 1.0, 1.0, 9.0, None])], "id int, g int, x double")
    assert sorted(map(tuple, filters.pairs_within(rows, "g", "x", 0.5).collect())) == [(0, 1), (1, 2), (1, 3), (2, 3)]
    share = filters.sampled(spark.range(10_000), "id", 0.1)
    assert 800 < share.count() < 1200 and share.exceptAll(filters.sampled(spark.range(10_000), "id", 0.1)).count() == 0


def test_layers_of_a_circle(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    steps = spark.createDataFrame([(s,) for s in "abcdxyz"], "step string")
    needs = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "nowhere"), ("d", "b")], "step string, needs string")
    assert dict(map(tuple, graph.plan_layers(steps, needs).collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_vectors_that_tie(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0]), (103, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest_of_each(df, df.filter("vec_id in (0, 103, 101)"), 3).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0] == [1, 2, 3]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 103] == [0, 1, 2]
    centers = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "cluster long, centroid array<double>")
    near = vectors.assigned(df, centers, most=2, least=0.5)
    assert sorted((r["id"], r["cluster"]) for r in near.collect() if r["id"] in (7, 103)) == [(7, 0), (7, 1), (103, 4), (103, 5)]


def test_retention_of_nulls(spark):
    rows = [(1, "semantic", "active", None, None, None, None), (2, "episodic", "active", 0.9, None, None, None), (3, "episodic", "active", 0.1, "{", None, None), (4, "goal", "archived", 0.0, "{}", "h", None)]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1), None) for r in rows], "id int, type string, status string, importance double, metadata string, content_hash string, sensitivity string, created_at timestamp, last_reinforced timestamp")
    now = F.lit("2024-01-31").cast("timestamp")
    got = {r["id"]: (r["p"], r["b"]) for r in df.select("id", upkeep.protected().alias("p"), upkeep.borderline(now).alias("b")).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, False), 4: (True, False)}
    assert upkeep.expired(df, F.col("last_reinforced"), now, 1).count() == 0 and upkeep.expired(df, F.col("created_at"), now, 1).count() == 4


def covers_by_hand(words, groups):
    """Shortest stretches that hold all words of a group: (first, last) places."""
    fits = lambda a, b: any(set(g) <= set(words[a : b + 1]) for g in groups)
    n = len(words)
    return [(a, b) for a in range(n) for b in range(a, n) if fits(a, b) and not (a < b and (fits(a + 1, b) or fits(a, b - 1)))]


def test_cover_ranks(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdxy") for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "B! a, The C"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    query = search.web_query("b c or d x -y")
    assert query.groups == ((("b",), ("c",)), (("d",), ("x",))) and query.none == (("y",),) and query.terms == ["b", "c", "d", "x"]
    got = {r["id"]: (r["covers"], round(r["score"], 9)) for r in search.cover_ranks(df, query).collect()}
    want = {}
    for k, t in enumerate(texts):
        words = [w.strip("!,").lower() for w in (t or "").split()]
        found = covers_by_hand(words, [["b", "c"], ["d", "x"]])
        if found and "y" not in words:
            r = sum(0.1 / (1 + sum(w not in query.terms for w in words[a : b + 1])) for a, b in found)
            want[k] = (len(found), round(r / (r + 1), 9))
    assert got == want and len(want) > 5
    assert search.web_query("the of").groups == () and search.cover_ranks(df, search.web_query("")).count() == 0
    phrase = search.web_query('"b c"')
    assert {r["doc_id"] for r in df.filter(search.matches(phrase, df["text"])).collect()} == {k for k, t in enumerate(texts) if _has(t, "b", "c")}


def _has(text, *words):
    kept = [w.strip("!,").lower() for w in (text or "").split()]
    kept = [w for w in kept if w not in ("a", "the")]
    return any(kept[i : i + len(words)] == list(words) for i in range(len(kept)))
