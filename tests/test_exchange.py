"""Exports, imports and streams that are cut off, changed or repeated."""

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import lifecycle
from cairnlake.sources import exchange
from cairnlake.streaming import queue, runs
from cairnlake.streaming.episodes import episodes

MEMORY = "ref string, content string, trust double"


def test_round_trip_and_order(spark, tmp_path):
    rows = [(f"r{k:03d}", f"says {k}\n\"x\" é" if k % 7 else None, k / 3) for k in range(200)]
    df, path = spark.createDataFrame(rows, MEMORY), f"file://{tmp_path}/x"
    exchange.export({"memories": (df.repartition(7), ["ref"]), "none": (df.limit(0), ["ref"])}, path)
    assert sorted(map(tuple, exchange.section(spark, path, "memories", MEMORY).collect())) == rows
    assert exchange.section(spark, path, "none", MEMORY).count() == 0
    lines = [line for f in sorted((tmp_path / "x/memories").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line[8:12] for line in lines] == sorted(r[0] for r in rows)
    part = sorted((tmp_path / "x/memories").glob("part-*"))[0]
    text = part.read_text()
    (tmp_path / "x/memories" / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(text.replace("says 1", "says 9", 1))
    with pytest.raises(ValueError, match="incomplete or was changed"):
        exchange.section(spark, path, "memories", MEMORY)
    with pytest.raises(ValueError):
        exchange.section(spark, path, "footer", "section string")


def test_references_are_mapped_and_orphans_told(spark):
    rows = [("a", "Hello  World", 0.1), ("b", "new", 0.2), ("b", "new too", 0.3), (None, "x", 0.1), ("c", " ", 0.1), ("d", None, 0.1)]
    edges = [("a", "b", "R"), ("b", "zz", "R"), ("yy", "b", "S"), ("yy", "zz", "S"), (None, "a", "S"), ("a", "a", "T")]
    here = spark.createDataFrame([(7, "hello world", "2024-01-02"), (5, "HELLO WORLD", "2024-01-03")], "id long, content string, created_at string")
    bring = lambda: exchange.imported(spark.createDataFrame(rows, MEMORY), spark.createDataFrame(edges, "src string, dst string, rel string"), here, "t")
    got = bring()
    refs = {r["ref"]: (r["id"], r["known"]) for r in got.refs.collect()}
    assert refs["a"] == ("7", True) and not refs["b"][1] and refs["b"][0].startswith("t:") and set(refs) == {"a", "b"}
    assert [(r["id"], r["content"]) for r in got.memories.collect()] == [(refs["b"][0], "new")]
    assert sorted(map(tuple, got.edges.collect())) == sorted([("7", refs["b"][0], "R"), ("7", "7", "T")])
    told = sorted((r["section"], str(r["ref"]), str(r["other"]), r["reason"]) for r in got.warnings.collect())
    assert told == sorted([
        ("memories", "None", "None", "no reference or content"), ("memories", "c", "None", "no reference or content"), ("memories", "d", "None", "no reference or content"),
        ("memories", "b", "None", "repeated reference"), ("edges", "b", "zz", "target is unknown"), ("edges", "yy", "b", "source is unknown"), ("edges", "yy", "zz", "both ends are unknown"),
        ("edges", "None", "a", "source is unknown"),
    ])
    assert {r["ref"]: r["id"] for r in bring().refs.collect()} == {k: v[0] for k, v in refs.items()}


def test_episodes_go_on_after_a_restart(spark, tmp_path):
    events = [(u, 100 * u + k, 1_600_000_000 + 60 * (k * k % 37 + 40 * (k // 10))) for u in (1, 2) for k in range(30)]
    events = sorted(events, key=lambda r: r[2])
    path, schema = f"file://{tmp_path}/run", "user_id int, event_id long, ts timestamp"
    found, parts = None, [events[:25], events[25:45], events[45:], [(3, 999, 1_700_000_000)]]
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "user_id int, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/source/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/source")
        # A query of its own each time, which takes up the state that the last one left.
        found = runs.appended(episodes(stream, late="1 second"), path)
    whole = spark.createDataFrame(events, "user_id int, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    want = {(str(r["user_id"]), r["start"].timestamp(), r["events"]) for r in lifecycle.sessions(whole).collect()}
    rows = found.collect()
    assert len(rows) == len(events) == len({r["id"] for r in rows})
    got = {}
    for r in rows:
        got.setdefault((r["key"], r["episode"], r["started_at"].timestamp()), []).append(r["sequence"])
    assert {(k, start, len(seq)) for (k, _, start), seq in got.items()} == want and all(sorted(s) == list(range(1, len(s) + 1)) for s in got.values())


def commands(spark, rows):
    return spark.createDataFrame(rows, "item long, seq long, action string, s long, error string").withColumn("at", F.timestamp_seconds("s"))


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    rows = [(k % 5, k, ["submit", "start", "fail", "start", "complete", "odd"][k % 6], 10 * ((k * 7) % 30), f"e{k}") for k in range(30)]
    write = queue.upsert(path, fold_every=3)
    for number in range(7):
        batch = commands(spark, rows[number * 4 : number * 4 + 4])
        write(batch, number)
        write(batch, number)  # as after a crash
    write(commands(spark, rows[8:12]), 2)  # the last of a folded group comes again
    shown = lambda df: sorted(map(str, df.collect()))
    whole = queue._merged(queue.folded(commands(spark, rows[:28]))).select("item", "latest.action", "created_at", "attempts", "started_at", "completed_at", F.col("error.text").alias("error"))
    want = whole.select("item", F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in queue.STATUS.items()]).alias("status"), "created_at", "attempts", "started_at", "completed_at", "error")
    assert shown(queue.queue(spark, path)) == shown(want)
    assert queue._folders(spark, path) == [(0, 2), (3, 5), (6, 6)] and queue.queue(spark, f"{path}/none").count() == 0
    now = F.timestamp_seconds(F.lit(100_000))
    assert queue.claimed(queue.queue(spark, path), now, 2).count() <= 2
    ended = queue.queue(spark, path).filter("status in ('completed', 'failed')").count()
    assert queue.queue(spark, path).count() - queue.cleaned(queue.queue(spark, path), F.timestamp_seconds(F.lit(10_000_000))).count() == ended
