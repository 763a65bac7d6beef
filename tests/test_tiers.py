"""Units by their best vector, and recall as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import recall, tiers
from cairnlake.plans import associative
from cairnlake.plans.base import vector
from cairnlake.plans.derived import derived

UNIT = "id long, embedding array<double>, status string, embedding_status string, sensitivity string, created_at timestamp, session int, content string, trust_level double, invalid_precedent boolean, correction string"
CHUNK = "unit_id long, chunk_index int, char_start int, char_end int, embedding array<double>, embedding_status string"


def data(n=60, seed=5):
    rng = np.random.default_rng(seed)
    v = lambda: [float(x) for x in np.round(rng.normal(size=3), 1)]
    units = [(k, v() if k % 9 else None, "active" if k % 11 else "archived", "embedded" if k % 7 else "pending", "private" if k % 5 == 0 else None, f"2024-01-{1 + k % 28:02d}", k % 3, f"unit {k} " * 60, 0.5, k % 4 == 0, "no" if k % 8 == 0 else None) for k in range(n)]
    chunks = [(k, c, 10 * c, 10 * c + 30, v() if c < 3 else [0.0, 0.0, 0.0], "embedded" if (k + c) % 6 else "pending") for k in range(0, n, 2) for c in range(4)]
    return units, chunks


def frames(spark, units, chunks):
    some = [c if " timestamp" not in c else c.replace("timestamp", "string") for c in UNIT.split(", ")]
    df = spark.createDataFrame(units, ", ".join(some)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return df, spark.createDataFrame(chunks, CHUNK)


def cosine(a, b):
    a, b = np.array(a or [0, 0, 0]), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if a.any() else None


def brute(units, chunks, query, k, show_private):
    best = []
    for u in units:
        if u[2] != "active" or u[3] != "embedded" or (u[4] == "private" and not show_private):
            continue
        found = [(-s, 1, -1) for s in [cosine(u[1], query)] if s is not None]
        found += [(-s, 0, c[1]) for c in chunks if c[0] == u[0] and c[5] == "embedded" for s in [cosine(c[4], query)] if s is not None]
        if found:
            s, kind, part = min((round(x, 9), kind, part) for x, kind, part in found)
            best.append((s, -int(u[5][-2:]), u[0], kind, part))
    return [(i, round(-s, 6), part if kind == 0 else None) for s, _, i, kind, part in sorted(best)[:k]]


@pytest.mark.parametrize("partitions", [1, 13])
def test_unit_hits(spark, partitions):
    units, chunks = data()
    u, c = frames(spark, units, chunks)
    query = [1.0, 0.5, -0.25]
    for private in (True, False):
        got = tiers.unit_hits(u.repartition(partitions), c.repartition(partitions), query, 6, private).collect()
        shown = sorted(((r["id"], round(r["score"], 6), r["part"]) for r in got), key=lambda r: (-r[1], r[0]))
        want = sorted(brute(units, chunks, query, 6, private), key=lambda r: (-r[1], r[0]))
        assert shown == want
    alone = [i for i, *_ in brute(units, [], query, 6, True)]
    assert alone != [i for i, *_ in brute(units, chunks, query, 6, True)]  # chunks change the order
    assert tiers.unit_hits(u.limit(0), c, query, 3).count() == 0 and tiers.unit_hits(u, c.limit(0), query, 3).count() == 3


def test_what_is_shown(spark):
    units, chunks = data()
    u, c = frames(spark, units, chunks)
    rows = {r["id"]: r for r in tiers.subconscious(u, c, [1.0, 0.5, -0.25], 60).collect()}
    for hit in tiers.unit_hits(u, c, [1.0, 0.5, -0.25], 60).collect():
        text = rows[hit["id"]]["content"]
        body = f"unit {hit['id']} " * 60
        span = body if hit["part"] is None else f"[Matching RecMem span: chunk {hit['part']}, chars {hit['char_start']}-{hit['char_end']} of unit {hit['id']}]\n\n" + body[hit["char_start"] : hit["char_end"]]
        warning = ("[INVALID PRECEDENT - do not imitate" + ("; correction: no" if hit["id"] % 8 == 0 else "") + "] ") if hit["id"] % 4 == 0 else ""
        assert text == warning + span
        assert rows[hit["id"]]["score"] == pytest.approx(max(0.001, hit["score"] - (0.35 if hit["id"] % 4 == 0 else 0)))
    late = [r["id"] for r in tiers.not_yet_embedded(u, 0).collect()]
    assert len(late) <= 3 and all(units[i][3] == "pending" and units[i][6] == 0 for i in late)


def test_recall_is_the_sum_of_its_tiers(spark, sf):
    units, chunks = associative._views(spark, sf)
    rows, i = derived(spark, sf, "recallable").withColumn("correction", F.lit(None).cast("string")), F.col("id")
    near = rows.select("id", ((i * 7 + 3) % 1000).alias("neighbour"), (0.5 + i % 4 / 10.0).alias("weight"))
    edges = rows.select(i.alias("src"), ((i * 3 + 1) % 1000).alias("dst"), F.lit("SUPPORTS").alias("rel"), F.lit(0.75).alias("weight"))
    now, q = F.lit("2024-01-31").cast("timestamp"), vector(spark, sf)
    whole = tiers.recall_context(units, chunks, rows, q, now, near, edges, rows.filter("id % 37 = 5"), session=7)
    called = {(r["tier"], r["id"]): (round(r["score"], 9), r["source"]) for r in recall.in_context(rows, q, now, near, edges, rows.filter("id % 37 = 5")).collect()}
    got = whole.collect()
    assert {(r["tier"], r["id"]): (round(r["score"], 9), r["source"]) for r in got if r["tier"] in ("episodic", "semantic", "knowledge")} == called
    unasked = [r["id"] for r in got if r["tier"] == "spontaneous"]
    assert not set(unasked) & {i for _, i in called} and sum(r["tier"] == "subconscious" for r in got) >= 10
    assert whole.columns == list(tiers.COLUMNS)
