"""Queries that send memories out and bring them in again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.plans.base import query
from cairnlake.plans.derived import ctes, derived
from cairnlake.shared import own_dir
from cairnlake.sources import exchange

_SINCE = "TIMESTAMP '2024-01-04'"
_SQL_OUT = f"""o AS (SELECT * FROM memories WHERE status IN ('active', 'archived') AND type NOT IN ('worldview', 'goal') AND coalesce(sensitivity, '') <> 'private' AND created_at >= {_SINCE}),
e AS (SELECT id AS src, id * 3 % 1000 AS dst, CASE id % 2 WHEN 0 THEN 'SUPPORTS' ELSE 'CAUSES' END AS rel FROM memories WHERE id % 4 > 0)"""


def _exported(spark, sf_dir) -> str:
    path = f"{own_dir(spark)}/exchange-{uuid.uuid4().hex}"
    rows, i = derived(spark, sf_dir, "memories"), F.col("id")
    out = exchange.outgoing(rows, since=F.lit("2024-01-04").cast("timestamp"))
    out = out.select(i.cast("string").alias("ref"), "type", "status", "content", "importance", "created_at", "metadata")
    edges = rows.filter("id % 4 > 0").select(i.cast("string").alias("src"), (i * 3 % 1000).cast("string").alias("dst"), F.when(i % 2 == 0, "SUPPORTS").otherwise("CAUSES").alias("rel"))
    exchange.export({"memories": (out, ["created_at", "ref"]), "edges": (edges, ["src", "dst"])}, path)
    return path


def _imported(spark, sf_dir) -> exchange.Imported:
    path = _exported(spark, sf_dir)
    memories = exchange.section(spark, path, "memories", "ref string, type string, status string, content string, importance double, created_at timestamp, metadata string")
    edges = exchange.section(spark, path, "edges", "src string, dst string, rel string")
    # A store that has some of these already, in other words of case and blanks.
    here = derived(spark, sf_dir, "memories").filter("id % 10 = 2").select((F.col("id") + 5_000_000).alias("id"), F.concat(F.lit(" "), F.upper("content"), F.lit("  ")).alias("content"), "created_at")
    return exchange.imported(memories, edges, here, "query")


@query(f"""{ctes("memories")}, {_SQL_OUT} SELECT id::VARCHAR AS ref, type, status, content, round(importance, 6) AS importance FROM o""")
def exchanged_memories(spark, sf_dir):
    """The memories section as it is read back from an export."""
    schema = "ref string, type string, status string, content string, importance double"
    return exchange.section(spark, _exported(spark, sf_dir), "memories", schema).withColumn("importance", F.round("importance", 6))


@query(f"""{ctes("memories")}, {_SQL_OUT}, h AS (SELECT id + 5000000 AS id, id AS old FROM memories WHERE id % 10 = 2) SELECT o.id::VARCHAR AS ref, h.id IS NOT NULL AS known, coalesce(h.id::VARCHAR, 'query:' || substr(sha256('query:' || o.id), 1, 32)) AS id FROM o LEFT JOIN h ON h.old = o.id""")
def import_references(spark, sf_dir):
    return _imported(spark, sf_dir).refs


@query(f"""{ctes("memories")}, {_SQL_OUT}, k AS (SELECT e.*, a.id IS NULL AS na, b.id IS NULL AS nb FROM e LEFT JOIN o a ON a.id = e.src LEFT JOIN o b ON b.id = e.dst)
SELECT 'edges' AS section, src::VARCHAR AS ref, dst::VARCHAR AS other, CASE WHEN na AND nb THEN 'both ends are unknown' WHEN na THEN 'source is unknown' ELSE 'target is unknown' END AS reason FROM k WHERE na OR nb""")
def import_warnings(spark, sf_dir):
    return _imported(spark, sf_dir).warnings
