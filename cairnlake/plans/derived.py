"""Tables with the columns that memory operators read, made from the given ones.

Each is one SELECT that Spark and DuckDB both run, so a query and its oracle
start from the same rows. Nulls, ties, archived and expired rows are among them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnlake.plans.base import table

_ID = "CAST(event_id AS STRING)"
_DAY = "CAST(ts AS STRING)"

TABLES = {
    "memories": f"""SELECT event_id AS id,
      CASE event_id % 6 WHEN 0 THEN 'goal' WHEN 1 THEN 'episodic' WHEN 2 THEN 'semantic' WHEN 3 THEN 'worldview' WHEN 4 THEN 'procedural' ELSE 'episodic' END AS type,
      CASE WHEN event_id % 11 = 3 THEN 'archived' ELSE 'active' END AS status,
      'Note ' || {_ID} || ' on ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' by Ann' ELSE ' by Bob' END AS content,
      CASE WHEN event_id % 17 = 5 THEN NULL ELSE value / 100 END AS importance,
      CASE WHEN event_id % 13 = 2 THEN NULL ELSE 0.01 END AS decay_rate, CAST(event_id % 8 AS INTEGER) AS access_count,
      ts AS created_at, CASE WHEN event_id % 4 = 1 THEN NULL ELSE ts + INTERVAL 36 HOUR END AS last_accessed,
      CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 60 HOUR ELSE NULL END AS last_reinforced,
      CASE WHEN event_id % 19 = 7 THEN ts + INTERVAL 12 HOUR ELSE NULL END AS valid_until,
      CASE WHEN event_id % 10 = 4 THEN 'pending' WHEN event_id % 10 = 5 THEN 'failed' WHEN event_id % 10 = 6 THEN 'in_progress' ELSE 'embedded' END AS embedding_status,
      CASE WHEN event_id % 7 = 0 THEN 'private' WHEN event_id % 7 = 1 THEN NULL ELSE 'public' END AS sensitivity,
      CASE WHEN event_id % 9 = 0 THEN 'doc' || CAST(event_id % 40 AS STRING) ELSE NULL END AS content_hash, user_id,
      '{{"priority":"' || CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'done' WHEN 2 THEN 'queued' ELSE 'backburner' END || '","title":"goal ' || {_ID} || '","source":"' || event_type || '"'
        || CASE WHEN event_id % 3 = 0 THEN ',"category":"boundary"' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ',"subcategory":"privacy","response_type":"refuse"' ELSE '' END
        || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"stability":0.' || CAST(1 + event_id % 9 AS STRING) END || ',"last_touched":"' || {_DAY} || '"'
        || CASE WHEN event_id % 8 = 0 THEN ',"progress":[1,2,3]' ELSE '' END || CASE WHEN event_id % 9 = 0 THEN ',"blocked_by":"x"' WHEN event_id % 9 = 1 THEN ',"blocked_by":null' ELSE '' END
        || CASE WHEN event_id % 4 = 3 THEN '' ELSE ',"emotional_valence":' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END || '0.' || CAST(event_id % 10 AS STRING) END
        || CASE WHEN event_id % 3 = 1 THEN ',"context":{{"heartbeat_id":"h' || {_ID} || '","heartbeat_number":' || {_ID} || ',"actions_taken":["a","b"]}}' ELSE '' END
        || CASE WHEN event_id % 12 = 5 THEN ',"protected":true' ELSE '' END || ',"tags":["t' || CAST(event_id % 5 AS STRING) || '","u' || CAST(event_id % 3 AS STRING) || '"]}}' AS metadata
      FROM events""",
    "units": """SELECT event_id AS id, CASE WHEN event_id % 13 = 4 THEN 'archived' ELSE 'active' END AS status,
      CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'embedded' END AS embedding_status,
      CASE event_id % 7 WHEN 0 THEN 'unrouted' WHEN 1 THEN 'route_failed' WHEN 2 THEN 'merged' WHEN 3 THEN 'episode_created' ELSE 'raw_only' END AS route_status,
      CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracted' WHEN 2 THEN 'skipped' ELSE 'failed' END AS extraction_status,
      ts AS created_at, ts + INTERVAL 1 HOUR AS updated_at, CASE WHEN event_id % 5 > 1 THEN ts + INTERVAL 2 HOUR END AS embedded_at,
      CASE WHEN event_id % 6 > 2 THEN ts + INTERVAL 3 HOUR END AS last_routed_at, CASE WHEN event_id % 7 IN (2, 3) AND event_id % 3 > 0 THEN ts + INTERVAL 5 HOUR END AS consolidated_at,
      CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 100 HOUR END AS last_accessed, CASE WHEN event_id % 31 = 9 THEN ts END AS pinned_at, CAST(event_id % 4 AS INTEGER) AS attempts FROM events""",
    "tasks": """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' ELSE 'dropped' END AS status,
      ts + INTERVAL 30 HOUR AS next_attempt_at, ts AS created_at, CASE WHEN event_id % 5 > 2 THEN ts + INTERVAL 1 HOUR END AS completed_at, ts + INTERVAL 2 HOUR AS updated_at,
      event_id * 3 % 500 AS trigger_unit_id, event_id * 7 % 500 AS source_unit_id, CAST(event_id % 4 AS INTEGER) AS attempts FROM events""",
    "edges": """SELECT l_orderkey AS src, CASE WHEN l_linenumber % 4 = 0 THEN l_orderkey ELSE l_partkey END AS dst,
      CASE l_linenumber % 4 WHEN 0 THEN 'RELATED' WHEN 1 THEN 'SUPPORTS' WHEN 2 THEN 'CONTRADICTS' ELSE 'MEMBER_OF' END AS rel,
      CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 50.0 END AS strength, l_extendedprice AS seq, l_suppkey AS concept FROM lineitem""",
    "drives": """SELECT 'drive ' || CAST(s_suppkey AS STRING) AS name, CAST((s_suppkey % 23) / 20.0 AS DOUBLE) AS current_level, CAST(0.5 AS DOUBLE) AS baseline, CAST(CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE 0.8 END AS DOUBLE) AS urgency_threshold,
      s_suppkey AS drive_id FROM supplier""",
    "states": f"""SELECT 'heartbeat_state' AS key, '{{"current_energy":' || CAST(event_id % 20 AS STRING) || ',"heartbeat_count":' || {_ID} || ',"last_heartbeat_at":"' || {_DAY} || '","is_paused":'
      || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || CASE WHEN event_id % 3 = 0 THEN ',"affective_state":{{"valence":0.25,"arousal":0.5,"primary_emotion":"calm","intensity":0.75}}' ELSE '' END || '}}' AS value,
      ts AS updated_at, event_id AS instance FROM events""",
    "runs": """SELECT event_id AS id, event_type AS tool_name, CASE WHEN event_id % 3 = 0 THEN 'chat' ELSE 'heartbeat' END AS tool_context, event_id % 7 > 0 AS success, value AS energy_spent,
      CASE WHEN event_id % 5 > 0 THEN value / 7 END AS duration_seconds, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'stopped' END AS status, user_id AS worker,
      ts + INTERVAL 20 HOUR AS last_seen_at FROM events""",
}
#: Memories with their vectors, trust and corrections.
TABLES["recallable"] = f"""SELECT m.*, e.embedding, CAST((m.id % 5) / 5.0 AS DOUBLE) AS trust_level, CASE WHEN m.id % 21 = 4 THEN true ELSE false END AS invalid_precedent, CAST((m.id % 4) / 8.0 AS DOUBLE) AS activation_boost
      FROM ({TABLES["memories"]}) m JOIN embeddings e ON e.vec_id = m.id"""


def ctes(*names: str) -> str:
    """The named tables as common table expressions of an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; its sources are temporary views of this library's own names."""
    sql = TABLES[name]
    for source in set(re.findall(r"(?:FROM|JOIN) (\w+)", sql)):
        df = table(spark, sf_dir, source)
        if source == "events":
            df = df.withColumn("ts", df["ts"].cast("timestamp"))
        df.createOrReplaceTempView(f"derived_from_{source}")
        sql = re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 derived_from_{source}", sql)
    return spark.sql(sql)
