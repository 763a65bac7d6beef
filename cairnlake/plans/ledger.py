"""Queries on ledgers and health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import ledgers
from cairnlake.plans.base import events, query, table
from cairnlake.plans.derived import ctes, derived
from cairnlake.plans.upkeep import _j

_AT = "TIMESTAMP '2024-01-30'"


def _now():
    return F.lit("2024-01-30").cast("timestamp")


def _instances(spark, sf_dir):
    i = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(i.alias("instance"), (i * 7 % 300).alias("beats"), (i % 23).cast("double").alias("energy"), (i % 5 == 0).alias("paused"))


@query(f"""{ctes("memories", "tasks")}, h AS (SELECT count(*) FILTER (type = 'goal' AND {_j("priority")} = 'active') AS active_goals, count(*) FILTER (type = 'goal' AND {_j("priority")} = 'queued') AS queued_goals,
 count(*) FILTER (type = 'episodic' AND {_j("context.heartbeat_id")} IS NOT NULL AND created_at > {_AT} - INTERVAL 24 HOUR AND id % 4 = 1) AS reach_outs_24h,
 avg(CASE WHEN type = 'episodic' AND {_j("context.heartbeat_id")} IS NOT NULL AND created_at > {_AT} - INTERVAL 24 HOUR THEN id % 7 - 3.5 END) AS change FROM memories WHERE status = 'active')
SELECT s_suppkey AS instance, s_suppkey * 7 % 300 AS beats, (s_suppkey % 23)::DOUBLE AS energy, s_suppkey % 5 = 0 AS paused, active_goals, queued_goals, round(change, 6) AS energy_change_24h, reach_outs_24h, (SELECT count(*) FROM tasks WHERE status = 'pending') AS pending_calls FROM supplier, h""")
def heartbeat_health(spark, sf_dir):
    i = F.col("id")
    action = F.when(i % 4 == 1, '"reach_out_user"').otherwise('"rest"')
    context = F.concat(F.lit('"actions_taken":[' + '"think",'), action, F.lit('],"energy_start":3.5,"energy_end":'), (i % 7).cast("string"))
    memories = derived(spark, sf_dir, "memories").withColumn("metadata", F.replace("metadata", F.lit('"actions_taken":["a","b"]'), context))
    out = ledgers.heartbeat_health(_instances(spark, sf_dir), memories, derived(spark, sf_dir, "tasks"), _now())
    return out.withColumn("energy_change_24h", F.round("energy_change_24h", 6))


@query("""WITH o AS (SELECT event_id % (SELECT count(*) FROM supplier) AS instance, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'running' ELSE 'completed' END AS status, CASE WHEN event_id % 11 > 0 THEN event_id % 9 / 8.0 END AS score, ts, event_id FROM events),
l AS (SELECT instance, status, score FROM o WHERE status <> 'running' QUALIFY row_number() OVER (PARTITION BY instance ORDER BY ts DESC) = 1)
SELECT s_suppkey AS instance, (s_suppkey % 23)::DOUBLE AS current_energy, 20.0::DOUBLE AS reserve_energy, 30.0::DOUBLE AS bank_capacity, l.status AS latest_status, round(l.score, 6) AS latest_score, round(CASE WHEN l.score IS NULL THEN 1.0 ELSE least(1.5, 0.75 + 0.5 * l.score) END, 6) AS next_regen_multiplier
FROM supplier LEFT JOIN l ON l.instance = s_suppkey""")
def heartbeat_economy(spark, sf_dir):
    e = events(spark, sf_dir)
    i, n = F.col("event_id"), table(spark, sf_dir, "supplier").count()
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "running").otherwise("completed")
    outcomes = e.select((i % n).alias("instance"), status.alias("status"), F.when(i % 11 > 0, i % 9 / 8.0).alias("score"), F.col("ts").alias("completed_at"))
    out = ledgers.economy_status(_instances(spark, sf_dir), outcomes)
    return out.withColumns({c: F.round(c, 6) for c in ("latest_score", "next_regen_multiplier")})


@query("""WITH i AS (SELECT o_orderkey AS id, o_orderpriority AS connector, 'a' || o_custkey % 3 AS account FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT o_orderkey AS item_id, o_orderstatus AS status FROM orders),
l AS (SELECT l_orderkey AS item_id, 'L' || l_linenumber % 2 AS label, CASE WHEN l_quantity > 25 THEN 'high' END AS status FROM lineitem), c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'pending' ELSE 'done' END AS review_status, CASE WHEN c_custkey % 4 = 0 THEN 'retired' ELSE 'active' END AS status FROM customer)
SELECT 'progress' AS part, '{"connector":"' || connector || '","account":"' || account || '","status":"' || p.status || '"}' AS key, count(*) AS count FROM p JOIN i ON i.id = p.item_id GROUP BY 1, 2
UNION ALL SELECT 'importance', '{"connector":"' || connector || '","account":"' || account || '","label":"' || label || '","status":' || coalesce('"' || l.status || '"', 'null') || '}', count(*) FROM l JOIN i ON i.id = l.item_id GROUP BY 1, 2
UNION ALL SELECT 'review', '{"review_status":"' || review_status || '","status":"' || status || '"}', count(*) FROM c GROUP BY 1, 2 UNION ALL SELECT 'claims', '{"status":"active"}', count(*) FROM c WHERE status = 'active'""")
def connector_cognition(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), F.col("c_custkey")
    items = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("connector"), F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("account"))
    progress = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"))
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("L"), (F.col("l_linenumber") % 2).cast("string")).alias("label"), F.when(F.col("l_quantity") > 25, "high").alias("status"))
    claims = table(spark, sf_dir, "customer").select(F.when(c % 3 == 0, "pending").otherwise("done").alias("review_status"), F.when(c % 4 == 0, "retired").otherwise("active").alias("status"))
    return ledgers.connector_cognition(items, progress, claims, labels, connector="1-URGENT")


@query("""WITH e AS (SELECT event_id AS id, 'u' || user_id AS entity, ts AS "at", event_type AS kind FROM events ORDER BY ts DESC, event_id LIMIT 60), b AS (SELECT c_custkey AS id, 'u' || c_custkey % 400 AS entity, TIMESTAMP '2024-01-01' + to_seconds(c_custkey::INTEGER) AS "at", c_nationkey AS budget FROM customer),
k AS (SELECT s_suppkey AS id, 'u' || s_suppkey AS entity, TIMESTAMP '2024-01-02' + to_seconds(s_suppkey::INTEGER) AS "at", s_suppkey % 2 = 0 AS muted FROM supplier),
u AS (SELECT entity, 'event' AS part, "at", id, '{"id":' || id || ',"kind":"' || kind || '"}' AS body FROM e UNION ALL SELECT entity, 'budget', "at", id, '{"id":' || id || ',"budget":' || budget || '}' FROM b WHERE entity IN (SELECT entity FROM e)
UNION ALL SELECT entity, 'control', "at", id, '{"id":' || id || ',"muted":' || muted || '}' FROM k WHERE entity IN (SELECT entity FROM e))
SELECT entity, part, "at", (row_number() OVER (PARTITION BY part ORDER BY "at" DESC, id))::INTEGER AS rank, body FROM u""")
def outbound_ledger(spark, sf_dir):
    at = lambda day, n: F.timestamp_seconds(F.unix_seconds(F.lit(day).cast("timestamp")) + n)
    who = lambda n: F.concat(F.lit("u"), n.cast("string")).alias("entity")
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), who(F.col("user_id")), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    budgets = table(spark, sf_dir, "customer").select(c.alias("id"), who(c % 400), at("2024-01-01", c).alias("at"), F.col("c_nationkey").alias("budget"))
    controls = table(spark, sf_dir, "supplier").select(s.alias("id"), who(s), at("2024-01-02", s).alias("at"), (s % 2 == 0).alias("muted"))
    return ledgers.outbound_ledger(e, budgets, controls, 60)


@query("""WITH c AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'off' ELSE 'on' END AS status FROM nation),
x AS (SELECT (c_nationkey % 20)::VARCHAR AS id, c_custkey AS account, CASE WHEN c_custkey % 3 = 0 THEN 'revoked' ELSE 'connected' END AS st, c_custkey % 5 = 0 AS bad, c_custkey * 31 % 997 AS u FROM customer),
l AS (SELECT id, count(*) FILTER (st = 'connected') AS connected, count(*) FILTER (bad) AS failing, arg_max(account, {'u': u, 'a': account}) AS latest_account FROM x GROUP BY 1),
a AS (SELECT (user_id % 30)::VARCHAR AS id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts DESC, event_type) <= 20), n AS (SELECT id, status, count(*) AS n FROM a GROUP BY 1, 2),
t AS (SELECT id, '{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}' AS attempts FROM n GROUP BY 1)
SELECT c.id, name, c.status, coalesce(connected, 0) AS connected, coalesce(failing, 0) AS failing, latest_account, coalesce(attempts, '{}') AS attempts FROM c LEFT JOIN l USING (id) LEFT JOIN t USING (id)""")
def integration_status(spark, sf_dir):
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    connectors = table(spark, sf_dir, "nation").select(n.cast("string").alias("id"), F.col("n_name").alias("name"), F.when(n % 4 == 0, "off").otherwise("on").alias("status"))
    connections = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).cast("string").alias("connector"), c.alias("account"), F.when(c % 3 == 0, "revoked").otherwise("connected").alias("status"), F.when(c % 5 == 0, "bad").alias("last_error"), (c * 31 % 997).alias("updated_at"))
    attempts = events(spark, sf_dir).select((F.col("user_id") % 30).cast("string").alias("connector"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return ledgers.integration_status(connectors, connections, attempts)
