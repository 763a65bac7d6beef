"""Registered status reports, with SQL written from the reports' own definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import reports
from cairnlake.plans.base import query, table
from cairnlake.plans.derived import ctes, derived

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _j(path: str, column: str = "metadata") -> str:
    return f"json_extract_string({column}, '$.{path}')"


@query(f"""{ctes("memories")} SELECT id, {_j("title")} AS title, {_j("source")} AS source, {_j("last_touched")}::TIMESTAMP AS last_touched,
coalesce(json_array_length(metadata, '$.progress'), 0)::INTEGER AS progress_count, {_j("blocked_by")} IS NOT NULL AS is_blocked
FROM memories WHERE type = 'goal' AND status = 'active' AND {_j("priority")} = 'active'""")
def active_goals(spark, sf_dir):
    return reports.active_goals(derived(spark, sf_dir, "memories"))


@query(f"""{ctes("memories")} SELECT {_j("priority")} AS priority, count(*) AS n,
to_json(list({{'id': id, 'title': {_j("title")}, 'source': {_j("source")}}} ORDER BY {_j("last_touched")}::TIMESTAMP DESC, id))::VARCHAR AS goals
FROM memories WHERE type = 'goal' AND status = 'active' AND {_j("priority")} IN ('active', 'queued', 'backburner') GROUP BY 1""")
def goal_backlog(spark, sf_dir):
    return reports.goal_backlog(derived(spark, sf_dir, "memories"))


@query(f"""{ctes("memories")} SELECT id, coalesce({_j("subcategory")}, 'ethical') AS boundary_type, {_j("response_type")} AS response_type, importance, round(1.0 - coalesce({_j("stability")}::DOUBLE, 0.9), 6) AS flexibility
FROM memories WHERE type = 'worldview' AND {_j("category")} = 'boundary' AND status = 'active'""")
def boundary_status(spark, sf_dir):
    return reports.boundaries(derived(spark, sf_dir, "memories")).withColumn("flexibility", F.round("flexibility", 6))


@query(f"""{ctes("memories")} SELECT id, {_j("context.heartbeat_id")} AS heartbeat_id, {_j("context.heartbeat_number")}::INTEGER AS heartbeat_number, created_at AS started_at,
json_array_length(metadata, '$.context.actions_taken')::INTEGER AS action_count, {_j("emotional_valence")}::DOUBLE AS valence
FROM memories WHERE type = 'episodic' AND {_j("context.heartbeat_id")} IS NOT NULL ORDER BY created_at DESC, id LIMIT 20""")
def recent_beats(spark, sf_dir):
    return reports.recent_beats(derived(spark, sf_dir, "memories"))


@query(f"""{ctes("states")} SELECT instance, coalesce({_j("current_energy", "value")}::DOUBLE, 10) AS energy, {_j("last_heartbeat_at", "value")}::TIMESTAMP AS last_heartbeat_at,
coalesce({_j("heartbeat_count", "value")}::INTEGER, 0) AS heartbeats, coalesce({_j("is_paused", "value")}::BOOLEAN, false) AS is_paused, updated_at FROM states""")
def heartbeat_states(spark, sf_dir):
    return reports.heartbeat_states(derived(spark, sf_dir, "states"))


@query(f"""{ctes("states")} SELECT instance, updated_at AS recorded_at, {_j("affective_state.valence", "value")}::DOUBLE AS valence, {_j("affective_state.arousal", "value")}::DOUBLE AS arousal,
coalesce({_j("affective_state.dominance", "value")}::DOUBLE, 0.5) AS dominance, {_j("affective_state.primary_emotion", "value")} AS primary_emotion, {_j("affective_state.intensity", "value")}::DOUBLE AS intensity FROM states""")
def emotional_states(spark, sf_dir):
    return reports.emotional_states(derived(spark, sf_dir, "states"))


@query(f"""{ctes("drives")} SELECT name, round(current_level / nullif(urgency_threshold, 0), 6) AS ratio, current_level >= urgency_threshold AS is_urgent FROM drives""")
def drive_ratios(spark, sf_dir):
    return reports.drive_ratios(derived(spark, sf_dir, "drives")).select("name", F.round("ratio", 6).alias("ratio"), "is_urgent")


@query(f"""{ctes("drives")}, r AS (SELECT name, greatest(current_level / nullif(urgency_threshold, 0), 0.0) AS ratio FROM drives)
SELECT round(coalesce(max(ratio), 0), 6) AS max_ratio, coalesce(string_agg(name, ',' ORDER BY ratio DESC, name) FILTER (ratio >= 0.8), '') AS urgent FROM r""")
def urgency_snapshot(spark, sf_dir):
    return reports.urgency(derived(spark, sf_dir, "drives")).withColumn("max_ratio", F.round("max_ratio", 6))


@query(f"""{ctes("memories", "drives")}, m AS (SELECT count(*) FILTER (type = 'goal' AND status = 'active' AND {_j("priority")} = 'active') AS active_goals,
count(*) FILTER (type = 'goal' AND status = 'active' AND {_j("priority")} = 'active' AND {_j("blocked_by")} IS NOT NULL) AS blocked_goals, count(*) FILTER (status = 'active') AS total_memories,
count(*) FILTER (type = 'episodic' AND {_j("context.heartbeat_id")} IS NOT NULL AND created_at > {NOW} - INTERVAL 24 HOUR) AS beats_24h FROM memories)
SELECT m.*, count(*) FILTER (current_level >= urgency_threshold) AS urgent_drives, round(avg(current_level), 6) AS avg_drive_level FROM drives, m GROUP BY ALL""")
def cognitive_health(spark, sf_dir):
    out = reports.cognitive_health(derived(spark, sf_dir, "memories"), derived(spark, sf_dir, "drives"), _now())
    return out.withColumn("avg_drive_level", F.round("avg_drive_level", 6))


@query(f"""{ctes("units", "tasks")}, u AS (SELECT count(*) FILTER (status = 'active') AS active_raw_units, count(*) FILTER (embedding_status = 'pending') AS pending_embeddings, count(*) FILTER (embedding_status = 'failed') AS failed_embeddings,
count(*) FILTER (route_status = 'unrouted' AND embedding_status = 'embedded') AS pending_routes, count(*) FILTER (route_status = 'route_failed') AS failed_routes,
round(avg(epoch_us({NOW}) - epoch_us(created_at)) FILTER (embedding_status = 'pending') / 3600000000.0, 4) AS pending_embedding_age,
round(avg(epoch_us({NOW}) - epoch_us(embedded_at)) FILTER (embedding_status = 'embedded' AND route_status = 'unrouted') / 3600000000.0, 4) AS pending_route_age FROM units)
SELECT u.*, t.* FROM u, (SELECT count(*) FILTER (status = 'pending' AND next_attempt_at <= {NOW}) AS pending_tasks, count(*) FILTER (status = 'failed') AS failed_tasks, count(*) FILTER (status = 'dropped') AS dropped_tasks FROM tasks) t""")
def unit_health(spark, sf_dir):
    out = reports.unit_health(derived(spark, sf_dir, "units"), derived(spark, sf_dir, "tasks"), _now())
    return out.withColumns({c: F.round(c, 4) for c in ("pending_embedding_age", "pending_route_age")})


@query(f"""{ctes("units", "tasks")} SELECT 'embedding' AS task_type, count(*) AS pending FROM units WHERE embedding_status = 'pending'
UNION ALL SELECT 'routing', count(*) FROM units WHERE embedding_status = 'embedded' AND route_status = 'unrouted'
UNION ALL SELECT 'consolidation', count(*) FROM tasks WHERE status = 'pending' AND next_attempt_at <= {NOW}""")
def pending_work(spark, sf_dir):
    return reports.pending_work(derived(spark, sf_dir, "units"), derived(spark, sf_dir, "tasks"), _now())


@query(f"""{ctes("units", "tasks")} SELECT 'embedding' AS kind, id, attempts, updated_at AS last_seen FROM units WHERE status = 'active' AND embedding_status = 'failed'
UNION ALL SELECT 'route', id, attempts, coalesce(last_routed_at, updated_at) FROM units WHERE status = 'active' AND route_status = 'route_failed'
UNION ALL SELECT 'task', id, attempts, updated_at FROM tasks WHERE status = 'failed'""")
def unhealthy_items(spark, sf_dir):
    return reports.unhealthy_items(derived(spark, sf_dir, "units"), derived(spark, sf_dir, "tasks"))


@query(f"""{ctes("memories")} SELECT count(*) FILTER (embedding_status = 'pending') AS pending, count(*) FILTER (embedding_status = 'in_progress') AS in_progress, count(*) FILTER (embedding_status = 'embedded') AS embedded,
count(*) FILTER (embedding_status = 'failed') AS failed, count(*) FILTER (embedding_status = 'skipped') AS skipped, min(created_at) FILTER (embedding_status = 'pending') AS oldest_pending_at FROM memories""")
def embedding_lifecycle(spark, sf_dir):
    return reports.embedding_lifecycle(derived(spark, sf_dir, "memories"))


@query(f"""{ctes("memories")} SELECT count(*) FILTER (status = 'active' AND type = 'episodic') AS active,
round(sum(greatest(0.0, least(1.0, coalesce(importance, 0.5) * exp(-greatest(coalesce(decay_rate, 0.01), 0.0) * greatest((epoch_us({NOW}) - epoch_us(coalesce(last_reinforced, created_at))) / 86400000000.0, 0.0))))) FILTER (status = 'active' AND type = 'episodic'), 4) AS mass,
count(*) FILTER (status = 'archived') AS archived, count(DISTINCT content_hash) FILTER (status = 'active') AS documents FROM memories""")
def retention_status(spark, sf_dir):
    return reports.retention_status(derived(spark, sf_dir, "memories"), _now()).withColumn("mass", F.round("mass", 4))


@query(f"""{ctes("runs")} SELECT worker, status, floor((epoch_us({NOW}) - epoch_us(last_seen_at)) / 1000000)::BIGINT AS last_seen_age_s, status IN ('starting', 'running', 'stopping') AND last_seen_at < {NOW} - INTERVAL 3 MINUTE AS is_stale FROM runs""")
def worker_status(spark, sf_dir):
    return reports.worker_status(derived(spark, sf_dir, "runs"), _now())


@query(f"""{ctes("runs")}, late AS (SELECT worker FROM runs WHERE status = 'running' AND last_seen_at < {NOW} - INTERVAL 3 MINUTE AND worker % 3 = 0)
SELECT id, worker FROM runs WHERE status = 'running' AND worker IN (SELECT worker FROM late)""")
def interrupted_runs(spark, sf_dir):
    runs = derived(spark, sf_dir, "runs")
    return reports.interrupted(runs.filter("worker % 3 = 0"), runs, _now()).select("id", "worker")


@query(f"""{ctes("runs")} SELECT tool_name, count(*) FILTER (created_at >= TIMESTAMP '2024-01-10' - INTERVAL 2 MINUTE) AS starts_2m, count(*) FILTER (created_at >= TIMESTAMP '2024-01-10' - INTERVAL 10 MINUTE) AS starts_10m, max(created_at) AS latest_at,
count(*) FILTER (created_at >= TIMESTAMP '2024-01-10' - INTERVAL 2 MINUTE) > 5 AS is_storming FROM runs WHERE created_at <= TIMESTAMP '2024-01-10' GROUP BY tool_name""")
def start_summary(spark, sf_dir):
    return reports.start_summary(derived(spark, sf_dir, "runs"), "tool_name", F.lit("2024-01-10").cast("timestamp"))


_SQL_WINDOW = "created_at >= TIMESTAMP '2024-01-10' - INTERVAL 48 HOUR AND created_at <= TIMESTAMP '2024-01-10' AND tool_context = 'chat'"


@query(f"""{ctes("runs")}, s AS (SELECT count(*) AS total, count(*) FILTER (NOT success) AS failures, round(coalesce(sum(energy_spent), 0), 4) AS energy_total FROM runs WHERE {_SQL_WINDOW})
SELECT id, tool_name, success, round(coalesce(duration_seconds, 0), 2) AS duration, total, failures, energy_total FROM (SELECT * FROM runs WHERE {_SQL_WINDOW} ORDER BY created_at DESC, id LIMIT 30), s""")
def recent_actions(spark, sf_dir):
    latest, summary = reports.recent_actions(derived(spark, sf_dir, "runs"), F.lit("2024-01-10").cast("timestamp"), hours=48, context="chat")
    # The summary is one row.
    return latest.drop("created_at").join(summary.withColumn("energy_total", F.round("energy_total", 4)))


@query(f"""{ctes("runs")}, w AS (SELECT * FROM runs WHERE created_at >= TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-10'), k AS (SELECT tool_name, count(*) AS n FROM w GROUP BY 1)
SELECT (SELECT count(*) FROM w) AS events, (SELECT coalesce(round(avg(energy_spent), 4), 0) FROM w) AS mean, '{{' || (SELECT string_agg('"' || tool_name || '":' || n, ',' ORDER BY tool_name) FROM k) || '}}' AS by_kind""")
def reward_summary(spark, sf_dir):
    return reports.reward_summary(derived(spark, sf_dir, "runs"), F.lit("2024-01-10").cast("timestamp"), "tool_name", "energy_spent", "created_at")


@query(f"""{ctes("runs")} SELECT row_number() OVER (ORDER BY created_at DESC, id)::INTEGER AS ord, id, tool_name FROM runs WHERE created_at > TIMESTAMP '2024-01-05' ORDER BY created_at DESC, id LIMIT 20""")
def numbered_changes(spark, sf_dir):
    return reports.numbered_changes(derived(spark, sf_dir, "runs"), "created_at", F.lit("2024-01-05").cast("timestamp")).select("ord", "id", "tool_name")


@query("""SELECT o_orderkey AS id, priority FROM (SELECT *, CASE o_orderpriority[1] WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' WHEN '4' THEN 'low' END AS priority FROM orders)
WHERE o_orderstatus = 'O' ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 END NULLS LAST, o_orderdate, o_orderkey LIMIT 50""")
def open_backlog(spark, sf_dir):
    level = F.left("o_orderpriority", F.lit(1))
    name = F.when(level == "1", "urgent").when(level == "2", "high").when(level == "3", "normal").when(level == "4", "low")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return reports.backlog(rows, status="O", owner=None).select("id", "priority")


@query(f"""{ctes("tasks")}, k AS (SELECT status, count(*) AS n FROM tasks GROUP BY 1) SELECT sum(n)::BIGINT AS count, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS by_key FROM k""")
def pending_review(spark, sf_dir):
    return reports.counts_as_json(derived(spark, sf_dir, "tasks"), "status")


@query("""SELECT s_suppkey AS id, s_name AS name, count(l_suppkey) AS memory_count FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_suppkey % 5 > 0) ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def cluster_insights(spark, sf_dir):
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return reports.cluster_insights(clusters, table(spark, sf_dir, "lineitem").filter("l_suppkey % 5 > 0").select(F.col("l_suppkey").alias("cluster_id")))


@query(f"""{ctes("memories")}, m AS (SELECT user_id AS episode_id, id * 2 AS memory_id FROM memories WHERE user_id % 4 > 0)
SELECT u.id, count(m.memory_id) AS memory_count, min(k.created_at) AS first_at, max(k.created_at) AS last_at FROM (SELECT DISTINCT user_id AS id FROM memories) u LEFT JOIN m ON m.episode_id = u.id LEFT JOIN memories k ON k.id = m.memory_id GROUP BY 1""")
def episode_summary(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    members = memories.filter("user_id % 4 > 0").select(F.col("user_id").alias("episode_id"), (F.col("id") * 2).alias("memory_id"))
    return reports.episode_summary(memories.select(F.col("user_id").alias("id")).distinct(), members, memories)


@query(f"""{ctes("memories")} SELECT n.id * 2 AS memory_id, m.type, n.created_at AS computed_at, round((epoch_us({NOW}) - epoch_us(n.created_at)) / 3600000000.0, 4) AS hours FROM memories n JOIN memories m ON m.id = n.id * 2 WHERE n.id % 3 = 0""")
def stale_neighborhoods(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    near = memories.select((F.col("id") * 2).alias("memory_id"), F.col("created_at").alias("computed_at"), (F.col("id") % 3 == 0).alias("is_stale"))
    return reports.stale_neighborhoods(near, memories, _now()).withColumn("hours", F.round("hours", 4))


@query(f"""{ctes("memories")} SELECT s.id AS memory_id, s.id * 2 AS replacement_id, s.content AS reason, m.status AS replacement_status FROM memories s LEFT JOIN memories m ON m.id = s.id * 2 WHERE s.status = 'active'""")
def effective_replacements(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    return reports.effective_replacements(memories.select(F.col("id").alias("memory_id"), (F.col("id") * 2).alias("replacement_id"), F.col("content").alias("reason"), "status"), memories)


@query(f"""{ctes("memories")}, c AS (SELECT id, user_id AS policy_key, created_at, CASE id % 4 WHEN 0 THEN 'set' WHEN 1 THEN 'retire' ELSE 'reinforce' END AS action, id // 2 AS memory_id FROM memories),
l AS (SELECT *, row_number() OVER (PARTITION BY policy_key ORDER BY created_at DESC, id DESC) AS r FROM c)
SELECT policy_key, l.id, action FROM l JOIN memories m ON m.id = l.memory_id WHERE r = 1 AND action IN ('set', 'reinforce') AND m.status = 'active'""")
def active_policies(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    action = F.when(F.col("id") % 4 == 0, "set").when(F.col("id") % 4 == 1, "retire").otherwise("reinforce")
    made = memories.select("id", F.col("user_id").alias("policy_key"), "created_at", action.alias("action"), F.expr("id div 2").alias("memory_id"))
    return reports.active_policies(made, memories)


@query(f"""SELECT user_id AS entity, round(count(*) / greatest((epoch_us({NOW}) - min(epoch_us(ts))) / 604800000000.0, 1.0), 6) AS per_week FROM events WHERE ts >= {NOW} - INTERVAL 20 DAY AND ts <= {NOW} GROUP BY user_id""")
def contacts_per_week(spark, sf_dir):
    rows = derived(spark, sf_dir, "runs").select(F.col("worker").alias("entity"), "created_at")
    return reports.observed_per_week(rows, "entity", "created_at", _now(), days=20).withColumn("per_week", F.round("per_week", 6))


@query(f"""{ctes("runs")} SELECT id, round(coalesce(CASE WHEN id % 6 > 0 THEN least(1.5, 0.75 + greatest(energy_spent / 30 - 0.5, 0) * 0.5) END, 1.0), 6) AS multiplier,
round(CASE WHEN id % 3 > 0 THEN (energy_spent / 100) * (1 - 0.1 * (1.5 - coalesce(CASE WHEN id % 4 > 0 THEN 0.25 END, 0.5))) + 0.5 * 0.1 * (1.5 - coalesce(CASE WHEN id % 4 > 0 THEN 0.25 END, 0.5)) ELSE (energy_spent / 100) * (1 - 0.1 * (1.5 - coalesce(CASE WHEN id % 4 > 0 THEN 0.25 END, 0.5))) END, 8) AS valence,
round(0.3 * (1 - 0.05 * (1.5 - coalesce(CASE WHEN id % 4 > 0 THEN 0.25 END, 0.5))) + 0.3 * 0.05 * (1.5 - coalesce(CASE WHEN id % 4 > 0 THEN 0.25 END, 0.5)), 6)::DOUBLE AS arousal,
least(1.0, greatest(0.0, CASE tool_name WHEN 'click' THEN 0.7 WHEN 'error' THEN 1.5 ELSE 0.45 END))::DOUBLE AS trust FROM runs""")
def mood_and_trust(spark, sf_dir):
    e, i = F.col("energy_spent"), F.col("id")
    valence, arousal = reports.new_mood(e / 100, F.lit(None).cast("double"), F.lit(0.5), i % 3, F.when(i % 4 > 0, F.lit(0.25)))
    return derived(spark, sf_dir, "runs").select(
        "id", F.round(reports.outcome_multiplier(F.when(i % 6 > 0, e / 30 - 0.5)), 6).alias("multiplier"), F.round(valence, 8).alias("valence"), F.round(arousal, 6).alias("arousal"),
        reports.default_trust(F.concat(F.lit(" "), F.upper("tool_name")), {"click": 0.7, "error": 1.5}).alias("trust"),
    )
