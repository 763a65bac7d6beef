"""Registered filters, joins, routing, graph lookups, retention and speech, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import schedule, speech
from cairnlake.operators import filters, graph, recall, upkeep, vectors
from cairnlake.plans.base import SQL_SIM, events, query, table, vector
from cairnlake.plans.derived import ctes, derived

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _j(path: str, column: str = "metadata") -> str:
    return f"json_extract_string({column}, '$.{path}')"


# Filters


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber + 2 >= 4 AND l_linenumber <= 5 AND coalesce(CASE WHEN l_suppkey % 4 > 0 THEN l_returnflag END, '') <> 'R' AND l_linestatus = 'O'""")
def page_range_rows(spark, sf_dir):
    n = F.col("l_linenumber")
    shown = filters.not_private(F.when(F.when(F.col("l_suppkey") % 4 > 0, F.col("l_returnflag")) == "R", "private"))
    rows = table(spark, sf_dir, "lineitem").filter(filters.ranges_meet(n, n + 2, F.lit(4), F.lit(5)) & shown & filters.optional(l_linestatus="O", l_returnflag=None))
    return rows.select("l_orderkey", "l_linenumber")


@query(f"""{ctes("memories")} SELECT id, list_contains(json_keys(metadata), 'blocked_by') AS has_block, list_has_any(from_json(json_extract(metadata, '$.tags'), '["VARCHAR"]'), ['t1', 'u2']) AS tagged, starts_with(content, 'Note 1') OR starts_with(content, 'Note 22') AS listed
FROM memories WHERE {_j("category")} = 'boundary' AND list_contains(from_json(json_extract(metadata, '$.tags'), '["VARCHAR"]'), 't3')""")
def json_filters(spark, sf_dir):
    m = F.col("metadata")
    some = derived(spark, sf_dir, "memories").filter(filters.json_holds(m, {"category": "boundary", "tags": ["t3"]}))
    tags = F.from_json(F.get_json_object(m, "$.tags"), "array<string>")
    return some.select("id", filters.json_has(m, "blocked_by").alias("has_block"), F.arrays_overlap(tags, F.array(F.lit("t1"), F.lit("u2"))).alias("tagged"), filters.like_any(F.col("content"), ["Note 1", "Note 22"]).alias("listed"))


@query(f"""{ctes("memories")} SELECT id, ord::INTEGER AS ord, item FROM (SELECT id, unnest(from_json(json_extract(metadata, '$.tags'), '["VARCHAR"]')) AS item, generate_subscripts(from_json(json_extract(metadata, '$.tags'), '["VARCHAR"]'), 1) AS ord FROM memories)""")
def json_items(spark, sf_dir):
    tags = derived(spark, sf_dir, "memories").select("id", F.get_json_object("metadata", "$.tags").alias("tags"))
    return filters.json_items(tags, "tags", "id")


@query("""SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_pairs(spark, sf_dir):
    return filters.json_pairs(table(spark, sf_dir, "events"), "props", "event_id")


@query(f"""{ctes("memories")}, w AS (SELECT user_id AS key_id, max(id) AS want_id, 'doc' || CAST(user_id % 40 AS VARCHAR) AS want_hash FROM memories GROUP BY user_id)
SELECT DISTINCT m.id, w.key_id FROM memories m JOIN w ON m.id = w.want_id OR m.content_hash = w.want_hash""")
def opened_by_any_key(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    wanted = memories.groupBy(F.col("user_id").alias("key_id")).agg(F.max("id").alias("want_id")).withColumn("want_hash", F.concat(F.lit("doc"), (F.col("key_id") % 40).cast("string")))
    return filters.any_key_join(memories, wanted, "id", {"id": "want_id", "content_hash": "want_hash"})


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'x' || user_id WHEN event_id % 4 = 1 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS ref FROM events)
SELECT event_id, c_custkey, c_mktsegment FROM t JOIN customer ON ref ~ '^[0-9]+$' AND TRY_CAST(ref AS BIGINT) = c_custkey""")
def guarded_cast_join(spark, sf_dir):
    i = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i == 0, F.concat(F.lit("x"), "user_id")).when(i > 1, F.col("user_id").cast("string")).alias("ref"))
    return filters.guarded_cast_join(rows, "ref", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("event_id", "c_custkey", "c_mktsegment")


@query(f"""{ctes("units", "tasks")} SELECT t.id AS task_id, u.id, u.route_status FROM tasks t JOIN units u ON list_contains([t.trigger_unit_id, t.source_unit_id], u.id)""")
def units_of_tasks(spark, sf_dir):
    tasks = derived(spark, sf_dir, "tasks").select(F.col("id").alias("task_id"), F.array("trigger_unit_id", "source_unit_id").alias("units"))
    return filters.member_join(tasks, "units", derived(spark, sf_dir, "units").select("id", "route_status"), "id").select("task_id", "id", "route_status")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.value - b.value) <= 0.25""")
def close_pairs(spark, sf_dir):
    return filters.pairs_within(table(spark, sf_dir, "events"), "user_id", "value", 0.25, "event_id")


# Recall


@query(f"""{ctes("memories")} SELECT id, type, substr(content, 1, 8) AS preview, length(content)::INTEGER AS n_chars FROM memories WHERE status = 'active' AND (valid_until IS NULL OR valid_until > {NOW}) AND type IN ('episodic', 'goal') ORDER BY last_accessed DESC NULLS LAST, id LIMIT 25""")
def recent_previews(spark, sf_dir):
    some = recall.recent(derived(spark, sf_dir, "memories"), 25, _now(), types=["episodic", "goal"], by_access=True)
    return recall.previews(some, 8).select("id", "type", "preview", "n_chars")


@query(f"""{ctes("memories")} SELECT id, type, substr(content, 1, 12) AS content FROM memories WHERE id IN (3, 5, 8, 13, 21, 34, 1000000)""")
def by_ids(spark, sf_dir):
    return recall.by_ids(derived(spark, sf_dir, "memories"), [3, 5, 8, 13, 21, 34, 1_000_000], 12).select("id", "type", "content")


@query(f"""{ctes("memories")} SELECT m.id, round(0.5 * importance + 0.1, 6) AS score FROM memories m WHERE type IN ('worldview', 'goal') AND importance >= 0.03 AND content_hash = 'doc9' AND created_at >= TIMESTAMP '2024-01-03' AND created_at < {NOW} AND {_j("source")} = 'click' ORDER BY score DESC, created_at DESC, id LIMIT 15""")
def structured_recall(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    hits = memories.select("id", (F.col("importance") * 0.5 + 0.1).alias("score"))
    out = recall.structured(hits, memories, 15, types=["worldview", "goal"], least_importance=0.03, content_hash="doc9", after=F.lit("2024-01-03").cast("timestamp"), before=_now(), holds={"source": "click"})
    return out.select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id, round(CASE WHEN vec_id % 5 > 0 THEN (vec_id % 7)::DOUBLE / (vec_id % 5) END, 6) AS success_rate, round({SQL_SIM}, 6) AS similarity FROM embeddings e WHERE label % 3 = 1 ORDER BY {SQL_SIM} DESC, vec_id LIMIT 12""")
def procedural_search(spark, sf_dir):
    df, v = table(spark, sf_dir, "embeddings").filter("label % 3 = 1"), F.col("vec_id")
    out = vectors.nearest_of_type(df, vector(spark, sf_dir), 12, v % 7, v % 5)
    return out.select("vec_id", F.round("success_rate", 6).alias("success_rate"), F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT vec_id, round(max(s), 6) AS similarity FROM (SELECT vec_id, {SQL_SIM} AS s FROM embeddings e WHERE label % 4 = 2 AND {SQL_SIM} > 0.15
UNION ALL SELECT vec_id, 1.0 FROM embeddings WHERE label % 4 = 2 AND (vec_id % 9 = 1 OR vec_id % 9 = 4)) GROUP BY vec_id""")
def boundary_hits(spark, sf_dir):
    v = F.col("vec_id")
    words = F.when(v % 9 == 1, F.array(F.lit("zzz"), F.lit("PRIVATE key"))).when(v % 9 == 4, F.array(F.lit("my"))).when(v % 9 == 5, F.array(F.lit("other")))
    df = table(spark, sf_dir, "embeddings").filter("label % 4 = 2").select("vec_id", "embedding", words.alias("patterns"))
    return vectors.boundary_hits(df, vector(spark, sf_dir), "Tell me my private KEY", 0.15).withColumn("similarity", F.round("similarity", 6))


_SQL_NEAR = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS k FROM s)"""


def _near(spark, sf_dir, k):
    df = table(spark, sf_dir, "embeddings")
    return vectors.nearest_of_each(df, df.filter("vec_id % 50 = 0"), k)


@query(f"""WITH {_SQL_NEAR}, e AS (SELECT query_id, min(id) FILTER (k = 1) AS best, max(sim) AS top FROM r WHERE k <= 20 AND id % 3 = 0 GROUP BY 1),
b AS (SELECT query_id, arg_max(id, sim) AS best, max(sim) AS top FROM r WHERE k <= 20 AND id % 3 = 0 GROUP BY 1), n AS (SELECT query_id, count(*) FILTER (sim >= 0.3) AS n FROM r WHERE k <= 20 GROUP BY 1)
SELECT n.query_id, CASE WHEN coalesce(top >= 0.45, false) THEN 'merge' WHEN n >= 5 THEN 'create' ELSE 'raw_only' END AS decision, CASE WHEN top >= 0.45 THEN best END AS episode FROM n LEFT JOIN b USING (query_id)""")
def unit_routes(spark, sf_dir):
    near = _near(spark, sf_dir, 20)
    first = near.filter("id % 3 = 0").groupBy("query_id").agg(F.max_by("id", "similarity").alias("id"), F.max("similarity").alias("similarity")).withColumn("rank", F.lit(1))
    return vectors.route_decisions(near, first, merge=0.45, near=0.3)


@query(f"""WITH {_SQL_NEAR}, o AS (SELECT query_id AS a, id AS b FROM r WHERE k = 1 AND query_id % 100 = 0)
SELECT query_id, id, round(sim, 6) AS similarity FROM r WHERE k <= 10 AND sim >= 0.25 AND NOT EXISTS (SELECT 1 FROM o WHERE least(a, b) = least(query_id, id) AND greatest(a, b) = greatest(query_id, id))""")
def contradiction_candidates(spark, sf_dir):
    near = _near(spark, sf_dir, 10)
    ledger = near.filter("rank = 1 and query_id % 100 = 0").select(F.col("id").alias("a"), F.col("query_id").alias("b"))
    return vectors.contradiction_candidates(near, ledger, 0.25).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_SQL_NEAR} SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0 AND vec_id NOT IN (SELECT query_id FROM r WHERE sim >= 0.4)""")
def new_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return vectors.new_facts(_near(spark, sf_dir, 1), facts, 0.4)


# Graph


@query(f"""{ctes("edges")} SELECT src, dst, rel, arg_max(strength, seq) AS weight, count(*) AS edges FROM edges GROUP BY 1, 2, 3""")
def upserted_edges(spark, sf_dir):
    return graph.upserted_edges(derived(spark, sf_dir, "edges").withColumnRenamed("strength", "weight"))


@query(f"""{ctes("edges")} SELECT src AS id, max(coalesce(strength, 0)) AS strength, 'evidence' AS role FROM edges WHERE dst = 7 AND rel = 'SUPPORTS' GROUP BY 1
UNION ALL SELECT src, coalesce(strength, 1), 'member' FROM edges WHERE dst = 7 AND rel = 'MEMBER_OF'""")
def node_context(spark, sf_dir):
    edges = derived(spark, sf_dir, "edges")
    found = graph.evidence(edges, 7).withColumn("role", F.lit("evidence"))
    return found.unionByName(graph.members_of(edges, 7).withColumn("role", F.lit("member")))


@query(f"""{ctes("edges", "memories")}, b AS (SELECT src AS id, max(strength) AS strength FROM edges WHERE concept = 3 GROUP BY 1)
SELECT b.id, strength, importance FROM b JOIN memories m ON m.id = b.id ORDER BY strength DESC NULLS LAST, importance DESC NULLS LAST, b.id LIMIT 10""")
def concept_members(spark, sf_dir):
    links = derived(spark, sf_dir, "edges").select(F.col("src").alias("id"), "concept", "strength")
    return graph.concept_members(links, derived(spark, sf_dir, "memories"), 3)


@query(f"""{ctes("edges")}, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY coalesce(strength, 0) DESC, src, rel) AS k FROM edges)
SELECT concept, src, rel, coalesce(strength, 0) AS strength FROM r WHERE k = 1 ORDER BY coalesce(strength, 0) DESC, concept LIMIT 20""")
def strongest_links(spark, sf_dir):
    return graph.best_edges(derived(spark, sf_dir, "edges"), "concept")


@query(f"""{ctes("edges")}, g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE rel = 'CONTRADICTS' AND src <> dst),
l AS (SELECT DISTINCT a, b, CASE WHEN (a + b) % 2 = 0 THEN 'pending' ELSE 'closed' END AS status FROM g WHERE (a + b) % 5 < 2)
SELECT a, b, 'ledger' AS origin FROM l WHERE status = 'pending' UNION ALL SELECT a, b, 'graph' FROM g WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.a = g.a AND l.b = g.b)""")
def contested_pairs(spark, sf_dir):
    edges = derived(spark, sf_dir, "edges")
    some = edges.filter("rel = 'CONTRADICTS' and src <> dst and (src + dst) % 5 < 2")
    status = F.when((F.col("src") + F.col("dst")) % 2 == 0, "pending").otherwise("closed")
    return graph.contested_pairs(edges, some.select(F.col("dst").alias("a"), F.col("src").alias("b"), status.alias("status")))


@query(f"""{ctes("edges")} SELECT id, direction FROM (SELECT DISTINCT src AS id, CASE rel WHEN 'CONTRADICTS' THEN 1 ELSE 2 END::INTEGER AS direction FROM edges WHERE dst = 11 AND rel IN ('CONTRADICTS', 'SUPPORTS')) ORDER BY direction, id LIMIT 5 OFFSET 2""")
def reconsidered_page(spark, sf_dir):
    return graph.reconsidered(derived(spark, sf_dir, "edges"), 11, 5, 2)


@query(f"""{ctes("edges")} SELECT DISTINCT CASE WHEN src = 3 THEN dst ELSE src END AS id, CASE rel WHEN 'SUPPORTS' THEN 'evidence' ELSE 'blocker' END AS link FROM edges WHERE (src = 3 OR dst = 3) AND rel IN ('SUPPORTS', 'CONTRADICTS')""")
def goal_links(spark, sf_dir):
    return graph.goal_links(derived(spark, sf_dir, "edges"), 3, {"SUPPORTS": "evidence", "CONTRADICTS": "blocker"})


@query("""WITH RECURSIVE n AS (SELECT s_suppkey AS step, s_suppkey // 2 AS needs FROM supplier WHERE s_suppkey // 2 >= 1 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey // 3 >= 1),
l AS (SELECT s_suppkey AS step, 0 AS layer FROM supplier WHERE s_suppkey NOT IN (SELECT step FROM n) UNION SELECT n.step, l.layer + 1 FROM l JOIN n ON n.needs = l.step)
SELECT step, max(layer)::INTEGER AS layer FROM l GROUP BY 1""")
def plan_layers(spark, sf_dir):
    steps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("step"))
    half, third = (steps.select("step", F.expr(f"step div {k}").alias("needs")).filter("needs >= 1") for k in (2, 3))
    return graph.plan_layers(steps, half.unionByName(third))


# Retention


@query(f"""{ctes("runs", "units", "tasks")} SELECT 'usage' AS kind, count(*) AS gone FROM runs WHERE created_at < {NOW} - INTERVAL 25 DAY
UNION ALL SELECT 'cache', count(*) FROM units WHERE updated_at < {NOW} - INTERVAL 7 DAY UNION ALL SELECT 'log', count(*) FROM tasks WHERE completed_at < {NOW} - INTERVAL 168 HOUR""")
def expired_rows(spark, sf_dir):
    some = {"usage": ("runs", "created_at", 25), "cache": ("units", "updated_at", 7), "log": ("tasks", "completed_at", 7)}
    parts = [upkeep.expired(derived(spark, sf_dir, name), F.col(ts), _now(), days).agg(F.count("*").alias("gone")).select(F.lit(kind).alias("kind"), "gone") for kind, (name, ts, days) in some.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{ctes("memories")} SELECT id, coalesce(id % 23 = 0, false) OR coalesce(importance, 0) >= 0.75 OR coalesce(access_count, 0) >= 3 AS promote FROM memories WHERE valid_until < TIMESTAMP '2024-01-15'""")
def lapsed_memories(spark, sf_dir):
    rows = derived(spark, sf_dir, "memories").withColumn("expiry", F.col("valid_until")).withColumn("promote", F.when(F.col("id") % 23 == 0, True))
    return upkeep.lapsed(rows, F.lit("2024-01-15").cast("timestamp")).select("id", "promote")


_SQL_PROTECTED = f"""(type IN ('worldview', 'goal') OR coalesce(importance, 0) >= 0.85 OR abs(coalesce({_j("emotional_valence")}::DOUBLE, 0)) >= 0.7 OR coalesce({_j("protected")}::BOOLEAN, false) OR content_hash IS NOT NULL)"""


@query(f"""{ctes("memories")} SELECT id, {_SQL_PROTECTED} AS protected, status = 'active' AND NOT {_SQL_PROTECTED} AND (coalesce(importance, 0) >= 0.85 - 0.15 OR abs(coalesce({_j("emotional_valence")}::DOUBLE, 0)) >= 0.7 - 0.15) AS borderline FROM memories""")
def protected_memories(spark, sf_dir):
    return derived(spark, sf_dir, "memories").select("id", upkeep.protected().alias("protected"), upkeep.borderline(_now()).alias("borderline"))


@query(f"""{ctes("memories")}, m AS (SELECT * FROM memories WHERE status = 'active' AND type = 'episodic' AND NOT {_SQL_PROTECTED})
SELECT user_id, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS ids, sha256(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY created_at, id)) AS content_hash, least(1.0, coalesce(max(importance), 0.5)) AS importance,
round(avg({_j("emotional_valence")}::DOUBLE), 6) AS valence, bool_or(coalesce(sensitivity = 'private', false)) AS private FROM m GROUP BY user_id HAVING count(*) >= 2""")
def merged_groups(spark, sf_dir):
    out = upkeep.merged_groups(derived(spark, sf_dir, "memories"), "user_id")
    return out.select("user_id", "ids", F.sha2("content", 256).alias("content_hash"), "importance", F.round("valence", 6).alias("valence"), "private")


_STALE = "TIMESTAMP '2024-03-01'"


@query(f"""{ctes("memories")}, d AS (SELECT content_hash, count(*) AS memory_count, max(epoch_us({_STALE}) - epoch_us(created_at)) AS old, min(epoch_us({_STALE}) - epoch_us(greatest(last_reinforced, last_accessed, created_at))) AS idle
FROM memories WHERE status = 'active' AND content_hash IS NOT NULL AND NOT coalesce({_j("protected")}::BOOLEAN, false) GROUP BY 1)
SELECT content_hash, memory_count FROM d WHERE old >= 20 * 86400000000 AND idle >= 29 * 86400000000 AND content_hash NOT IN ('doc9', 'doc18')""")
def stale_documents(spark, sf_dir):
    asked = spark.createDataFrame([("doc9", "pending"), ("doc18", "pending"), ("doc27", "denied")], "content_hash string, status string")
    return upkeep.stale_documents(derived(spark, sf_dir, "memories"), asked, F.lit("2024-03-01").cast("timestamp"), 20, 29)


@query(f"""{ctes("units", "tasks")}, o AS (SELECT trigger_unit_id AS id FROM tasks WHERE status IN ('pending', 'in_progress') UNION SELECT source_unit_id FROM tasks WHERE status IN ('pending', 'in_progress'))
SELECT id, CASE WHEN route_status IN ('merged', 'episode_created') THEN 'consolidated' ELSE 'idle_raw' END AS reason FROM units u WHERE status = 'active' AND pinned_at IS NULL AND id NOT IN (SELECT id FROM o) AND (
 (route_status IN ('merged', 'episode_created') AND consolidated_at IS NOT NULL AND greatest(last_accessed, consolidated_at) < {NOW} - INTERVAL 7 DAY)
 OR (route_status IN ('raw_only', 'route_failed') AND extraction_status IN ('extracted', 'skipped', 'failed') AND coalesce(last_routed_at, updated_at, created_at) < {NOW} - INTERVAL 12 DAY AND coalesce(last_accessed, created_at) < {NOW} - INTERVAL 12 DAY)
 OR (embedding_status = 'failed' AND extraction_status IN ('extracted', 'skipped', 'failed') AND coalesce(last_accessed, created_at) < {NOW} - INTERVAL 12 DAY))""")
def archive_reasons(spark, sf_dir):
    tasks = derived(spark, sf_dir, "tasks").withColumn("source_unit_ids", F.array("source_unit_id"))
    return upkeep.archive_reasons(derived(spark, sf_dir, "units"), tasks, _now(), idle_days=12)


@query(f"""{ctes("units")} SELECT id FROM units WHERE status = 'active' AND route_status = 'raw_only' AND coalesce(last_routed_at, created_at) < {NOW} - INTERVAL 7 DAY ORDER BY coalesce(last_routed_at, created_at), id LIMIT 40""")
def units_to_reroute(spark, sf_dir):
    return upkeep.to_reroute(derived(spark, sf_dir, "units"), _now(), most=40)


@query("""WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN 'v1' WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'v2' END AS version FROM lineitem WHERE l_orderkey % 4 > 0),
p AS (SELECT doc_id, bool_or(version IS DISTINCT FROM 'v2') AS other FROM c GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN other IS NULL THEN 'missing' ELSE 'outdated' END AS reason FROM orders LEFT JOIN p ON doc_id = o_orderkey WHERE other IS NULL OR other""")
def rechunk_candidates(spark, sf_dir):
    k = F.col("l_orderkey")
    version = F.when((k % 3 == 0) & (F.col("l_linenumber") == 2), "v1").when(k % 7 != 0, "v2")
    chunks = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 > 0").select(k.alias("doc_id"), version.alias("version"))
    return upkeep.rechunk_candidates(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), chunks, "v2")


@query(f"""{ctes("runs")}, p AS (SELECT *, CASE WHEN worker % 3 > 0 THEN CAST(worker AS VARCHAR) END AS channel_id, CASE WHEN id % 4 > 0 THEN created_at + INTERVAL 20 DAY END AS expires_at FROM runs),
r AS (SELECT *, row_number() OVER (PARTITION BY tool_name, coalesce(channel_id, ''), tool_context ORDER BY created_at DESC, id DESC) AS k FROM p WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25')
SELECT id, tool_name AS channel, channel_id FROM r WHERE k = 1""")
def channel_presence(spark, sf_dir):
    rows = derived(spark, sf_dir, "runs").select("id", F.col("tool_name").alias("channel"), F.when(F.col("worker") % 3 > 0, F.col("worker").cast("string")).alias("channel_id"), F.col("tool_context").alias("kind"), F.col("created_at").alias("seen_at"), F.when(F.col("id") % 4 > 0, F.col("created_at") + F.expr("interval 20 days")).alias("expires_at"))
    return upkeep.presence(rows, F.lit("2024-01-25").cast("timestamp")).select("id", "channel", "channel_id")


@query(f"""{ctes("runs")} SELECT id FROM runs WHERE id % 3 > 0 AND created_at <= TIMESTAMP '2024-01-10' ORDER BY created_at, id LIMIT 35""")
def due_tasks(spark, sf_dir):
    rows = derived(spark, sf_dir, "runs").select("id", F.when(F.col("id") % 3 > 0, "active").otherwise("paused").alias("status"), F.col("created_at").alias("next_run_at"))
    return upkeep.due(rows, F.lit("2024-01-10").cast("timestamp"), 35).select("id")


# Speech and schedules

_SQL_SAID = """t AS (SELECT conv_id, turn, CASE turn % 9 WHEN 0 THEN 'Please remember: always use the blue door' WHEN 1 THEN 'Is it urgent? My exam is tomorrow.' WHEN 2 THEN 'When I write, reply at once.' WHEN 3 THEN 'When should I call?' WHEN 4 THEN text || text || text WHEN 5 THEN NULL ELSE text END AS said, text AS answered FROM conversations)"""


def _said(spark, sf_dir):
    t, turn = table(spark, sf_dir, "conversations"), F.col("turn") % 9
    said = F.when(turn == 0, "Please remember: always use the blue door").when(turn == 1, "Is it urgent? My exam is tomorrow.").when(turn == 2, "When I write, reply at once.").when(turn == 3, "When should I call?").when(turn == 4, F.concat("text", "text", "text")).when(turn != 5, F.col("text"))
    return t.select("conv_id", "turn", said.alias("said"), F.col("text").alias("answered"))


def _list(phrases: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


@query(f"""WITH {_SQL_SAID}, b AS (SELECT *, lower(coalesce(said, '') || chr(10) || coalesce(answered, '')) AS c, lower(coalesce(said, '')) AS m FROM t),
s AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN length(m) >= 1200 THEN 0.2 WHEN length(m) >= 400 THEN 0.1 ELSE 0 END + CASE WHEN contains(m, '?') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(m, '{speech.URGENT}') THEN 0.3 ELSE 0 END
 + CASE WHEN regexp_matches(m, '{speech.HARMFUL}') THEN 0.45 ELSE 0 END + CASE WHEN regexp_matches(m, '{speech.PERSONAL}') THEN 0.2 ELSE 0 END + CASE WHEN turn % 2 > 0 THEN 0.15 ELSE 0 END)) AS sal FROM b)
SELECT conv_id, turn, round(least(1.0, greatest(0.15, 0.3, CASE WHEN length(coalesce(said, '')) > 200 OR length(coalesce(answered, '')) > 500 THEN 0.7 ELSE 0 END,
 CASE WHEN len(list_filter({_list(speech.LASTING)}, lambda p: contains(c, p))) > 0 THEN 0.8 ELSE 0 END, CASE WHEN len(list_filter({_list(speech.AWAITED)}, lambda p: contains(c, p))) > 0 THEN 0.65 ELSE 0 END)), 4)::DOUBLE AS importance,
 round(sal, 4)::DOUBLE AS salience, CASE WHEN sal >= 0.65 THEN 'deep' WHEN sal < 0.2 THEN 'skim' ELSE 'normal' END AS depth FROM s""")
def turn_weights(spark, sf_dir):
    salient = speech.salience(F.col("said"), F.col("turn") % 2)
    return _said(spark, sf_dir).select("conv_id", "turn", F.round(speech.turn_importance(F.col("said"), F.col("answered"), F.lit(0.3)), 4).alias("importance"), F.round(salient, 4).alias("salience"), speech.depth(salient).alias("depth"))


_E, _Z = "(^|[[:space:][:punct:]])", "([[:space:][:punct:]]|$)"


@query(f"""WITH {_SQL_SAID}, n AS (SELECT conv_id, turn, regexp_replace(trim(substr(coalesce(said, ''), 1, 4000)), '\\s+', ' ', 'g') AS d FROM t),
m AS (SELECT *, lower(d) AS l FROM n), k AS (SELECT *, regexp_matches(l, '{_E}{speech.STANDING.replace("'", "''")}{_Z}') AS strong, regexp_matches(l, '{_E}{speech.WHENEVER}{_Z}') AS loose, regexp_matches(l, '{_E}{speech.DEEDS}{_Z}') AS deed FROM m)
SELECT conv_id, turn, CASE WHEN deed AND (strong OR loose) AND NOT (ends_with(d, '?') AND NOT strong) THEN 'operator.standing.' || substr(sha256(lower(regexp_replace(d, '[\\s[:punct:]]+$', ''))), 1, 24) END AS policy_key FROM k""")
def standing_instructions(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", speech.standing_instruction(F.col("said")).alias("policy_key"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'sms' END AS channel, ' ' || CASE WHEN c_custkey % 2 = 0 THEN c_name || ' <' || upper(c_mktsegment) || '@X.org> ' ELSE c_name END AS given, CASE c_custkey % 4 WHEN 0 THEN ' Search_Query : ' || c_name WHEN 1 THEN NULL ELSE c_name END AS asked,
 CASE c_custkey % 6 WHEN 0 THEN ' Tues ' WHEN 1 THEN '0' WHEN 2 THEN 'Sunday' WHEN 3 THEN '9' WHEN 4 THEN '3' ELSE NULL END AS day FROM customer)
SELECT c_custkey, coalesce(CASE WHEN channel = 'email' THEN nullif(regexp_extract(lower(trim(given)), '<([^>]+)>', 1), '') END, lower(trim(given))) AS address,
CASE WHEN regexp_matches(asked, '(?i)^\\s*(search_document|search_query|clustering|classification)\\s*:') THEN ltrim(asked) ELSE 'search_document: ' || asked END AS input,
CASE trim(lower(day)) WHEN 'tues' THEN 2 WHEN '0' THEN 7 WHEN 'sunday' THEN 7 WHEN '3' THEN 3 END::INTEGER AS weekday FROM c""")
def addresses(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    given = F.concat(F.lit(" "), F.when(k % 2 == 0, F.concat("c_name", F.lit(" <"), F.upper("c_mktsegment"), F.lit("@X.org> "))).otherwise(F.col("c_name")))
    asked = F.when(k % 4 == 0, F.concat(F.lit(" Search_Query : "), "c_name")).when(k % 4 != 1, F.col("c_name"))
    day = F.when(k % 6 == 0, " Tues ").when(k % 6 == 1, "0").when(k % 6 == 2, "Sunday").when(k % 6 == 3, "9").when(k % 6 == 4, "3")
    return c.select("c_custkey", speech.address(F.when(k % 3 == 0, "email").otherwise("sms"), given).alias("address"), speech.embedding_prefix(asked).alias("input"), speech.weekday(day).alias("weekday"))


_CRONS = ("*/15 8-18 * * MON-FRI", "5 0 1,15 * *", "30 6 13 * 5", "0 12 29 2 *", "10/20 23 * JAN,DEC 0,7", "0 0 5 * * 30")


_SQL_CRON = """d AS (SELECT event_id, kind, ts, unnest(range(date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 DAY * CASE kind WHEN 3 THEN 1500 WHEN 0 THEN 5 WHEN 4 THEN 360 ELSE 70 END, INTERVAL 1 DAY)) AS day FROM c),
e AS (SELECT *, isodow(day) % 7 AS w, day(day) AS dom, month(day) AS mon FROM d),
ok AS (SELECT * FROM e WHERE CASE kind WHEN 0 THEN w BETWEEN 1 AND 5 WHEN 1 THEN dom IN (1, 15) WHEN 2 THEN dom = 13 OR w = 5 WHEN 3 THEN dom = 29 AND mon = 2 WHEN 4 THEN mon IN (1, 12) AND w = 0 ELSE dom = 5 END),
f AS (SELECT event_id, ts, day, unnest(CASE kind WHEN 0 THEN range(480, 1140, 15) WHEN 1 THEN [5] WHEN 2 THEN [390] WHEN 3 THEN [720] WHEN 4 THEN [1390, 1410, 1430] ELSE [0] END) AS m FROM ok)"""


@query(f"""WITH c AS (SELECT event_id, ts, (event_id % 6)::INTEGER AS kind FROM events), {_SQL_CRON}
SELECT event_id, min(day + to_minutes(m)) AS next_at FROM f WHERE day + to_minutes(m) > ts GROUP BY 1""")
def cron_times(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = [F.when(F.col("event_id") % 6 == k, schedule.next_cron(cron, F.col("ts"))) for k, cron in enumerate(_CRONS)]
    return rows.select("event_id", F.coalesce(*found).alias("next_at"))


#: Zones by event: known ones, none, a blank one, and one that there is not.
_ZONES = ("America/New_York", " Asia/Tokyo ", "Europe/Berlin", "", "Mars/Olympus", "UTC")
_SQL_ZONE = "CASE event_id % 7 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'Europe/Berlin' WHEN 4 THEN NULL ELSE 'UTC' END"


@query(f"""WITH z AS (SELECT event_id, ts AS utc, event_id % 7 = 4 AS unknown, coalesce({_SQL_ZONE}, 'UTC') AS zone, event_id % 5 AS kind FROM events),
l AS (SELECT *, timezone(zone, utc::TIMESTAMPTZ) AS ts, to_seconds((event_id % 24) * 3600 + 1800) AS tod, event_id % 7 + 1 AS dow FROM z),
c AS (SELECT event_id, ts, 0 AS kind FROM l WHERE kind = 4), {_SQL_CRON}, cr AS (SELECT event_id, min(day + to_minutes(m)) AS nxt FROM f WHERE day + to_minutes(m) > ts GROUP BY 1),
r AS (SELECT l.event_id, unknown, CASE l.kind WHEN 0 THEN CASE WHEN TIMESTAMP '2024-01-20 05:00:00' > utc THEN TIMESTAMP '2024-01-20 05:00:00' END
  WHEN 1 THEN CASE WHEN l.event_id % 3 = 0 THEN NULL WHEN utc < TIMESTAMP '2024-01-10' THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-10' + to_seconds((floor((epoch_us(utc) - epoch_us(TIMESTAMP '2024-01-10')) / 5400000000.0) + 1) * 5400) END
  WHEN 2 THEN timezone(zone, CASE WHEN date_trunc('day', l.ts) + tod > l.ts THEN date_trunc('day', l.ts) + tod ELSE date_trunc('day', l.ts) + tod + INTERVAL 1 DAY END)::TIMESTAMP
  WHEN 3 THEN timezone(zone, CASE WHEN date_trunc('day', l.ts) + to_days(((dow - isodow(l.ts) + 7) % 7)::INTEGER) + tod > l.ts THEN date_trunc('day', l.ts) + to_days(((dow - isodow(l.ts) + 7) % 7)::INTEGER) + tod
    ELSE date_trunc('day', l.ts) + to_days(((dow - isodow(l.ts) + 7) % 7 + 7)::INTEGER) + tod END)::TIMESTAMP
  ELSE timezone(zone, cr.nxt)::TIMESTAMP END AS nxt, l.kind FROM l LEFT JOIN cr USING (event_id))
SELECT event_id, CASE WHEN unknown AND kind > 1 THEN NULL ELSE nxt END AS next_at FROM r""")
def zoned_runs(spark, sf_dir):
    e, ts = F.col("event_id"), F.col("ts")
    zone = F.coalesce(*[F.when(e % 7 == k, F.lit(z)) for k, z in ((0, _ZONES[0]), (1, _ZONES[1]), (2, _ZONES[2]), (3, _ZONES[3]), (4, _ZONES[4]), (5, _ZONES[5]))])
    hour, day = (e % 24).cast("string"), F.element_at(F.array(*[F.lit(x) for x in schedule.DAY_NAMES]), (e % 7 + 1).cast("int"))
    interval = F.when(e % 3 == 0, '{"every_minutes":0}').when(e % 3 == 1, '{"every_minutes":90,"anchor_at":"2024-01-10 00:00:00"}').otherwise('{"every_seconds":5400,"anchor_at":"2024-01-10T00:00:00Z"}')
    plan = (
        F.when(e % 5 == 0, '{"run_at":"2024-01-20 05:00:00"}').when(e % 5 == 1, interval).when(e % 5 == 2, F.concat(F.lit('{"time":"'), hour, F.lit(':30"}')))
        .when(e % 5 == 3, F.concat(F.lit('{"time":"'), hour, F.lit(':30:00","weekday":" '), F.initcap(day), F.lit('"}'))).otherwise('{"cron":"' + _CRONS[0] + '"}')
    )
    kind = F.element_at(F.array(*map(F.lit, ("Once", "interval", " daily", "weekly", "cron"))), (e % 5 + 1).cast("int"))
    found = schedule.next_run(kind, plan, zone, ts, _CRONS[:1])
    return events(spark, sf_dir).select("event_id", found.alias("next_at"))
