"""Queries on whole cycles: retention, subgraphs, statistics and what is carried over."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import graph, retention, surface
from cairnlake.plans.base import query, table
from cairnlake.plans.derived import ctes, derived
from cairnlake.plans.upkeep import _SQL_PROTECTED, _j

#: A time at which the events of the tables are old.
LATE = "2024-03-15 00:00:00"
_SQL_LATE = f"TIMESTAMP '{LATE}'"


def _late():
    return F.lit(LATE).cast("timestamp")


def _state(spark, sf_dir) -> retention.State:
    rows = derived(spark, sf_dir, "memories")
    i = F.col("id")
    memories = rows.withColumns({
        "importance": F.when(F.col("importance") > 1, F.col("importance") / 10).otherwise(F.col("importance")), "episode": F.when(i % 6 == 1, F.col("user_id")),
        "superseded_by": F.when((i % 11 == 3) & (i % 2 == 0), i + 1), "archived_at": F.when(i % 11 == 3, F.col("created_at") + F.expr("INTERVAL 30 DAY")),
    })
    memories = memories.withColumns({"superseded_by": F.col("superseded_by").cast("long")}).select(*retention.MEMORY)
    reviews = memories.filter("episode = 3 and type = 'episodic'").groupBy("episode").agg(F.collect_list("id").alias("ids")).select("episode", "ids", F.lit("pending").alias("status"))
    k = F.col("k")
    asked = spark.range(0, 40).withColumnRenamed("id", "k").filter("k % 9 = 0")
    requests = asked.select(F.concat(F.lit("doc"), k.cast("string")).alias("content_hash"), F.when(k % 2 == 0, "pending").otherwise("denied").alias("status"), F.lit(1).cast("long").alias("memory_count"))
    d = F.col("d")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d")).select(
        d.alias("id"), F.concat(F.lit("doc"), (d % 60).cast("string")).alias("content_hash"), F.lit("active").alias("status"), F.when(d % 3 > 0, "agent").otherwise("user").alias("acquisition"),
        (_late() - F.expr("make_dt_interval(CAST(d % 200 AS INT))")).alias("last_ingested_at"), F.when(d % 4 == 0, _late() - F.expr("make_dt_interval(CAST(d % 90 AS INT))")).alias("last_touched"), (d % 7 == 1).alias("on_desk"),
    )
    return retention.State(memories, reviews, requests, documents)


def _sql_strength(alias: str = "") -> str:
    return f"greatest(0.0, least(1.0, coalesce({alias}importance, 0.5) * exp(-greatest(coalesce({alias}decay_rate, 0.01), 0.0) * greatest((epoch_us({_SQL_LATE}) - epoch_us(coalesce({alias}last_reinforced, {alias}created_at))) / 86400000000.0, 0.0))))"


def _sql_age(x: str) -> str:
    return f"((epoch_us({_SQL_LATE}) - epoch_us({x})) / 86400000000.0)"


_TOUCHY = f"(status = 'active' AND NOT {_SQL_PROTECTED} AND (coalesce(importance, 0) >= 0.85 - 0.15 OR abs(coalesce({_j('emotional_valence')}::DOUBLE, 0)) >= 0.7 - 0.15))"


def _sql_groups(source: str, name: str) -> str:
    return f"""{name} AS (SELECT episode, list(id ORDER BY created_at, id) AS ids, bool_or({_TOUCHY}) AS touchy FROM {source} WHERE type = 'episodic' AND status = 'active' AND episode IS NOT NULL AND NOT {_SQL_PROTECTED}
  AND {_sql_age('created_at')} >= 30 AND (last_reinforced IS NULL OR {_sql_age('last_reinforced')} >= 21) AND {_sql_strength()} < 0.4 GROUP BY episode HAVING count(*) >= 3)"""


def _sql_status(tag: str, mem: str, groups: str, reviews: str, requests: str, documents: str) -> str:
    live = "status = 'active' AND type = 'episodic'"
    return f"""{tag} AS (SELECT unnest(['active', 'mass', 'archived', 'gists', 'protected_documents', 'candidate_groups', 'reviews_pending', 'approvals_pending', 'archived_documents']) AS measure,
  unnest([(SELECT count(*)::DOUBLE FROM {mem} WHERE {live}), (SELECT round(coalesce(sum({_sql_strength()}), 0), 2) FROM {mem} WHERE {live}), (SELECT count(*)::DOUBLE FROM {mem} WHERE status = 'archived'),
  (SELECT count(*)::DOUBLE FROM {mem} WHERE status = 'active' AND {_j('consolidation.role')} = 'merged'), (SELECT count(DISTINCT content_hash)::DOUBLE FROM {mem} WHERE status = 'active'),
  (SELECT count(*)::DOUBLE FROM {groups}), (SELECT count(*)::DOUBLE FROM {reviews}), (SELECT count(*)::DOUBLE FROM {requests} WHERE status = 'pending'), (SELECT count(*)::DOUBLE FROM {documents} WHERE status = 'archived')]) AS amount)"""


_USED = "greatest(last_reinforced, last_accessed, created_at)"
_CAPACITY = 60.0
_SQL_CYCLE = f"""m0 AS (SELECT id, type, status, content, CASE WHEN importance > 1 THEN importance / 10 ELSE importance END AS importance, decay_rate, created_at, last_reinforced, last_accessed, metadata, content_hash, sensitivity,
  CASE WHEN id % 6 = 1 THEN user_id END AS episode, CASE WHEN id % 11 = 3 AND id % 2 = 0 THEN id + 1 END AS superseded_by, CASE WHEN id % 11 = 3 THEN created_at + INTERVAL 30 DAY END AS archived_at FROM memories),
rv0 AS (SELECT id FROM m0 WHERE episode = 3 AND type = 'episodic'), rq0 AS (SELECT 'doc' || k AS content_hash, CASE WHEN k % 2 = 0 THEN 'pending' ELSE 'denied' END AS status FROM range(0, 40) t(k) WHERE k % 9 = 0),
dc0 AS (SELECT doc_id AS id, 'doc' || doc_id % 60 AS content_hash, 'active' AS status, CASE WHEN doc_id % 3 > 0 THEN 'agent' ELSE 'user' END AS acquisition, {_SQL_LATE} - to_days((doc_id % 200)::INTEGER) AS last_ingested_at,
  CASE WHEN doc_id % 4 = 0 THEN {_SQL_LATE} - to_days((doc_id % 90)::INTEGER) END AS last_touched, doc_id % 7 = 1 AS on_desk FROM documents),
{_sql_groups('m0', 'g0')}, b0 AS (SELECT * FROM g0 ORDER BY episode LIMIT 8), w0 AS (SELECT * FROM b0 WHERE NOT EXISTS (SELECT 1 FROM rv0 WHERE list_contains(b0.ids, rv0.id))),
r1 AS (SELECT episode FROM w0 WHERE touchy ORDER BY episode LIMIT 3), k1 AS (SELECT * FROM w0 WHERE episode NOT IN (SELECT episode FROM r1)), o1 AS (SELECT unnest(ids) AS id, -ids[1] - 1 AS gist FROM k1),
gm AS (SELECT gist, least(1.0, coalesce(max(importance), 0.5)) AS importance, avg({_j('emotional_valence')}::DOUBLE) AS v, any_value(episode) AS episode FROM m0 JOIN o1 USING (id) GROUP BY gist),
m1 AS (SELECT m0.* REPLACE (CASE WHEN gist IS NOT NULL THEN 'archived' ELSE status END AS status, coalesce(gist, superseded_by) AS superseded_by, CASE WHEN gist IS NOT NULL THEN {_SQL_LATE} ELSE archived_at END AS archived_at) FROM m0 LEFT JOIN o1 USING (id)
  UNION ALL SELECT gist, 'episodic', 'active', '', importance, NULL, {_SQL_LATE}, NULL, NULL, '{{"consolidation":{{"role":"merged"}}' || CASE WHEN v IS NOT NULL THEN ',"emotional_valence":' || v ELSE '' END || '}}', NULL, NULL, episode, NULL, NULL FROM gm),
m2 AS (SELECT * FROM m1 WHERE NOT coalesce(status = 'archived' AND superseded_by IS NOT NULL AND {_sql_age('archived_at')} >= 14 AND NOT {_SQL_PROTECTED}, false)),
lv AS (SELECT id, {_sql_strength()} AS s, {_SQL_PROTECTED} AS held FROM m2 WHERE status = 'active' AND type = 'episodic'), hs AS (SELECT coalesce(sum(s), 0) AS h FROM lv WHERE held), tt AS (SELECT coalesce(sum(s), 0) AS t FROM lv WHERE NOT held),
pr AS (SELECT id FROM (SELECT id, coalesce(sum(s) OVER (ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv WHERE NOT held) WHERE (SELECT h >= {_CAPACITY} FROM hs) OR (SELECT t FROM tt) - before > {_CAPACITY} - (SELECT h FROM hs)),
m3 AS (SELECT * FROM m2 WHERE id NOT IN (SELECT id FROM pr)),
ct AS (SELECT content_hash, count(*) AS n, min({_sql_age(_USED)}) AS idle FROM m3 WHERE status = 'active' AND content_hash IS NOT NULL GROUP BY 1),
du AS (SELECT d.id, d.content_hash, coalesce(n, 0) AS n FROM dc0 d LEFT JOIN ct USING (content_hash) WHERE d.status = 'active' AND acquisition = 'agent' AND {_sql_age('last_ingested_at')} >= 60 AND (last_touched IS NULL OR {_sql_age('last_touched')} >= 60)
  AND NOT on_desk AND content_hash NOT IN (SELECT content_hash FROM rq0 WHERE status = 'pending') AND coalesce(idle >= 60, true) ORDER BY last_ingested_at, d.id LIMIT 5),
rq1 AS (SELECT * FROM rq0 UNION ALL SELECT DISTINCT content_hash, 'pending' FROM du WHERE n >= 5 AND content_hash NOT IN (SELECT content_hash FROM rq0)), dc1 AS (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM du WHERE n < 5) THEN 'archived' ELSE status END AS status) FROM dc0),
st AS (SELECT content_hash, max({_sql_age('created_at')}) AS old, min({_sql_age(_USED)}) AS idle FROM m3 WHERE status = 'active' AND content_hash IS NOT NULL AND NOT coalesce({_j('protected')}::BOOLEAN, false) GROUP BY 1),
rq2 AS (SELECT * FROM rq1 UNION ALL SELECT content_hash, 'pending' FROM st WHERE old >= 40 AND idle >= 30 AND content_hash NOT IN (SELECT content_hash FROM rq1)),
{_sql_groups('m3', 'g3')}, rv1 AS (SELECT 1 AS x FROM (SELECT DISTINCT 1 FROM rv0) UNION ALL SELECT 1 FROM r1), rvb AS (SELECT DISTINCT 1 AS x FROM rv0),
{_sql_status('s0', 'm0', 'g0', 'rvb', 'rq0', 'dc0')}, {_sql_status('s3', 'm3', 'g3', 'rv1', 'rq2', 'dc1')}"""


@query(f"""{ctes("memories")}, {_SQL_CYCLE} SELECT measure, s0.amount AS before, s3.amount AS after FROM s0 JOIN s3 USING (measure)""")
def retention_dry_run(spark, sf_dir):
    return retention.dry_run(_state(spark, sf_dir), _late(), capacity=_CAPACITY)


@query(f"""{ctes("memories")}, {_SQL_CYCLE} SELECT id, status, superseded_by, round(importance, 6) AS importance FROM m3""")
def rested_memories(spark, sf_dir):
    """Every memory as one cycle would leave it."""
    done = retention.cycle(_state(spark, sf_dir), _late(), capacity=_CAPACITY)
    return done.memories.select("id", "status", "superseded_by", F.round("importance", 6).alias("importance"))


@query(f"""{ctes("memories")}, {_SQL_CYCLE} SELECT id AS document, content_hash, n AS memory_count, CASE WHEN n >= 5 THEN 'ask' ELSE 'archive' END AS decision FROM du""")
def agent_source_retention(spark, sf_dir):
    state = retention.gc_pass(retention.rest_pass(_state(spark, sf_dir), _late()), _late(), capacity=_CAPACITY)
    done = retention.agent_source_pass(state, _late())
    asked = done.requests.join(state.requests.select("content_hash"), "content_hash", "left_anti").select("content_hash", F.col("memory_count").alias("n"))
    gone = done.documents.join(state.documents.filter("status = 'archived'").select("id"), "id", "left_anti").filter("status = 'archived'")
    cited = state.memories.filter("status = 'active' and content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n"))
    gone = gone.join(cited, "content_hash", "left").select(F.col("id").alias("document"), "content_hash", F.coalesce("n", F.lit(0)).alias("memory_count"), F.lit("archive").alias("decision"))
    first = state.documents.join(asked, "content_hash").filter((F.col("acquisition") == "agent") & (F.col("status") == "active"))
    first = first.groupBy("content_hash").agg(F.min_by("id", F.struct("last_ingested_at", "id")).alias("document"), F.max("n").alias("memory_count"))
    return gone.unionByName(first.select("document", "content_hash", "memory_count", F.lit("ask").alias("decision")))


_SQL_SUB = """ed AS (SELECT l_orderkey AS src, l_partkey + 10000000 AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CAUSES' ELSE 'MENTIONS' END AS rel, CASE WHEN l_linenumber < 7 THEN (l_quantity / 50.0)::DOUBLE END AS weight FROM lineitem),
ok AS (SELECT src, dst, rel, coalesce(weight, 1.0) AS weight FROM ed WHERE rel IN ('SUPPORTS', 'CAUSES') AND src % 7 <> 3),
ad AS (SELECT a, b, max(w) AS w FROM (SELECT src AS a, dst AS b, weight AS w FROM ok UNION ALL SELECT dst, src, weight FROM ok) GROUP BY a, b),
h0 AS (SELECT unnest([1, 3, 32, 1000]) AS node), f0 AS (SELECT node, 0 AS depth, 1.0::DOUBLE AS r FROM h0 WHERE node % 7 <> 3),
f1 AS (SELECT b AS node, 1 AS depth, max(r * w) AS r FROM f0 JOIN ad ON ad.a = f0.node GROUP BY b), f2 AS (SELECT b AS node, 2 AS depth, max(r * w) AS r FROM f1 JOIN ad ON ad.a = f1.node GROUP BY b),
fr AS (SELECT node, min(depth) AS depth, max(r) AS relevance FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY node), kp AS (SELECT * FROM fr ORDER BY depth, relevance DESC, node LIMIT 40)"""


def _subgraph(spark, sf_dir):
    i, n = F.col("l_orderkey"), F.col("l_linenumber")
    rel = F.when(n % 3 == 0, "SUPPORTS").when(n % 3 == 1, "CAUSES").otherwise("MENTIONS")
    edges = table(spark, sf_dir, "lineitem").select(i.alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"), rel.alias("rel"), F.when(n < 7, (F.col("l_quantity") / 50.0).cast("double")).alias("weight"))
    live = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 7 != 3).alias("alive"))
    seeds = table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 3, 32, 1000)).select(F.col("o_orderkey").alias("node"))
    return graph.subgraph(edges, live, seeds, 2, 40, ["SUPPORTS", "CAUSES"])


@query(f"WITH {_SQL_SUB} SELECT node, depth::INTEGER AS depth, round(relevance, 6) AS relevance FROM kp")
def subgraph_nodes(spark, sf_dir):
    return _subgraph(spark, sf_dir)[0].withColumn("relevance", F.round("relevance", 6))


@query(f"WITH {_SQL_SUB} SELECT DISTINCT src, dst, rel, round(weight, 6) AS weight FROM ok WHERE src IN (SELECT node FROM kp) AND dst IN (SELECT node FROM kp)")
def subgraph_edges(spark, sf_dir):
    return _subgraph(spark, sf_dir)[1].withColumn("weight", F.round("weight", 6))


_SQL_METRICS = """m AS (SELECT coalesce(CASE event_type WHEN 'error' THEN NULL ELSE event_type END, 'unknown') AS source_type, CASE user_id % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'quick' ELSE 'hybrid' END AS mode, event_id % 900 AS w, event_id % 13 AS x, event_id % 7 AS mm, event_id % 3 AS dd, event_id % 5 AS l,
  value AS s, CASE WHEN event_id % 4 > 0 THEN (event_id % 20) / 10.0 - 1 END AS v FROM events WHERE ts >= TIMESTAMP '2024-01-05')"""


@query(f"""WITH {_SQL_METRICS}, a AS (SELECT source_type, count(*) AS n, round(avg(w), 6) AS w, round(avg(x), 6) AS x, round(avg(s), 6) AS s FROM m GROUP BY 1), b AS (SELECT mode, count(*) AS n FROM m GROUP BY 1)
SELECT (SELECT count(*) FROM m) AS total_ingestions, (SELECT string_agg(source_type || '=' || n || '/' || w || '/' || x, ',' ORDER BY source_type) FROM a) AS by_source, (SELECT string_agg(mode || '=' || n, ',' ORDER BY mode) FROM b) AS by_mode,
(SELECT sum(w)::BIGINT FROM m) AS total_words, (SELECT sum(mm)::BIGINT FROM m) AS total_memories, (SELECT sum(l)::BIGINT FROM m) AS total_llm_calls, (SELECT round(avg(v), 6) FROM m) AS avg_valence, (SELECT sum(dd)::BIGINT FROM m) AS total_deduped, (SELECT round(sum(dd)::DOUBLE / sum(x), 6) FROM m) AS dedup_rate""")
def ingestion_stats(spark, sf_dir):
    """The fields of the JSON object, read back from it."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    mode = F.when(F.col("user_id") % 3 == 0, "deep").when(F.col("user_id") % 3 == 1, "quick").otherwise("hybrid")
    metrics = e.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("source_type"), mode.alias("mode"), F.col("ts").cast("timestamp").alias("created_at"), (i % 900).alias("word_count"), (i % 13).alias("extraction_count"),
        (i % 7).alias("memory_count"), (i % 3).alias("dedup_count"), (i % 5).alias("llm_calls"), F.col("value").alias("duration_seconds"), F.when(i % 4 > 0, (i % 20) / 10.0 - 1).alias("valence"), F.lit(0.5).alias("arousal"), F.lit(None).cast("double").alias("intensity"),
    )
    stats = surface.ingestion_stats(metrics, F.lit("2024-01-05").cast("timestamp"), _late())
    kind = "total_ingestions long, by_source_type map<string,struct<count:long,avg_words:double,avg_extractions:double>>, by_mode map<string,long>, totals struct<total_words:long,total_memories:long,total_llm_calls:long,avg_valence:double>, dedup_stats struct<total_deduped:long,dedup_rate:double>"
    s = stats.select(F.from_json("stats", kind).alias("s")).select("s.*")
    text = lambda m, shown: F.array_join(F.transform(F.array_sort(F.map_entries(m)), shown), ",")
    return s.select(
        "total_ingestions", text("by_source_type", lambda x: F.concat(x["key"], F.lit("="), F.concat_ws("/", x["value"]["count"], x["value"]["avg_words"], x["value"]["avg_extractions"]))).alias("by_source"),
        text("by_mode", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))).alias("by_mode"), "totals.total_words", "totals.total_memories", "totals.total_llm_calls", "totals.avg_valence", "dedup_stats.total_deduped", "dedup_stats.dedup_rate",
    )


@query("""WITH l AS (SELECT conv_id, turn, role || ': ' || left(trim(regexp_replace(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' +', ' ', 'g'), ' '), 300) AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM l), u AS (SELECT *, sum(length(line) + CASE WHEN r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE r <= 5),
b AS (SELECT conv_id, count(*) AS n, left(string_agg(line, chr(10) ORDER BY turn), 900) AS body FROM u WHERE used <= 900 OR r = 1 GROUP BY 1)
SELECT conv_id AS session, n::INTEGER AS turns, length(body)::INTEGER AS chars, sha256(body) AS body_sha256 FROM b""")
def carried_over(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", F.lit(None).cast("timestamp").alias("at"))
    out = surface.carryover(turns, _late(), most=5, max_chars=900, line_chars=300)
    return out.select("session", "turns", "chars", F.sha2("body", 256).alias("body_sha256"))
