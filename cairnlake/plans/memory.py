"""Registered queries of recall, intake, review and schedules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions import schedule, scoring
from cairnlake.operators import intake, recall, review, rollups, search, vectors
from cairnlake.plans.base import SQL_CANONICAL, SQL_NORMALIZED, SQL_SIM, events, query, table, vector

# Recall

_SQL_ROWS = f"""m AS (SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' ELSE 'procedural' END AS tier, {SQL_SIM} AS sim,
  (vec_id % 10) / 10.0 AS strength, (vec_id % 7) / 10.0 AS felt, vec_id % 60 AS age, (vec_id % 5) / 5.0 AS trust, CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE 0.0 END AS boost,
  vec_id % 13 = 0 AS invalid, (vec_id % 9) / 9.0 AS mood FROM embeddings e)"""


def _rows(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.when(v % 3 == 0, "semantic").when(v % 3 == 1, "episodic").otherwise("procedural").alias("tier"), "embedding",
        (v % 10 / 10.0).alias("strength"), (v % 7 / 10.0).alias("felt"), (v % 60).alias("age_days"), (v % 5 / 5.0).alias("trust"),
        F.when(v % 4 == 0, 0.5).otherwise(0.0).alias("boost"), (v % 13 == 0).alias("invalid"), (v % 9 / 9.0).alias("mood"),
    )


@query(f"""WITH {_SQL_ROWS}, near AS (SELECT * FROM m WHERE sim IS NOT NULL),
e AS (SELECT vec_id AS src, vec_id // 2 AS dst, 0.5 + (vec_id % 4) / 8.0 AS w FROM embeddings WHERE vec_id > 0), u AS (SELECT a, b, max(w) AS w FROM (SELECT src AS a, dst AS b, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY a, b),
seeds AS (SELECT id, sim FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sim DESC, id) AS r FROM near) WHERE r <= 20),
act AS (SELECT u.b AS id, max(s.sim * u.w) AS a FROM seeds s JOIN u ON u.a = s.id GROUP BY u.b), pool AS (SELECT coalesce(s.id, a.id) AS id, coalesce(a.a, 0.0) AS a FROM seeds s FULL JOIN act a ON a.id = s.id),
scored AS (SELECT n.id, n.tier, greatest(0.001, sim * (0.5 + 0.5 * greatest(strength, 0.5 * felt)) + 0.2 * p.a + 0.1 * exp(-ln(2) * age / 7.0) + 0.1 * trust + 0.3 * boost - CASE WHEN invalid THEN 0.35 ELSE 0 END + 0.05 * mood) AS s FROM near n JOIN pool p ON p.id = n.id)
SELECT id, tier, round(s, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s DESC, id) AS rank FROM scored) WHERE rank <= 10""")
def tiered_recall(spark, sf_dir):
    v = F.col("vec_id")
    edges = table(spark, sf_dir, "embeddings").filter("vec_id > 0").select(v.alias("src"), F.expr("vec_id div 2").alias("dst"), (0.5 + v % 4 / 8.0).alias("weight"))
    out = recall.tiered(_rows(spark, sf_dir), vector(spark, sf_dir), edges, 10)
    return out.withColumn("score", F.round("score", 6))


_SQL_LEX = """tok AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {table}),
hit AS (SELECT id, len(list_filter(w, lambda x: x NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with'))) AS n,
  len(list_filter(w, lambda x: x = '{term}')) AS h FROM tok), lex AS (SELECT id, h / sqrt(n::DOUBLE) / (1 + h / sqrt(n::DOUBLE)) AS score FROM hit WHERE h > 0)"""


@query(f"""WITH {_SQL_LEX.format(key="doc_id", table="documents", term="er")}, v AS (SELECT vec_id AS id, {SQL_SIM} AS vector_score FROM embeddings e ORDER BY vector_score DESC, id LIMIT 40),
t AS (SELECT id, score / max(score) OVER () AS lexical_score FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 40)),
b AS (SELECT coalesce(v.id, t.id) AS id, vector_score, lexical_score FROM v FULL JOIN t ON v.id = t.id),
s AS (SELECT b.*, 0.6 * coalesce(vector_score, 0) + 0.4 * coalesce(lexical_score, 0) + 0.1 * exp(-ln(2) * (b.id % 30) / 14.0) + 0.1 * (b.id % 5) / 5.0 + CASE WHEN b.id % 8 = 0 THEN 0.05 ELSE 0 END AS s FROM b JOIN documents d ON d.doc_id = b.id)
SELECT id, round(vector_score, 6) AS vector_score, round(lexical_score, 6) AS lexical_score, round(s, 6) AS score FROM s ORDER BY s DESC, id LIMIT 20""")
def chunk_search(spark, sf_dir):
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    facts = docs.select(d.alias("id"), F.exp(-F.log(F.lit(2.0)) * (d % 30) / 14.0).alias("recency"), (d % 5 / 5.0).alias("trust"), (d % 8 == 0).alias("desk"))
    by_vector = vectors.nearest(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir), 40).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    out = recall.chunk_ranking(by_vector, search.term_scores(docs, ["er"]).select("id", "score"), facts, 20)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "lexical_score", "score")])


_SQL_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_type || ' ' || p_brand AS text FROM part), {_SQL_LEX.format(key="id", table="p", term="brass")},
g AS (SELECT id, text, {_SQL_GRAMS.format("text")} AS a, {_SQL_GRAMS.format("'polished brass'")} AS b FROM p),
f AS (SELECT g.id, text, CASE WHEN g.id % 2 = 0 THEN (g.id % 100) / 100.0 END AS sim, lex.score AS l, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS t FROM g LEFT JOIN lex ON lex.id = g.id),
r AS (SELECT id, greatest(coalesce(sim, 0), CASE WHEN l > 0 THEN least(1.0, 0.35 + 4 * l) ELSE 0 END, t) AS s FROM f WHERE coalesce(sim, 0) >= 0.15 OR l IS NOT NULL OR t >= 0.1 OR contains(lower(text), 'polished brass'))
SELECT id, round(s, 6) AS score FROM r WHERE s >= 0.35""")
def snapshot_search(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.concat_ws(" ", "p_type", "p_brand").alias("content"), F.when(key % 2 == 0, key % 100 / 100.0).alias("similarity"))
    return recall.snapshot(rows, "polished brass", ["brass"]).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT * FROM c WHERE o_orderkey % 3 = 0""")
def opened_chunks(spark, sf_dir):
    return recall.opened(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), F.col("o_orderkey") % 3 == 0, "o_custkey", "o_orderkey")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'))), text IS NULL ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1""")
def ranked_dedupe(spark, sf_dir):
    return recall.first_of_equal(table(spark, sf_dir, "documents"), "lang", "text", F.desc_nulls_last("n_chars"), F.col("doc_id")).select("doc_id", "lang")


@query(f"""WITH means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label),
n AS (SELECT label, list_cosine_similarity(c, (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS cs FROM c ORDER BY cs DESC, label LIMIT 3), s AS (SELECT label, vec_id, {SQL_SIM} AS sim FROM embeddings e),
r AS (SELECT s.*, n.cs, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS k FROM s JOIN n USING (label))
SELECT label AS cluster, round(cs, 6) AS cluster_similarity, vec_id AS id, round(sim, 6) AS similarity FROM r WHERE k <= 4""")
def cluster_samples(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    out = recall.cluster_samples(df, vectors.centroids(df), vector(spark, sf_dir), 3, 4)
    return out.select("cluster", F.round("cluster_similarity", 6).alias("cluster_similarity"), "id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT * FROM (SELECT 'turn' AS source, (conv_id * 1000 + turn)::VARCHAR AS id, substr(text, 1, 280) AS preview FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'document', doc_id::VARCHAR, substr(text, 1, 280) FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id DESC LIMIT 15)""")
def history_search(spark, sf_dir):
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    turns = table(spark, sf_dir, "conversations").select(key.alias("id"), key.alias("at"), F.col("text").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("at"), F.col("text").alias("content"))
    return recall.history({"turn": turns, "document": docs}, "the", 15)


# Intake


@query("""WITH h AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderkey % 5 = 0 AS f FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT coalesce(h.k, n.k) AS k, h.v AS o, n.v AS v, CASE WHEN h.k IS NULL THEN 'inserted' WHEN n.k IS NULL OR f THEN 'kept' WHEN h.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'updated' END AS action FROM h FULL JOIN n ON h.k = n.k)
SELECT k AS o_orderkey, CASE WHEN action IN ('inserted', 'updated') THEN v ELSE o END AS o_orderstatus, action FROM b""")
def upsert_snapshot(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey")
    held = orders.filter(key % 3 != 0).withColumn("frozen", key % 5 == 0)
    new = orders.filter(key % 2 == 0).withColumn("o_orderstatus", F.when(key % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return intake.upserted(held, new, "o_orderkey", "o_orderstatus", "frozen")


_SQL_CHUNKS = "SELECT doc_id, i::INTEGER AS chunk_index, sha256(substr(t, i * 1680 + 1, 1800)) AS h FROM ({0}), LATERAL (SELECT unnest(range(0, (greatest(length(t) - 1, 0) // 1680) + 1)) AS i) WHERE length(t) > 0"
_SQL_OLDER = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) // 2) ELSE text || repeat(' more', 500) END AS t FROM documents"


@query(f"""WITH f AS ({_SQL_CHUNKS.format("SELECT doc_id, text AS t FROM documents")}), h AS ({_SQL_CHUNKS.format(_SQL_OLDER)}), m AS (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM f))
SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, coalesce(m.chunk_index, f.chunk_index) AS chunk_index, CASE WHEN m.h IS NULL THEN 'inserted' WHEN f.h IS NULL THEN 'trimmed' WHEN m.h = f.h THEN 'unchanged' ELSE 'reembedded' END AS action
FROM m FULL JOIN f ON m.doc_id = f.doc_id AND m.chunk_index = f.chunk_index""")
def chunk_renewal(spark, sf_dir):
    docs, d = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    older = F.when(d % 3 == 0, F.col("text")).when(d % 3 == 1, F.expr("substr(text, 1, length(text) div 2)")).otherwise(F.concat("text", F.repeat(F.lit(" more"), F.lit(500))))
    return intake.chunk_renewal(search.chunks(docs.withColumn("text", older)), search.chunks(docs))


@query(f"""WITH d AS (SELECT doc_id AS ref, {SQL_CANONICAL.format("text")} AS t FROM documents),
h AS (SELECT ref, t FROM d WHERE ref % 2 = 0), n AS (SELECT ref, CASE WHEN ref % 4 = 0 THEN t || '#' ELSE t END AS t FROM d)
SELECT n.ref, CASE WHEN h.t = n.t THEN 'same' WHEN h.ref IS NOT NULL THEN 'conflict' WHEN n.t IN (SELECT t FROM h) THEN 'duplicate' ELSE 'new' END AS verdict FROM n LEFT JOIN h ON h.ref = n.ref""")
def import_dry_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.coalesce("text", F.lit("")).alias("content"))
    new = docs.withColumn("content", F.when(F.col("ref") % 4 == 0, F.concat(F.rtrim(F.regexp_replace("content", r"[ \t\r\n]+$", "")), F.lit("#"))).otherwise(F.col("content")))
    return intake.import_conflicts(docs.filter("ref % 2 = 0"), new)


@query(f"""WITH a AS (SELECT *, CASE WHEN turn % 8 = 0 THEN ' mail ' || turn || ' ' END AS source, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'user: ' || coalesce(text, '') || chr(10) || chr(10) || 'agent: ' || coalesce(reply, '') AS pair, CASE WHEN trim(coalesce(source, '')) <> '' THEN 'src:' || trim(source) ELSE 'hash:' || sha256({SQL_NORMALIZED.format("text")} || chr(30) || {SQL_NORMALIZED.format("reply")} || chr(30) || conv_id::VARCHAR) END AS identity FROM a WHERE role = 'user'""")
def turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("source", F.when(F.col("turn") % 8 == 0, F.concat(F.lit(" mail "), "turn", F.lit(" "))))
    return intake.turn_pairs(turns, source="source")


_SQL_MARK = "(chr(10) || chr(10) || '[... the full text remains stored; this input was shortened ...]' || chr(10) || chr(10))"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN text ELSE NULL END AS t, 1000 - length({_SQL_MARK}) AS room FROM documents)
SELECT doc_id, sha256(CASE WHEN length(coalesce(t, '')) <= 1000 THEN coalesce(t, '') ELSE left(t, ceil(room * 0.7)::INTEGER) || {_SQL_MARK} || right(t, room - ceil(room * 0.7)::INTEGER) END) AS input_hash FROM d""")
def embedding_inputs(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 > 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(intake.embedding_input(text, 1000), 256).alias("input_hash"))


@query("""SELECT l_orderkey, l_linenumber, c AS "check" FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END]) AS c FROM lineitem) WHERE c IS NOT NULL""")
def check_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return intake.violations(lines, {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1}).select("l_orderkey", "l_linenumber", "check")


# Review


@query("""WITH r AS (SELECT event_type AS task_type, CASE event_id % 9 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS status, ts AS s, ts + INTERVAL 1 MINUTE AS f, event_id FROM events),
d AS (SELECT task_type, max(f) FILTER (status = 'completed') AS last_success FROM r GROUP BY 1)
SELECT task_type, arg_max(status, (s, event_id)) AS latest_status, max(last_success) AS last_success, count(*) FILTER (status = 'failed' AND (last_success IS NULL OR s > last_success)) AS failures_since, count(*) FILTER (status = 'running') AS running FROM r JOIN d USING (task_type) GROUP BY 1""")
def task_status(spark, sf_dir):
    e = F.col("event_id") % 9
    runs = events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("task_type"), F.when(e == 0, "completed").when(e == 1, "running").otherwise("failed").alias("status"),
        F.col("ts").alias("started_at"), (F.col("ts") + F.expr("interval 1 minute")).alias("finished_at"),
    )
    return review.task_status(runs)


@query("""WITH s AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS run, CASE event_id % 11 WHEN 0 THEN 'durable_memory' WHEN 1 THEN 'contradiction_resolved' WHEN 2 THEN 'goal_advanced' WHEN 3 THEN 'user_feedback' ELSE 'other' END AS kind, value / 100 AS amount FROM events),
t AS (SELECT run, least(count(*) FILTER (kind = 'durable_memory'), 2) * 0.35 + least(count(*) FILTER (kind = 'contradiction_resolved'), 2) * 0.5 + least(count(*) FILTER (kind = 'goal_advanced'), 2) * 0.3 + least(coalesce(sum(amount) FILTER (kind = 'user_feedback'), 0), 1.0) * 0.5 AS s FROM s GROUP BY 1)
SELECT run, round(s, 6) AS score, CASE WHEN s >= 1 THEN 'high_value' WHEN s > 0 THEN 'useful' ELSE 'none' END AS tier FROM t""")
def outcome_scores(spark, sf_dir):
    e = F.col("event_id") % 11
    kind = F.when(e == 0, "durable_memory").when(e == 1, "contradiction_resolved").when(e == 2, "goal_advanced").when(e == 3, "user_feedback").otherwise("other")
    run = F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    some = events(spark, sf_dir).select(run.alias("run"), kind.alias("kind"), (F.col("value") / 100).alias("amount"))
    return review.outcome_scores(some, "run").withColumn("score", F.round("score", 6))


@query("""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'archived' ELSE 'active' END AS status, (o_orderkey % 7 = 0)::INTEGER AS c, (o_orderkey % 4)::INTEGER AS s, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 101) / 101.0 END AS conf, (o_orderkey % 21) / 21.0 AS tr, (o_orderkey % 31) / 31.0 AS im FROM orders),
o AS (SELECT o_orderkey AS id, 'active' AS status, 0 AS c, 2 AS s, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS conf, 0.5 AS tr, 0.5 AS im FROM orders WHERE o_orderkey % 6 <> 1),
j AS (SELECT n.*, o.id AS oid, o.status AS os, o.c AS oc, o.s AS osr, abs(n.conf - o.conf) AS dc, abs(n.tr - o.tr) AS dt, abs(n.im - o.im) AS di FROM n LEFT JOIN o ON o.id = n.id),
k AS (SELECT id, CASE WHEN oid IS NULL THEN CASE WHEN c > 0 THEN 'contradiction' ELSE 'new_evidence' END WHEN status <> os THEN 'status_change' WHEN c > oc THEN 'contradiction' WHEN s > osr THEN 'new_evidence' WHEN dc >= 0.1 THEN 'confidence_change' WHEN dt >= 0.1 THEN 'confidence_change' WHEN di >= 0.15 THEN 'importance_change' END AS change,
  CASE WHEN oid IS NULL OR status <> os OR c > oc OR s > osr THEN NULL WHEN dc >= 0.1 THEN dc WHEN dt >= 0.1 THEN dt WHEN di >= 0.15 THEN di END AS delta FROM j)
SELECT id, change, round(delta, 6) AS delta FROM k WHERE change IS NOT NULL""")
def change_decisions(spark, sf_dir):
    k = F.col("o_orderkey")
    both = table(spark, sf_dir, "orders").select(k)
    new = both.select(
        k.alias("id"), F.when(k % 10 == 0, "archived").otherwise("active").alias("status"), (k % 7 == 0).cast("int").alias("contradictions"), (k % 4).cast("int").alias("sources"),
        F.when(k % 3 > 0, k % 101 / 101.0).alias("confidence"), (k % 21 / 21.0).alias("trust"), (k % 31 / 31.0).alias("importance"),
    )
    old = both.filter(k % 6 != 1).select(
        k.alias("id"), F.lit("active").alias("status"), F.lit(0).alias("contradictions"), F.lit(2).alias("sources"), F.when(k % 2 == 0, 0.5).alias("confidence"), F.lit(0.5).alias("trust"), F.lit(0.5).alias("importance"),
    )
    return review.change_decisions(old, new).withColumn("delta", F.round("delta", 6))


@query("""WITH s AS (SELECT conv_id AS id, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+'))) AS sentence FROM conversations),
c AS (SELECT id, unnest([CASE WHEN regexp_matches(lower(sentence), '\\b(the|a)\\b') THEN 'search' END, CASE WHEN regexp_matches(lower(sentence), '\\b(is|of)\\b') THEN 'store' END]) AS tool, sentence FROM s WHERE NOT regexp_matches(lower(sentence), '\\b(not|will|can)\\b'))
SELECT id, tool, sentence FROM c WHERE tool IS NOT NULL AND NOT (id % 2 = 0 AND tool = 'search')""")
def unsupported_claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    deeds = turns.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("id"), F.lit("search").alias("tool")).distinct()
    return review.unsupported_claims(turns, deeds, {"search": r"\b(the|a)\b", "store": r"\b(is|of)\b"}, r"\b(not|will|can)\b", "conv_id")


@query("""WITH t AS (SELECT conv_id % 5 AS dimension, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
a AS (SELECT dimension, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{6,}')) AS x, list_distinct(regexp_extract_all(lower(reply), '[a-z0-9]{6,}')) AS y FROM t WHERE reply IS NOT NULL)
SELECT dimension, round(avg(CASE WHEN len(x) + len(y) > 0 THEN 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 1.0 END), 6) AS score FROM a GROUP BY dimension""")
def answer_scores(spark, sf_dir):
    long_words = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{6,})")), " ")
    turns = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("reply is not null")
    both = turns.select((F.col("conv_id") % 5).alias("dimension"), long_words(F.col("text")).alias("given"), long_words(F.col("reply")).alias("wanted"))
    return review.answer_scores(both).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT l_orderkey AS node, CASE WHEN l_returnflag = 'R' THEN 'CONTRADICTS' WHEN l_returnflag = 'A' THEN 'SUPPORTS' ELSE 'RELATED' END AS rel, l_quantity AS w FROM lineitem WHERE l_partkey % 3 = 0),
s AS (SELECT node, coalesce(sum(w) FILTER (rel = 'SUPPORTS'), 0) AS a, coalesce(sum(w) FILTER (rel = 'CONTRADICTS'), 0) AS b FROM e GROUP BY node)
SELECT node, round(CASE WHEN a + b > 0 THEN (a - b) / (a + b) ELSE 0 END, 6) AS alignment FROM s""")
def belief_alignment(spark, sf_dir):
    rel = F.when(F.col("l_returnflag") == "R", "CONTRADICTS").when(F.col("l_returnflag") == "A", "SUPPORTS").otherwise("RELATED")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), rel.alias("rel"), F.col("l_quantity").alias("weight"))
    return review.alignment(edges.filter("dst % 3 = 0")).withColumn("alignment", F.round("alignment", 6))


@query("""SELECT source, count(*) AS n, count(DISTINCT round((doc_id % 37) / 37.0, 2)) AS levels, count(*) FILTER ((doc_id % 37) / 37.0 < 0.5) AS low, round(min((doc_id % 37) / 37.0), 6) AS least, round(max((doc_id % 37) / 37.0), 6) AS most, round(avg((doc_id % 37) / 37.0), 6) AS mean FROM documents GROUP BY source""")
def trust_distribution(spark, sf_dir):
    out = review.trust_distribution(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", F.col("doc_id") % 37 / 37.0)
    return out.select("source", "n", "levels", "low", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean")])


@query("""SELECT event_id, n <= 40 AS notify FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS n FROM events)""")
def rate_limited_log(spark, sf_dir):
    return review.running_totals(events(spark, sf_dir), "event_type", "ts", 43_200, 40).select("event_id", "notify")


@query("""SELECT status, n, items FROM (SELECT o_orderstatus AS status, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) FILTER (r <= 5) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) GROUP BY 1)""")
def backlog_snapshot(spark, sf_dir):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", order.alias("p"))
    top = rollups.top_of_each(orders, ["status"], 5, F.col("p"), F.col("o_orderkey")).groupBy("status").agg(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))).alias("i"))
    listed = top.select("status", F.array_join(F.transform("i", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"))
    return orders.groupBy("status").agg(F.count("*").alias("n")).join(listed, "status").select("status", "n", "items")


# Scores and schedules


@query("""WITH b AS (SELECT event_id, value / 100 AS x, (event_id % 48)::DOUBLE AS h, epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-31') - 864000000000 AS calm FROM events)
SELECT event_id, round(CASE WHEN calm THEN CASE WHEN x > 0.5 THEN greatest(0.5, x - 0.05) WHEN x < 0.5 THEN least(0.5, x + 0.05) ELSE x END ELSE least(1.0, x + 0.1) END, 6) AS drive,
round(least(30.0, least(least(x * 30, 30.0), 10.0) + greatest(least(x * 30, 30.0) - 10, 0) * power(0.5, h / 24) + 0.5 * h), 6) AS energy,
round(least(120.0, greatest(15.0, 60 * greatest(0.25, 1.5 - least(x * 3, 2.0) * 0.75))), 6) AS cadence,
round(greatest(0.0, least(1.0, x * (1 + 0.1 * ln(event_id % 50 + 1)))), 6) AS importance, round(greatest(0.0, least(1.0, x + (0.5 - x) * 0.02)), 6) AS tonic, round(greatest(0.3, least(1.0, 1 - 0.7 * coalesce(CASE WHEN event_id % 6 > 0 THEN x END, 0.5))), 6) AS decay,
round(0.6 * (1 - abs(x - 0.5) / 2) + 0.3 * CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1 - abs(x - 0.2) END + 0.1 * CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, 6) AS mood FROM b JOIN (SELECT event_id, event_type FROM events) USING (event_id)""")
def state_scores(spark, sf_dir):
    x, e = F.col("value") / 100, F.col("event_id")
    now = F.lit("2024-01-31").cast("timestamp")
    return events(spark, sf_dir).select(
        "event_id", F.round(scoring.drive_level(x, F.lit(0.5), F.col("ts"), now, 864_000, 0.1, 0.05), 6).alias("drive"),
        F.round(scoring.energy(x * 30, (e % 48).cast("double"), 10.0, 30.0, 24.0, F.lit(0.5)), 6).alias("energy"), F.round(scoring.cadence_minutes(x * 3), 6).alias("cadence"),
        F.round(scoring.grown_importance(x, e % 50), 6).alias("importance"), F.round(scoring.drifted(x), 6).alias("tonic"), F.round(scoring.decay_multiplier(F.when(e % 6 > 0, x)), 6).alias("decay"),
        F.round(scoring.mood_match(x, F.when(e % 3 != 0, x), F.col("event_type"), 0.5, 0.2, "purchase"), 6).alias("mood"),
    )


@query("""WITH t AS (SELECT event_id, ts, (event_id % 5 + 1) * 3600 AS every, (event_id % 24) * 3600 AS sec, event_id % 7 + 1 AS dow, TIMESTAMP '2024-01-10 00:30:00' AS anchor FROM events),
d AS (SELECT *, date_trunc('day', ts) + to_seconds(sec) AS today, date_trunc('day', ts) + to_days(((dow - isodow(ts) + 7) % 7)::INTEGER) + to_seconds(sec) AS thatday FROM t)
SELECT event_id, CASE WHEN ts < anchor THEN anchor ELSE anchor + to_seconds((floor((epoch_us(ts) - epoch_us(anchor)) / 1000000.0 / every) + 1) * every) END AS on_grid,
CASE WHEN today > ts THEN today ELSE today + INTERVAL 1 DAY END AS daily, CASE WHEN thatday > ts THEN thatday ELSE thatday + INTERVAL 7 DAY END AS weekly,
hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 390 AS active FROM d""")
def next_runs(spark, sf_dir):
    ts, e = F.col("ts"), F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", schedule.next_on_grid(F.lit("2024-01-10 00:30:00").cast("timestamp"), (e % 5 + 1) * 3600, ts).alias("on_grid"), schedule.next_daily(e % 24 * 3600, ts).alias("daily"),
        schedule.next_weekly(e % 7 + 1, e % 24 * 3600, ts).alias("weekly"), schedule.within_hours(ts, "22:00-06:30").alias("active"),
    )
