"""Registered queries of what callers see, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import postings, recall, search, surface, vectors
from cairnlake.plans.base import SQL_SIM, query, table, vector
from cairnlake.plans.derived import ctes, derived
from cairnlake.plans.lexical import documents_index, parts_index
from cairnlake.plans.upkeep import _SQL_NEAR, _j, _near


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query(f"""WITH s AS (SELECT vec_id AS id, label, {SQL_SIM} AS score FROM embeddings e), b AS (SELECT id, score, 'belief' AS origin FROM s WHERE label % 5 = 0 ORDER BY score DESC, id LIMIT 3),
r AS (SELECT id, score, 'recall' AS origin FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 30), u AS (SELECT * FROM b UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM b))
SELECT id, round(score, 6) AS score, origin FROM u ORDER BY origin = 'recall', score DESC, id LIMIT 12""")
def context_hydration(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    q = vector(spark, sf_dir)
    scored = rows.select(F.col("vec_id").alias("id"), "label", vectors.cosine(F.col("embedding"), q).alias("score")).filter("score is not null")
    out = surface.hydrated(scored.filter("label % 5 = 0").drop("label"), scored.drop("label").orderBy(F.desc("score"), "id").limit(30), 12)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_NEAR} SELECT r.query_id, r.id, m.label FROM r JOIN embeddings m ON m.vec_id = r.id WHERE k <= 5""")
def batch_hydration(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return surface.hydrated_each(_near(spark, sf_dir, 5), rows).select("query_id", "id", "label")


@query(f"""{ctes("runs")} SELECT tool_name, count(*) AS n, count(*) FILTER (created_at > TIMESTAMP '2024-01-10' - INTERVAL 1 HOUR AND created_at <= TIMESTAMP '2024-01-10') AS active, max(created_at) AS last_at FROM runs GROUP BY 1""")
def activity_by_tool(spark, sf_dir):
    return surface.activity(derived(spark, sf_dir, "runs"), "tool_name", "created_at", _at("2024-01-10"))


_CALLS = """c AS (SELECT event_id, '[{"name":"' || event_type || '","receipts":[{"kind":"memory","ref":"m' || event_id || '"},{"kind":"file","ref":"f1"}]},{"name":"other","receipts":' || CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '[{"kind":"memory","ref":"o"}]' END || '}]' AS calls FROM events)"""


@query(f"""WITH {_CALLS}, x AS (SELECT event_id, unnest(from_json(calls, '[{{"name":"VARCHAR","receipts":[{{"kind":"VARCHAR","ref":"VARCHAR"}}]}}]')) AS c FROM c), y AS (SELECT event_id, c.name AS tool, unnest(c.receipts) AS r FROM x)
SELECT event_id, tool, r.ref AS ref FROM y WHERE r.kind = 'memory'""")
def call_receipts(spark, sf_dir):
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    rest = F.when(F.col("event_id") % 2 == 0, "[]").otherwise('[{"kind":"memory","ref":"o"}]')
    text = F.concat(F.lit('[{"name":"'), kind, F.lit('","receipts":[{"kind":"memory","ref":"m'), i, F.lit('"},{"kind":"file","ref":"f1"}]},{"name":"other","receipts":'), rest, F.lit("}]"))
    return surface.receipts(table(spark, sf_dir, "events").select("event_id", text.alias("calls")), "calls", "memory", "event_id")


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id END AS input_tokens, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id + 1 ELSE 0 END AS output_tokens, CASE event_id % 3 WHEN 1 THEN 7 ELSE 0 END::BIGINT AS cached_tokens FROM events""")
def token_usage(spark, sf_dir):
    i, u = F.col("event_id").cast("string"), F.col("user_id")
    one = F.concat(F.lit('{"usage":{"input_tokens":'), i, F.lit(',"output_tokens":'), u.cast("string"), F.lit("}}"))
    two = F.concat(F.lit('{"usage":{"prompt_tokens":'), i, F.lit(',"completion_tokens":'), (u + 1).cast("string"), F.lit(',"prompt_tokens_details":{"cached_tokens":7}}}'))
    answer = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, two).otherwise("{}")
    return surface.token_usage(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), "answer", "event_id")


@query(f"""{ctes("runs")} SELECT DISTINCT worker FROM runs WHERE created_at > TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-10'""")
def recent_workers(spark, sf_dir):
    return surface.distinct_recent(derived(spark, sf_dir, "runs"), "worker", "created_at", _at("2024-01-10"))


@query("""WITH h AS (SELECT doc_id, (length(text) - length(replace(text, 'e', '')))::INTEGER AS score FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) SELECT doc_id, h.score, source, length(text)::INTEGER AS n_chars FROM h JOIN documents USING (doc_id)""")
def attributed_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = docs.filter("doc_id % 3 = 0 and text is not null").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("score"))
    return surface.attributed(hits, docs.select("doc_id", "source", "text"))


@query(f"""{ctes("memories")}, k AS (SELECT type, status, count(*) AS n FROM memories GROUP BY 1, 2) SELECT type, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS stats FROM k GROUP BY 1""")
def nested_stats(spark, sf_dir):
    return surface.nested_stats(derived(spark, sf_dir, "memories"), "type", "status")


@query("""WITH e AS (SELECT event_id, unnest([{'ref': 'r' || user_id % 3, 'label': NULL, 'at': '2024-01-0' || (event_id % 9 + 1)}, {'ref': '', 'label': 'l' || user_id % 2, 'at': '2023'}, {'ref': 'r' || user_id % 3, 'label': 'x', 'at': '2024-01-05'}, {'ref': NULL, 'label': '', 'at': NULL}]) AS s FROM events),
k AS (SELECT event_id, coalesce(nullif(s.ref, ''), nullif(s.label, '')) AS key, s.ref AS ref, coalesce(s.at, '') AS observed_at FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY observed_at DESC, ref NULLS LAST) AS n FROM k WHERE key IS NOT NULL)
SELECT event_id, key, ref, observed_at FROM r WHERE n = 1""")
def source_references(spark, sf_dir):
    text = F.concat(
        F.lit('[{"ref":"r'), F.col("user_id") % 3, F.lit('","observed_at":"2024-01-0'), F.col("event_id") % 9 + 1, F.lit('"},{"ref":"","label":"l'), F.col("user_id") % 2,
        F.lit('","observed_at":"2023"},{"ref":"r'), F.col("user_id") % 3, F.lit('","label":"x","observed_at":"2024-01-05"},{"label":""}]'),
    )
    return surface.deduped_references(table(spark, sf_dir, "events").select("event_id", text.alias("sources")), "sources", "event_id")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS valence, CASE event_id % 3 WHEN 1 THEN 0.25 ELSE 0.3 END::DOUBLE AS arousal, 0.5::DOUBLE AS dominance, CASE event_id % 3 WHEN 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS intensity, CASE event_id % 3 WHEN 0 THEN 'joy' ELSE 'neutral' END AS primary_emotion FROM events""")
def affect_states(spark, sf_dir):
    i = F.col("event_id") % 3
    text = F.when(i == 0, '{"valence":7,"arousal":"loud","intensity":0.75,"primary_emotion":"joy"}').when(i == 1, '{"valence":-2.5,"arousal":0.25,"primary_emotion":""}')
    return surface.affect(table(spark, sf_dir, "events").select("event_id", text.alias("state")), "state", "event_id")


@query("""WITH h AS (SELECT s_suppkey AS id, (s_suppkey % 7) / 10.0 AS delta, s_suppkey % 4 AS times, 0.9 + (s_suppkey % 3) / 50.0 AS confidence FROM supplier),
m AS (SELECT user_id AS id, sum(value / 100) AS d, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT h.id, round(CASE WHEN times + coalesce(n, 0) > 0 THEN (delta * times + coalesce(d, 0)) / (times + coalesce(n, 0)) ELSE delta END, 6) AS delta, times + coalesce(n, 0) AS times, round(CASE WHEN n > 0 THEN greatest(confidence, least(0.95, confidence + 0.02 * n)) ELSE confidence END, 6) AS confidence FROM h LEFT JOIN m USING (id)""")
def learned_triggers(spark, sf_dir):
    k = F.col("s_suppkey")
    held = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 7 / 10.0).alias("delta"), (k % 4).alias("times"), (0.9 + k % 3 / 50.0).alias("confidence"))
    met = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("id"), (F.col("value") / 100).alias("delta"))
    return surface.learned_triggers(held, met).withColumns({c: F.round(c, 6) for c in ("delta", "confidence")})


@query(f"""{ctes("memories")} SELECT id, round(least(1.0, greatest(0.0, 0.5 * 0.4)), 6)::DOUBLE AS boost, round(least(1.0, greatest(0.1, importance + 0.5 * 0.12)), 8) AS importance FROM memories WHERE status = 'active' AND created_at >= TIMESTAMP '2024-01-10' - INTERVAL 600 MINUTE AND created_at <= TIMESTAMP '2024-01-10' AND importance IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 50""")
def reward_spike(spark, sf_dir):
    out = surface.spiked(derived(spark, sf_dir, "memories").filter("importance is not null"), 0.5, _at("2024-01-10"), minutes=600)
    return out.select("id", F.round("boost", 6).alias("boost"), F.round("importance", 8).alias("importance"))


@query(f"""{ctes("memories")}, c AS (SELECT id % 50 AS id, id AS n, 'no: ' || content AS text, id % 20 = 0 AS invalid FROM memories WHERE id % 4 = 0)
SELECT m.id, string_agg(c.text, '; ' ORDER BY c.n, c.text) AS corrections, arg_max(c.text, c.n) AS latest, bool_or(invalid) AS invalid FROM memories m JOIN c USING (id) GROUP BY 1""")
def corrected_memories(spark, sf_dir):
    memories = derived(spark, sf_dir, "memories")
    made = memories.filter("id % 4 = 0").select((F.col("id") % 50).alias("id"), F.col("id").alias("at"), F.concat(F.lit("no: "), "content").alias("text"), (F.col("id") % 20 == 0).alias("invalid"))
    return surface.corrected(memories, made)


@query(f"""{ctes("memories")}, b AS (SELECT coalesce(min(created_at) FILTER (type = 'episodic' AND {_j("type")} = 'initialization'), min(created_at)) AS born FROM memories)
SELECT born, (date_diff('day', born::DATE, DATE '2024-01-31') + 1)::INTEGER AS day_of_life, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(born)) / 86400000000))::BIGINT AS age_days FROM b""")
def lifetime(spark, sf_dir):
    return surface.lifetime(derived(spark, sf_dir, "memories"), _at("2024-01-31"))


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_quantity / 50.0 AS w FROM lineitem WHERE l_linenumber <= 2), s AS (SELECT DISTINCT src AS seed FROM e WHERE src <= 40),
p AS (SELECT seed, dst AS node, 1 AS depth, w AS weight, [seed, dst] AS path FROM s JOIN e ON e.src = seed WHERE dst <> seed),
q AS (SELECT * FROM p UNION ALL SELECT seed, e.dst, 2, weight * w, list_append(path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(path, e.dst)),
t AS (SELECT seed, node, depth, weight, array_to_string(path, '>') AS path FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, weight DESC, path) AS rank FROM t)
SELECT seed, node, depth, round(weight, 6) AS weight, path, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def context_paths(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_quantity") / 50.0).alias("weight"))
    seeds = edges.filter("src <= 40").select(F.col("src").alias("node")).distinct()
    return surface.context_paths(edges, seeds).withColumn("weight", F.round("weight", 6))


@query("""WITH i AS (SELECT user_id AS connection, event_id % 100 AS item, CASE WHEN event_id % 6 > 0 THEN event_type || event_id END AS content, CASE event_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN '' END AS sensitivity, ts AS seen FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY connection, item ORDER BY seen DESC, content DESC NULLS LAST) AS n FROM i)
SELECT connection, item, sha256(connection || chr(30) || item || chr(30) || coalesce(content, '')) AS content_hash, coalesce(nullif(sensitivity, ''), 'private') AS sensitivity FROM r WHERE n = 1""")
def item_documents(spark, sf_dir):
    rows = derived(spark, sf_dir, "runs").select(F.col("worker").alias("connection"), (F.col("id") % 100).alias("item"), F.when(F.col("id") % 6 > 0, F.concat("tool_name", F.col("id").cast("string"))).alias("content"), F.when(F.col("id") % 3 == 0, "public").when(F.col("id") % 3 == 1, "").alias("sensitivity"), F.col("created_at").alias("at"))
    return surface.item_documents(rows)


@query(f"""{ctes("recallable")}, live AS (SELECT m.*, CASE type WHEN 'episodic' THEN 'episodic' WHEN 'semantic' THEN 'semantic' ELSE 'knowledge' END AS tier, {SQL_SIM.replace("e.embedding", "m.embedding")} AS sim FROM recallable m
  WHERE status = 'active' AND embedding_status = 'embedded' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-31') AND coalesce(sensitivity, '') <> 'private'),
seeds AS (SELECT id, sim FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sim DESC, id) AS r FROM live WHERE sim IS NOT NULL) WHERE r <= CASE tier WHEN 'semantic' THEN 20 ELSE 10 END),
nb AS (SELECT id, (id * 7 + 3) % 1000 AS neighbour, 0.5 + (id % 4) / 10.0 AS weight FROM recallable), assoc AS (SELECT neighbour AS id, max(weight * sim) AS a FROM nb JOIN seeds USING (id) GROUP BY 1),
ed AS (SELECT id AS src, (id * 3 + 1) % 1000 AS dst, CASE id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CAUSES' ELSE 'MENTIONS' END AS rel, CASE WHEN id % 5 > 0 THEN 0.75 END AS weight FROM recallable),
eb AS (SELECT src, dst, coalesce(weight, 1.0) AS w FROM ed WHERE rel IN ('SUPPORTS', 'CAUSES') UNION ALL SELECT dst, src, coalesce(weight, 1.0) FROM ed WHERE rel IN ('SUPPORTS', 'CAUSES')),
gr AS (SELECT dst AS id, max(w * sim) AS g FROM eb JOIN seeds ON seeds.id = eb.src GROUP BY 1), tm AS (SELECT id, 0.15 AS t FROM (SELECT DISTINCT id FROM recallable WHERE id % 37 = 5 ORDER BY id LIMIT 20)),
pool AS (SELECT id, max(v) AS v, max(a) AS a, max(g) AS g, max(t) AS t FROM (SELECT id, sim AS v, NULL AS a, NULL AS g, NULL AS t FROM seeds UNION ALL SELECT id, NULL, a, NULL, NULL FROM assoc UNION ALL SELECT id, NULL, NULL, g, NULL FROM gr UNION ALL SELECT id, NULL, NULL, NULL, t FROM tm) GROUP BY 1),
s AS (SELECT l.id, tier, greatest(0.001, coalesce(v, sim) * (0.5 + 0.5 * greatest(0.0, least(1.0, coalesce(importance, 0.5) * exp(-greatest(coalesce(decay_rate, 0.01), 0.0) * greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(coalesce(last_reinforced, created_at))) / 86400000000.0, 0.0)))))
  + coalesce(a, 0) * 0.2 + coalesce(t, 0) + coalesce(g, 0) * 0.12 + 0.1 * exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 86400000000.0, 0.0) / 7.0) + coalesce(trust_level, 0.5) * 0.1 + least(1.0, activation_boost) * 0.3
  - CASE WHEN invalid_precedent THEN 0.35 ELSE 0 END + coalesce(1.0 - abs({_j("emotional_valence")}::DOUBLE - 0.25) / 2.0, 0.5) * 0.05) AS score,
  CASE WHEN v IS NOT NULL THEN 'vector' WHEN a IS NOT NULL THEN 'association' WHEN t IS NOT NULL THEN 'temporal' ELSE 'graph' END AS source FROM live l JOIN pool p ON p.id = l.id WHERE sim IS NOT NULL AND trust_level >= 0.2)
SELECT id, tier, round(score, 6) AS score, source, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= CASE tier WHEN 'semantic' THEN 10 ELSE 5 END""")
def context_recall(spark, sf_dir):
    rows, i = derived(spark, sf_dir, "recallable"), F.col("id")
    near = rows.select("id", ((i * 7 + 3) % 1000).alias("neighbour"), (0.5 + i % 4 / 10.0).alias("weight"))
    rel = F.when(i % 3 == 0, "SUPPORTS").when(i % 3 == 1, "CAUSES").otherwise("MENTIONS")
    edges = rows.select(i.alias("src"), ((i * 3 + 1) % 1000).alias("dst"), rel.alias("rel"), F.when(i % 5 > 0, 0.75).alias("weight"))
    out = recall.in_context(rows, vector(spark, sf_dir), _at("2024-01-31"), near, edges, rows.filter("id % 37 = 5"), mood=(0.25, 0.5, "calm"), least_trust=0.2, show_private=False)
    return out.withColumn("score", F.round("score", 6))


_SQL_COVER = """w AS (SELECT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM src), p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w),
h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM p WHERE term IN ('er', 'en', 'ed')),
l AS (SELECT *, max(CASE WHEN term = 'er' THEN pos END) OVER a AS er, max(CASE WHEN term = 'en' THEN pos END) OVER a AS en, max(CASE WHEN term = 'ed' THEN pos END) OVER a AS ed FROM h WINDOW a AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, greatest(CASE WHEN er IS NOT NULL AND en IS NOT NULL THEN least(er, en) END, ed) AS low FROM l),
c AS (SELECT f.*, lag(low) OVER (PARTITION BY id ORDER BY pos) AS before FROM f),
r AS (SELECT c.id, count(*) AS covers, sum(0.1 / (1 + (c.pos - c.low) - (c.n - s.n))) AS r FROM c JOIN h s ON s.id = c.id AND s.pos = c.low WHERE c.low IS NOT NULL AND (before IS NULL OR c.low > before) GROUP BY 1)"""
_ASKED = 'the er en OR ed -"zz top"'


@query(f"""WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_SQL_COVER} SELECT id, covers, round(r / (r + 1), 6) AS score FROM r""")
def ranked_search(spark, sf_dir):
    return postings.cover_ranks(documents_index(spark, sf_dir), search.web_query(_ASKED)).withColumn("score", F.round("score", 6))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE source <> 'src0'), k AS (SELECT doc_id, i AS part, substr(text, i * 1680 + 1, 1800) AS t FROM documents, LATERAL (SELECT unnest(range(0, (greatest(length(text) - 1, 0) // 1680) + 1)) AS i) WHERE length(text) > 0),
src AS (SELECT doc_id * 100000 + 99999 AS id, text AS t FROM d UNION ALL SELECT doc_id * 100000 + part, t FROM k), {_SQL_COVER},
g AS (SELECT id // 100000 AS doc_id, id % 100000 AS part, r / (r + 1) AS s FROM r), b AS (SELECT doc_id, max(s) FILTER (part = 99999) AS own, max({{'s': s, 'p': -part}}) FILTER (part < 99999) AS m FROM g GROUP BY 1)
SELECT doc_id AS id, round(greatest(own, m.s), 6) AS score, (-m.p)::INTEGER AS best_part, (row_number() OVER (ORDER BY greatest(own, m.s) DESC, doc_id))::INTEGER AS rank FROM b WHERE doc_id IN (SELECT doc_id FROM d) ORDER BY greatest(own, m.s) DESC, doc_id LIMIT 10 OFFSET 5""")
def document_search(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").filter(F.col("source") != "src0").select(F.col("doc_id").alias("id"))
    found = postings.document_search(documents_index(spark, sf_dir), parts_index(spark, sf_dir), wanted, search.web_query(_ASKED), 10, 5)
    return found.withColumn("score", F.round("score", 6))
