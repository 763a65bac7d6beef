"""Queries that join vectors with vectors, and the whole of recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import tiers, vector_join
from cairnlake.plans.base import query, table, vector
from cairnlake.plans.derived import ctes, derived

_AT = "TIMESTAMP '2024-01-31'"


def _now():
    return F.lit("2024-01-31").cast("timestamp")


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS k FROM s WHERE sim >= 0.2) SELECT query_id, id, round(sim, 6) AS similarity, k::INTEGER AS rank FROM r WHERE k <= 10""")
def all_neighborhoods(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return vector_join.nearest_of_all(df, df, 10, 0.2).withColumn("similarity", F.round("similarity", 6))


@query(f"""{ctes("recallable")}, held AS (SELECT id, id % 3 = 0 AS is_stale, CASE WHEN id % 4 > 0 THEN created_at END AS computed_at FROM recallable),
st AS (SELECT id FROM held WHERE is_stale ORDER BY computed_at NULLS FIRST, id LIMIT 100), live AS (SELECT id, embedding FROM recallable WHERE status = 'active' AND embedding_status = 'embedded'),
s AS (SELECT st.id AS q, l.id, list_cosine_similarity(m.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS sim FROM st JOIN recallable m ON m.id = st.id JOIN live l ON l.id <> st.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS k FROM s WHERE sim >= 0.25)
SELECT st.id, count(r.id)::INTEGER AS neighbours, round(sum(r.sim), 6) AS weight, min(r.id) AS least_id FROM st LEFT JOIN r ON r.q = st.id AND k <= 20 GROUP BY st.id""")
def renewed_neighborhoods(spark, sf_dir):
    rows = derived(spark, sf_dir, "recallable")
    held = rows.select("id", (F.col("id") % 3 == 0).alias("is_stale"), F.when(F.col("id") % 4 > 0, F.col("created_at")).alias("computed_at"))
    out = vector_join.renewed_neighbourhoods(rows, held, _now(), 20, 0.25, 100)
    weight = F.aggregate(F.map_values("neighbours"), F.lit(0.0), lambda s, x: s + x)
    n = F.size("neighbours")
    return out.select("id", n.alias("neighbours"), F.when(n > 0, F.round(weight, 6)).alias("weight"), F.array_min(F.map_keys("neighbours")).alias("least_id"))


_SQL_DUE = f"""p AS (SELECT id, embedding, CASE WHEN id % 35 > 0 THEN 'what was ' || id END AS asked, created_at - INTERVAL 1 HOUR AS created_at, CASE WHEN id % 14 = 0 THEN {_AT} ELSE created_at END AS started_at FROM recallable WHERE id % 7 = 0),
due AS (SELECT * FROM p WHERE started_at <= {_AT} - INTERVAL 30 SECOND ORDER BY created_at, id LIMIT 10), live AS (SELECT * FROM recallable WHERE status = 'active' AND (valid_until IS NULL OR valid_until > {_AT})),
s AS (SELECT d.id AS search, d.asked, d.created_at AS filed, l.id, l.content, l.sensitivity, l.activation_boost, list_cosine_similarity(d.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS sim FROM due d, live l)"""


def _searches(spark, sf_dir):
    rows = derived(spark, sf_dir, "recallable")
    asked = F.when(F.col("id") % 35 > 0, F.concat(F.lit("what was "), F.col("id").cast("string")))
    started = F.when(F.col("id") % 14 == 0, _now()).otherwise(F.col("created_at"))
    pending = rows.filter("id % 7 = 0").select("id", "embedding", asked.alias("asked"), started.alias("started_at"), (F.col("created_at") - F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return vector_join.resolved_searches(rows, pending, _now(), boost_least=0.3, tell_least=0.3, told_before=1, tell_most=6)


@query(f"{ctes('recallable')}, {_SQL_DUE} SELECT id, round(least(1.0, any_value(activation_boost) + 0.45 * count(*)), 6) AS activation_boost FROM s WHERE sim >= 0.3 GROUP BY id")
def resolved_search_boosts(spark, sf_dir):
    return _searches(spark, sf_dir)[0].withColumn("activation_boost", F.round("activation_boost", 6))


@query(f"""{ctes('recallable')}, {_SQL_DUE}, b AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY sim DESC, id) AS k FROM s WHERE coalesce(sensitivity, '') <> 'private' AND asked IS NOT NULL)
SELECT search, id, round(sim, 6) AS similarity, 'Earlier I couldn''t remember this: "' || left(asked, 160) || '". It came back to me — ' || left(content, 400) AS note FROM b WHERE k = 1 AND sim >= 0.3 ORDER BY filed, search LIMIT 5""")
def resolved_search_notes(spark, sf_dir):
    return _searches(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


#: Units with a vector each and with chunks, whose vectors are others of the table.
_UNITS = """SELECT u.id, CASE WHEN u.id % 13 = 4 THEN 'archived' ELSE 'active' END AS status, CASE WHEN u.id % 10 = 9 THEN 'pending' ELSE 'embedded' END AS embedding_status, u.user_id AS session,
  CASE WHEN u.id % 7 = 0 THEN 'private' END AS sensitivity, repeat('Unit ' || CAST(u.id AS STRING) || ' said so. ', 10 + CAST(u.id % 50 AS INT)) AS content, u.ts AS created_at, CAST((u.id % 5) / 5.0 AS DOUBLE) AS trust_level,
  u.id % 11 = 1 AS invalid_precedent, CASE WHEN u.id % 22 = 1 THEN 'not so' END AS correction, e.embedding FROM (SELECT event_id AS id, ts, user_id FROM events) u JOIN embeddings e ON e.vec_id = u.id"""
_CHUNKS = """SELECT CAST(vec_id DIV_ 3 AS BIGINT) AS unit_id, CAST(vec_id % 3 AS INT) AS chunk_index, CAST(100 * (vec_id % 3) AS INT) AS char_start, CAST(100 * (vec_id % 3) + 120 AS INT) AS char_end,
  CASE WHEN vec_id % 17 = 3 THEN 'pending' ELSE 'embedded' END AS embedding_status, embedding FROM embeddings"""


def _views(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("associative_embeddings")
    events = table(spark, sf_dir, "events")
    events.withColumn("ts", events["ts"].cast("timestamp")).createOrReplaceTempView("associative_events")
    named = lambda sql: sql.replace("embeddings e ", "associative_embeddings e ").replace("FROM embeddings", "FROM associative_embeddings").replace("FROM events", "FROM associative_events")
    return spark.sql(named(_UNITS)), spark.sql(named(_CHUNKS).replace("DIV_", "DIV"))


def _sql_units(query_vector: str) -> str:
    sim = lambda x: f"list_cosine_similarity({x}::DOUBLE[], {query_vector})"
    return f"""u AS ({_UNITS}), ch AS ({_CHUNKS.replace('DIV_', '//')}), lu AS (SELECT * FROM u WHERE status = 'active' AND embedding_status = 'embedded' AND coalesce(sensitivity, '') <> 'private'),
cand AS (SELECT id, {sim('embedding')} AS s, 1 AS kind, NULL::INTEGER AS part FROM lu UNION ALL SELECT lu.id, {sim('ch.embedding')}, 0, chunk_index FROM ch JOIN lu ON lu.id = ch.unit_id WHERE ch.embedding_status = 'embedded'),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, kind, part) = 1),
hit AS (SELECT one.*, lu.created_at FROM one JOIN lu USING (id) ORDER BY s DESC, created_at DESC, id LIMIT 10)"""


_VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"


@query(f"""WITH {_sql_units(_VEC)} SELECT h.id, round(s, 6) AS score, CASE kind WHEN 0 THEN 'chunk_vector' ELSE 'vector' END AS source, part, CASE WHEN kind = 0 THEN 100 * part END AS char_start, CASE WHEN kind = 0 THEN 100 * part + 120 END AS char_end,
(SELECT count(*) FROM ch WHERE unit_id = h.id)::INTEGER AS parts FROM hit h""")
def unit_vector_hits(spark, sf_dir):
    units, chunks = _views(spark, sf_dir)
    return tiers.unit_hits(units, chunks, vector(spark, sf_dir), 10, show_private=False).withColumn("score", F.round("score", 6))


@query(f"""{ctes("recallable")}, {_sql_units(_VEC)},
sub AS (SELECT u.id, CASE WHEN part IS NOT NULL AND length(u.content) > length(substr(u.content, 100 * part + 1, 120)) + 200 THEN '[Matching RecMem span: chunk ' || part || ', chars ' || 100 * part || '-' || (100 * part + 120) || ' of unit ' || u.id || ']' || chr(10) || chr(10) || substr(u.content, 100 * part + 1, 120) ELSE u.content END AS c,
  greatest(0.001, s - CASE WHEN invalid_precedent THEN 0.35 ELSE 0 END) AS score, CASE kind WHEN 0 THEN 'chunk_vector' ELSE 'vector' END AS source, invalid_precedent, correction FROM hit h JOIN u ON u.id = h.id),
late AS (SELECT id, content FROM u WHERE session = 7 AND status = 'active' AND embedding_status <> 'embedded' AND coalesce(sensitivity, '') <> 'private' ORDER BY created_at DESC, id LIMIT 3),
boosted AS (SELECT * FROM recallable WHERE status = 'active' AND (valid_until IS NULL OR valid_until > {_AT}) AND activation_boost > 0.3 ORDER BY activation_boost DESC, id LIMIT 2)
SELECT 'subconscious' AS tier, id, CASE WHEN invalid_precedent THEN '[INVALID PRECEDENT - do not imitate' || CASE WHEN correction IS NOT NULL THEN '; correction: ' || correction ELSE '' END || '] ' || c ELSE c END AS content, round(score, 6) AS score, source FROM sub
UNION ALL SELECT 'subconscious', id, content, 0.2, 'temporal' FROM late
UNION ALL SELECT 'spontaneous', id, content, round(least(1.0, activation_boost), 6), 'spontaneous' FROM boosted WHERE coalesce(sensitivity, '') <> 'private'""")
def unasked_recall(spark, sf_dir):
    """The tiers beside those of ``context_recall``: units, and what comes to mind."""
    units, chunks = _views(spark, sf_dir)
    rows = derived(spark, sf_dir, "recallable")
    out = tiers.subconscious(units, chunks, vector(spark, sf_dir), 10, show_private=False)
    out = out.unionByName(tiers.not_yet_embedded(units, 7, show_private=False))
    out = out.unionByName(tiers.spontaneous(rows, _now(), rows.select("id").limit(0), show_private=False))
    return out.select("tier", "id", "content", F.round("score", 6).alias("score"), "source")
