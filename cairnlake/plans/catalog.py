"""Registered queries of the library with their SQL equivalents.

Tables without a column that an operator needs get it from a formula of their
key, the same in both forms: e.g. a vector's age in days is ``vec_id % 60``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import scoring, text
from cairnlake.operators import graph, lifecycle, postings, rollups, search, temporal, vectors
from cairnlake.plans import associative, exchanges, ledger, lexical, memory, passes, status, streams, surface, upkeep
from cairnlake.plans.base import ORACLES, QUERIES, QUERY_ID, SQL_CANONICAL, SQL_SIM, query
from cairnlake.plans.base import as_of as _as_of
from cairnlake.plans.base import events as _events
from cairnlake.plans.base import table as _t
from cairnlake.plans.base import vector as _vector

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "associative", "exchanges", "ledger", "lexical", "memory", "passes", "status", "streams", "surface", "upkeep"]
FLAGSHIP = "hybrid_recall"

# Vectors


@query(f"""
WITH s AS (SELECT vec_id, {SQL_SIM} AS sim FROM embeddings e)
SELECT vec_id, round(0.7 * sim + 0.2 * exp(-ln(2) * (vec_id % 60) / 14.0) + 0.1 * (vec_id % 11) / 10.0, 6) AS score
FROM s WHERE sim IS NOT NULL ORDER BY 0.7 * sim + 0.2 * exp(-ln(2) * (vec_id % 60) / 14.0) + 0.1 * (vec_id % 11) / 10.0 DESC, vec_id LIMIT 10
""")
def vector_topk(spark, sf_dir):
    sim = vectors.cosine(F.col("embedding"), _vector(spark, sf_dir))
    score = 0.7 * sim + 0.2 * F.exp(-F.log(F.lit(2.0)) * (F.col("vec_id") % 60) / 14.0) + 0.1 * (F.col("vec_id") % 11) / 10.0
    out = _t(spark, sf_dir, "embeddings").select("vec_id", score.alias("s")).filter("s is not null").orderBy(F.desc("s"), "vec_id").limit(10)
    return out.select("vec_id", F.round("s", 6).alias("score"))


@query(f"""SELECT vec_id, label, round({SQL_SIM}, 6) AS similarity FROM embeddings e
WHERE label IN (1, 2, 3) ORDER BY {SQL_SIM} DESC, vec_id LIMIT 20""")
def vector_filtered_knn(spark, sf_dir):
    some = _t(spark, sf_dir, "embeddings").filter("label in (1, 2, 3)")
    return vectors.nearest(some, _vector(spark, sf_dir), 20).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round({SQL_SIM}, 6) AS similarity FROM embeddings e WHERE {SQL_SIM} >= 0.3")
def vector_threshold(spark, sf_dir):
    sim = vectors.cosine(F.col("embedding"), _vector(spark, sf_dir))
    return _t(spark, sf_dir, "embeddings").select("vec_id", sim.alias("s")).filter("s >= 0.3").select("vec_id", F.round("s", 6).alias("similarity"))


@query(f"""WITH a AS (SELECT count(*) FILTER (s > 0.5) AS matches, max(s) FILTER (s > 0.5) AS b FROM (SELECT {SQL_SIM} AS s FROM embeddings e))
SELECT matches, round(b, 6) AS best, CASE WHEN matches = 0 THEN 'nothing' WHEN matches <= 2 THEN 'vague' WHEN matches <= 5 THEN 'something' WHEN matches <= 10 THEN 'familiar' ELSE 'rich' END AS sense,
CASE WHEN matches = 0 THEN 'unknown' WHEN b > 0.8 THEN 'well known' WHEN b > 0.6 THEN 'familiar' ELSE 'not at once' END AS known FROM a""")
def memory_availability(spark, sf_dir):
    out = vectors.availability(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir))
    return out.select("matches", F.round("best", 6).alias("best"), "sense", "known")


_SQL_CENTER = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i),
centers AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label)"""


@query(f"WITH {_SQL_CENTER} SELECT label AS cluster, i::INTEGER AS dim, round(m, 6) AS mean FROM means")
def cluster_centroids(spark, sf_dir):
    out = vectors.centroids(_t(spark, sf_dir, "embeddings")).select("cluster", F.posexplode("centroid").alias("dim", "mean"))
    return out.select("cluster", (F.col("dim") + 1).alias("dim"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {_SQL_CENTER}, s AS (SELECT vec_id AS id, c.label AS cluster, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS sim FROM embeddings e, centers c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) AS k FROM s WHERE sim >= 0.2)
SELECT id, cluster, round(sim, 6) AS similarity FROM r WHERE k <= 3""")
def cluster_assignment(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    out = vectors.assigned(df, vectors.centroids(df), least=0.2)
    return out.select("id", "cluster", F.round("similarity", 6).alias("similarity"))


_SQL_NEAR = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS k FROM s)"""


def _neighbours(spark, sf_dir, k, least=-1.0):
    df = _t(spark, sf_dir, "embeddings")
    return vectors.nearest_of_each(df, df.filter("vec_id % 50 = 0"), k, least)


@query(f"WITH {_SQL_NEAR} SELECT query_id, id, round(sim, 6) AS similarity FROM r WHERE k <= 20 AND sim >= 0.2")
def neighborhoods(spark, sf_dir):
    return _neighbours(spark, sf_dir, 20, 0.2).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SQL_NEAR} SELECT query_id, id, round(sim, 6) AS similarity,
CASE WHEN sim >= 0.92 THEN 'duplicate' WHEN sim >= 0.4 THEN 'related' ELSE 'create' END AS decision FROM r WHERE k = 1""")
def duplicate_routing(spark, sf_dir):
    return vectors.routed(_neighbours(spark, sf_dir, 1), related=0.4).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_SQL_CENTER}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT label, list_cosine_similarity(c, (SELECT v FROM q)) AS s FROM centers), m AS (SELECT label, max(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q))) AS b FROM embeddings WHERE vec_id <> 0 GROUP BY label)
SELECT label AS cluster, round(s, 6) AS cluster_similarity, round(b, 6) AS best_member FROM c JOIN m USING (label) WHERE s >= 0.1 AND b < 0.6""")
def partial_activations(spark, sf_dir):
    df, q = _t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)
    near = vectors.centroids(df).select("cluster", vectors.cosine(F.col("centroid"), q).alias("s"))
    best = df.filter(F.col("vec_id") != QUERY_ID).groupBy(F.col("label").alias("cluster")).agg(F.max(vectors.cosine(F.col("embedding"), q)).alias("b"))
    return near.join(best, "cluster").filter("s >= 0.1 and b < 0.6").select("cluster", F.round("s", 6).alias("cluster_similarity"), F.round("b", 6).alias("best_member"))


# Text

_SQL_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
_SQL_TERMS = f"""tok AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: x NOT IN {_SQL_STOP}) AS w FROM documents),
hit AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'er')) AS a, len(list_filter(w, lambda x: x = 'en')) AS b FROM tok),
lex AS (SELECT id, a + b AS hits, (a + b) / sqrt(n::DOUBLE) / (1 + (a + b) / sqrt(n::DOUBLE)) AS score FROM hit WHERE a > 0 AND b > 0)"""


@query(f"WITH {_SQL_TERMS} SELECT id, hits::INTEGER AS hits, round(score, 6) AS score FROM lex")
def term_search(spark, sf_dir):
    out = postings.term_scores(lexical.documents_index(spark, sf_dir), ["er", "en"])
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_TERMS}, vec AS (SELECT vec_id AS id, {SQL_SIM} AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 100),
f AS (SELECT coalesce(v.id, t.id) AS id, CASE WHEN v.id IS NULL THEN least(1.0, greatest(0.35, t.score + 0.4)) ELSE 0.6 * v.score + 0.4 * coalesce(t.score, 0.0) END AS s,
  CASE WHEN v.id IS NULL THEN 'fts' WHEN t.id IS NULL THEN 'vector' ELSE 'hybrid' END AS source FROM vec v FULL JOIN lex t ON v.id = t.id)
SELECT id, round(s, 6) AS score, source FROM f ORDER BY s DESC, id LIMIT 50""")
def hybrid_recall(spark, sf_dir):
    by_vector = vectors.nearest(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 100).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    out = search.fused(by_vector, postings.term_scores(lexical.documents_index(spark, sf_dir), ["er", "en"]))
    return out.orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 6).alias("score"), "source")


@query("""SELECT doc_id, i::INTEGER AS chunk_index, (i * 1680)::INTEGER AS char_start, least(i * 1680 + 1800, length(text))::INTEGER AS char_end,
sha256(substr(text, i * 1680 + 1, 1800)) AS content_hash, greatest(1, length(substr(text, i * 1680 + 1, 1800)) // 4)::INTEGER AS token_count
FROM documents, LATERAL (SELECT unnest(range(0, (greatest(length(text) - 1, 0) // 1680) + 1)) AS i) WHERE length(text) > 0""")
def text_chunks(spark, sf_dir):
    return search.chunks(_t(spark, sf_dir, "documents")).drop("content")


@query(f"""WITH n AS (SELECT doc_id, sha256({SQL_CANONICAL.format("text")}) AS h FROM documents WHERE text IS NOT NULL)
SELECT h AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM n GROUP BY h HAVING count(*) > 1""")
def equal_content(spark, sf_dir):
    return search.equal_content(_t(spark, sf_dir, "documents"))


@query("""SELECT doc_id AS id, instr(lower(text), 'apache')::INTEGER AS at, substr(text, greatest(instr(lower(text), 'apache') - 40, 1), 86) AS snippet
FROM documents WHERE instr(lower(text), 'apache') > 0""")
def snippets(spark, sf_dir):
    return search.snippets(_t(spark, sf_dir, "documents"), "apache")


_SQL_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT c_custkey, {_SQL_GRAMS.format("c_name || ' ' || c_mktsegment")} AS a, {_SQL_GRAMS.format("'customer building 17'")} AS b FROM customer),
s AS (SELECT c_custkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM g)
SELECT c_custkey, round(s, 6) AS similarity FROM s WHERE s >= 0.3""")
def trigram_search(spark, sf_dir):
    sim = text.trigram_similarity(F.concat_ws(" ", "c_name", "c_mktsegment"), F.lit("customer building 17"))
    return _t(spark, sf_dir, "customer").select("c_custkey", sim.alias("s")).filter("s >= 0.3").select("c_custkey", F.round("s", 6).alias("similarity"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 5 > 0 THEN '  ' || event_type || ' 0a1b2c3d-0000-4000-8000-00000000000' || event_id % 7 || chr(10) || ' failed: ' || props END AS m, ts FROM events),
s AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(coalesce(m, '')), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '[0-9]+', '<n>', 'g'), '\\s+', ' ', 'g') AS shape, ts FROM e)
SELECT substr(shape, 1, 500) AS shape, count(*) AS n, min(ts) AS first_at FROM s GROUP BY 1""")
def error_shapes(spark, sf_dir):
    message = F.concat(F.lit("  "), "event_type", F.lit(" 0a1b2c3d-0000-4000-8000-00000000000"), F.col("event_id") % 7, F.lit("\n failed: "), "props")
    shape = text.error_shape(F.when(F.col("event_id") % 5 > 0, message))
    return _t(spark, sf_dir, "events").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


@query("""SELECT conv_id, turn, sha256(lower(regexp_replace(regexp_replace(trim(substr(coalesce(CASE WHEN turn % 4 > 0 THEN '  ' || text || ' -)! ' END, ''), 1, 4000)), '\\s+', ' ', 'g'), '[\\s[:punct:]]+$', ''))) AS fingerprint FROM conversations""")
def text_fingerprints(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.fingerprint(F.when(F.col("turn") % 4 > 0, F.concat(F.lit("  "), "text", F.lit(" -)! ")))), 256).alias("fingerprint"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_hash FROM a""")
def page_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(text.without_tags(F.col("html")), 256).alias("text_hash"))


@query("""SELECT doc_id, (length(text) - length(replace(text, '!', '')))::INTEGER AS exclamations, len(regexp_extract_all(text, '[0-9]{4,}'))::INTEGER AS long_numbers,
len(regexp_extract_all(text, '(?i)licensed under'))::INTEGER AS licences FROM documents WHERE text IS NOT NULL""")
def pattern_counts(spark, sf_dir):
    counts = {"exclamations": "!", "long_numbers": "[0-9]{4,}", "licences": "(?i)licensed under"}
    return _t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(c) for c, p in counts.items()])


# Scores

_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0"


@query(f"""SELECT event_id, round((value / 100) * exp(-0.05 * least({_AGE}, {_AGE} * 0.5)), 6) AS relevance,
round(greatest(0.0, least(1.0, coalesce(CASE WHEN event_id % 9 > 0 THEN value / 100 END, 0.5) * exp(-greatest(coalesce(CASE WHEN event_id % 7 > 0 THEN 0.02 END, 0.01), 0.0) * greatest({_AGE}, 0.0)))), 6) AS strength,
round(CASE WHEN event_type = 'error' THEN greatest(0.05, 0.6 * (1 - 0.35 * 0.8)) WHEN event_type = 'purchase' THEN least(0.99, 0.6 + 0.4 * 0.35 * 0.8) ELSE 0.6 END::DOUBLE, 6) AS confidence FROM events""")
def scores(spark, sf_dir):
    importance, ts = F.col("value") / 100, F.col("ts")
    stance = F.when(F.col("event_type") == "error", "contradicts").when(F.col("event_type") == "purchase", "supports").otherwise("none")
    return _events(spark, sf_dir).select(
        "event_id", F.round(scoring.relevance(importance, F.lit(0.05), ts, ts, _as_of()), 6).alias("relevance"),
        F.round(scoring.strength(F.when(F.col("event_id") % 9 > 0, importance), F.when(F.col("event_id") % 7 > 0, F.lit(0.02)), ts, F.lit(None).cast("timestamp"), _as_of()), 6).alias("strength"),
        F.round(scoring.revised_confidence(F.lit(0.6), stance, F.lit(0.8)), 6).alias("confidence"),
    )


@query(f"""WITH b AS (SELECT event_id, least(1.0, value / 100) AS enc, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE -0.5 END AS v, {_AGE} AS a FROM events),
c AS (SELECT *, greatest(0.0, v) * enc * 0.5 AS f FROM b), d AS (SELECT *, f + (enc - f) * exp(-0.02 * a) AS base FROM c)
SELECT event_id, round(least(enc, greatest(f, base + CASE WHEN v >= 0 THEN 1.0 ELSE 0.4 END * (enc - base) * exp(-0.5 * a))), 6) AS felt FROM d""")
def felt_intensity(spark, sf_dir):
    valence = F.when(F.col("event_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    felt = scoring.felt_intensity(F.col("value") / 100, valence, F.col("ts"), F.lit(None).cast("timestamp"), _as_of())
    return _events(spark, sf_dir).select("event_id", F.round(felt, 6).alias("felt"))


@query("""WITH s AS (SELECT source, count(DISTINCT lang) AS n, avg((length(coalesce(text, '')) % 100) / 100.0) AS t FROM documents GROUP BY source)
SELECT source, round(1 - exp(-0.8 * n * t), 6) AS support, round(CASE WHEN n > 2 THEN least(0.5, 0.5 * (0.15 + 0.85 * (1 - exp(-0.8 * n * t))) + 0.1 * 1.0) ELSE least(1.0, greatest(0.0, 0.9 * (0.15 + 0.85 * (1 - exp(-0.8 * n * t))) * (1.0 - 0.3))) END, 6) AS trust FROM s""")
def source_trust(spark, sf_dir):
    mean = F.avg((F.length(F.coalesce("text", F.lit(""))) % 100) / 100.0)
    out = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n"), mean.alias("t"))
    support = scoring.source_support(F.col("n"), F.col("t"))
    return out.select("source", F.round(support, 6).alias("support"), F.round(scoring.semantic_trust(F.when(F.col("n") <= 2, F.lit(0.9)), support, F.when(F.col("n") > 2, F.lit(7.0)).otherwise(F.lit(-0.3))), 6).alias("trust"))


# Aggregates


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_summary(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("user_id").alias("users"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def usage_daily(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def hourly_trend(spark, sf_dir):
    df = _events(spark, sf_dir)
    last = df.agg(F.max("ts")).first()[0]
    recent = df.filter(F.col("ts") > F.lit(last) - F.expr("interval 24 hours")) if last else df.limit(0)
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT l_returnflag AS kind, count(*) AS n, round(avg(l_quantity), 6) AS mean, count(*) FILTER (l_discount > 0.05) AS cheap, bool_or(l_tax > 0.07) AS taxed, bool_and(l_quantity > 0) AS positive FROM lineitem GROUP BY 1""")
def health_by_type(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed"), F.bool_and(F.col("l_quantity") > 0).alias("positive"),
    )


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def most_frequent_type(spark, sf_dir):
    return rollups.most_frequent(_t(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def latest_per_key(spark, sf_dir):
    return rollups.latest(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""SELECT event_type, event_id, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def top_per_type(spark, sf_dir):
    return rollups.top_of_each(_t(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], 5, F.desc("value"), F.col("event_id"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, arg_min(substr(text, 1, 80), turn) AS opening, arg_max(substr(text, 1, 80), turn) AS closing FROM conversations GROUP BY conv_id""")
def conversation_stats(spark, sf_dir):
    head = F.substring("text", 1, 80)
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.min_by(head, "turn").alias("opening"), F.max_by(head, "turn").alias("closing"))


_PRICES = [("ECONOMY", 1.0), ("ECONOMY-1", 1.5), ("STANDARD", 2.0), ("PROMO-2024", 0.5), ("S", 3.0), ("L", 2.5), ("SMALL-2", 4.0), ("SMALL-20", 5.0)]


@query(f"""WITH p(k, price) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _PRICES)}),
m AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_type || '-' || p_size ELSE p_type END AS model FROM part),
r AS (SELECT p_partkey, p_size, k, price, row_number() OVER (PARTITION BY p_partkey ORDER BY k = model DESC, length(k) DESC, k DESC) AS n FROM m LEFT JOIN p ON starts_with(model, k) OR starts_with(k, model))
SELECT p_partkey, k AS price_key, round(p_size * price::DOUBLE / 1000000.0, 6) AS cost FROM r WHERE n = 1""")
def prefix_costs(spark, sf_dir):
    model = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("-"), "p_size")).otherwise(F.col("p_type"))
    out = rollups.priced(_t(spark, sf_dir, "part").select("p_partkey", "p_size", model.alias("model")), _PRICES, "model")
    return out.select("p_partkey", "price_key", F.round(F.col("p_size") * F.col("price") / 1000000.0, 6).alias("cost"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT * FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def ordered_lists(spark, sf_dir):
    some = _t(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return some.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT >= 90")
def json_fields(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k")).filter("k >= 90")


# Joins and sets


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def region_totals(spark, sf_dir):
    spent = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    own = _t(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    out = _t(spark, sf_dir, "region").join(_t(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(own, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("r_name", "n_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice < 20000)")
def semi_and_anti(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    rich, poor = orders.filter("o_totalprice > 300000"), orders.filter("o_orderstatus = 'F' and o_totalprice < 20000")
    out = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return out.join(rich, out.c_custkey == rich.o_custkey, "left_semi").join(poor, out.c_custkey == poor.o_custkey, "left_anti")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def union_distinct(spark, sf_dir):
    df = _t(spark, sf_dir, "events")
    return df.filter("event_type = 'purchase'").select("user_id").union(df.filter("event_type = 'error'").select("user_id")).distinct()


@query("SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'de' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10 OFFSET 20")
def page_of_hits(spark, sf_dir):
    some = _t(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", "n_chars")
    total = some.count()
    return some.orderBy(F.desc_nulls_last("n_chars"), "doc_id").offset(20).limit(10).withColumn("total", F.lit(total).cast("long"))


@query("""WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-03'), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29')
SELECT user_id AS id, 'added' AS change FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'expired' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def snapshot_difference(spark, sf_dir):
    df = _events(spark, sf_dir).filter("event_type = 'purchase'").withColumnRenamed("user_id", "id")
    at = lambda day: F.lit(day).cast("timestamp")
    return temporal.difference(df.filter(F.col("ts") < at("2024-01-03")), df.filter(F.col("ts") >= at("2024-01-29")))


# Time


@query("""WITH v AS (SELECT user_id, event_type, value, ts AS a, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_type, value FROM v WHERE a <= TIMESTAMP '2024-01-15' AND (b IS NULL OR b > TIMESTAMP '2024-01-15')""")
def valid_at(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).select("user_id", "event_type", "value", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"))
    return temporal.valid_at(rows, F.lit("2024-01-15").cast("timestamp")).select("user_id", "event_type", "value")


@query("""WITH c AS (SELECT user_id AS id, ts, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events),
n AS (SELECT user_id AS id, arg_max(value, event_id) AS value FROM events GROUP BY 1),
f AS (SELECT id, arg_min(coalesce(prior, -1), event_id) AS prior FROM c WHERE ts > TIMESTAMP '2024-01-15' GROUP BY id)
SELECT n.id, CASE WHEN f.id IS NULL THEN n.value WHEN f.prior = -1 THEN NULL ELSE f.prior END AS value FROM n LEFT JOIN f USING (id)""")
def state_as_of(spark, sf_dir):
    from pyspark.sql import Window as W

    df = _events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", "event_id", "value")
    now = df.groupBy("id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    log = df.select("id", F.col("ts").alias("changed_at"), F.col("event_id").alias("change_no"), F.lag("value").over(W.partitionBy("id").orderBy("ts", "event_id")).alias("prior"))
    return temporal.state_as_of(now, log, F.lit("2024-01-15").cast("timestamp"))


@query("""WITH o AS (SELECT user_id AS id, avg(value) / 100 AS was FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT user_id AS id, avg(value) / 100 AS now FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT id, was, now, CASE WHEN was IS NULL THEN 'created' WHEN now IS NULL THEN 'removed' WHEN now - was >= 0.02 THEN 'strengthened' WHEN was - now >= 0.02 THEN 'weakened' END AS kind FROM o FULL JOIN n USING (id))
SELECT id, round(was, 6) AS was, round(now, 6) AS now, kind FROM b WHERE kind IS NOT NULL""")
def change_kinds(spark, sf_dir):
    df, half = _events(spark, sf_dir), F.lit("2024-01-16").cast("timestamp")
    side = lambda some: some.groupBy(F.col("user_id").alias("id")).agg((F.avg("value") / 100).alias("value"))
    out = temporal.changes(side(df.filter(F.col("ts") < half)), side(df.filter(F.col("ts") >= half)), threshold=0.02)
    return out.select("id", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"), "kind")


_SQL_SESSIONS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS f FROM events),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
s AS (SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM n GROUP BY 1, 2)"""


@query(f"WITH {_SQL_SESSIONS} SELECT * FROM s")
def sessions(spark, sf_dir):
    return lifecycle.sessions(_events(spark, sf_dir))


@query(f"""WITH {_SQL_SESSIONS} SELECT user_id, session, events FROM s WHERE "end" < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE""")
def idle_sessions(spark, sf_dir):
    found = lifecycle.idle(lifecycle.sessions(_events(spark, sf_dir)), F.lit("2024-01-20").cast("timestamp"))
    return found.select("user_id", "session", "events")


@query("""WITH t AS (SELECT event_id AS task_id, ts AS created_at, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' ELSE 'done' END AS status, (event_id % 4)::INTEGER AS attempts, ts + INTERVAL 1 HOUR AS claimed_at FROM events)
SELECT task_id, 'in_progress' AS status, attempts + 1 AS attempts, round(30.0 * power(2.0, greatest(attempts - 1, 0)), 3) AS retry_seconds FROM t
WHERE status = 'pending' OR status = 'in_progress' AND claimed_at < TIMESTAMP '2024-01-10' - INTERVAL 10 MINUTE ORDER BY created_at, task_id LIMIT 100""")
def queue_lease(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "in_progress").otherwise("done")
    tasks = _events(spark, sf_dir).select(F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"), kind.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), (F.col("ts") + F.expr("interval 1 hour")).alias("claimed_at"))
    out = lifecycle.lease(tasks, F.lit("2024-01-10").cast("timestamp"), 100)
    return out.select("task_id", "status", "attempts", F.round(scoring.backoff_seconds(30, F.col("attempts") - 1), 3).alias("retry_seconds"))


@query("""SELECT event_id, event_type, n AS starts FROM (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 5""")
def start_storms(spark, sf_dir):
    return lifecycle.storms(_events(spark, sf_dir), "event_type", window_seconds=7200).select("event_id", "event_type", "starts")


@query("""WITH RECURSIVE p AS (SELECT user_id, min(ts) AS t, 1 AS n FROM events GROUP BY user_id UNION ALL
SELECT p.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts >= p.t + INTERVAL 12 HOUR), p.n + 1 FROM p
WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.ts >= p.t + INTERVAL 12 HOUR))
SELECT c.user_id, c.events, s.spaced, round(1 - exp(-s.spaced / 4.0), 6) AS score FROM (SELECT user_id, count(*) AS events FROM events GROUP BY 1) c JOIN (SELECT user_id, max(n)::BIGINT AS spaced FROM p GROUP BY 1) s USING (user_id)""")
def spaced_reinforcement(spark, sf_dir):
    return lifecycle.spaced_counts(_events(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT event_id AS id, round(value * 100)::BIGINT AS strength FROM events),
r AS (SELECT *, coalesce(sum(strength) OVER (ORDER BY strength, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(strength) OVER () AS total FROM s)
SELECT id, strength FROM r WHERE total - before > 1000000""")
def capacity_pruning(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("strength"))
    return lifecycle.over_capacity(rows, 1000000)


@query("""SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, max(value) AS importance FROM events
WHERE ts < TIMESTAMP '2024-01-08' AND value < 5 AND event_type <> 'purchase' GROUP BY user_id HAVING count(*) >= 3""")
def consolidation_groups(spark, sf_dir):
    weak = _events(spark, sf_dir).filter((F.col("ts") < F.lit("2024-01-08").cast("timestamp")) & (F.col("value") < 5) & (F.col("event_type") != "purchase"))
    out = weak.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("i"), F.max("value").alias("importance")).filter(F.size("i") >= 3)
    return out.select("user_id", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("ids"), "importance")


# Graphs

_SQL_EDGES = """e AS (SELECT o_custkey * 10 + 1 AS src, c_nationkey::BIGINT * 10 + 2 AS dst, 0.9 AS weight FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, n_regionkey::BIGINT * 10 + 3, 0.8 FROM nation)"""


def _place_edges(spark, sf_dir):
    buyers = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    lives = buyers.join(_t(spark, sf_dir, "customer"), "c_custkey").select((F.col("c_custkey") * 10 + 1).alias("src"), (F.col("c_nationkey").cast("long") * 10 + 2).alias("dst"), F.lit("LIVES_IN").alias("rel"), F.lit(0.9).alias("weight"))
    lies = _t(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 10 + 2).alias("src"), (F.col("n_regionkey").cast("long") * 10 + 3).alias("dst"), F.lit("PART_OF").alias("rel"), F.lit(0.8).alias("weight"))
    return lives.unionByName(lies)


@query(f"""WITH RECURSIVE {_SQL_EDGES}, u AS (SELECT src AS a, dst AS b, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
w AS (SELECT 13::BIGINT AS node, 0 AS depth, 1.0::DOUBLE AS relevance UNION SELECT u.b, w.depth + 1, w.relevance * u.weight FROM w JOIN u ON u.a = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth, round(max(relevance), 6) AS relevance FROM w GROUP BY node""")
def graph_neighbourhood(spark, sf_dir):
    seeds = spark.range(13, 14).withColumnRenamed("id", "node")
    return graph.reached(_place_edges(spark, sf_dir), seeds, 3).withColumn("relevance", F.round("relevance", 6))


_SQL_TREE = "e AS (SELECT o_orderkey // 2 AS src, o_orderkey AS dst, 0.5::DOUBLE AS weight FROM orders UNION ALL SELECT o_orderkey // 3, o_orderkey, 0.25::DOUBLE FROM orders WHERE o_orderkey % 3 = 0)"


def _tree_edges(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    half = orders.select(F.expr("o_orderkey div 2").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("CAUSES").alias("rel"), F.lit(0.5).alias("weight"))
    third = orders.filter("o_orderkey % 3 = 0").select(F.expr("o_orderkey div 3").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("CAUSES").alias("rel"), F.lit(0.25).alias("weight"))
    return half.unionByName(third)


@query(f"""WITH RECURSIVE {_SQL_TREE}, w AS (SELECT o_orderkey AS node, 0 AS distance FROM orders WHERE o_orderkey IN (900, 777) UNION SELECT e.src, w.distance + 1 FROM w JOIN e ON e.dst = w.node WHERE w.distance < 10)
SELECT node, min(distance) AS distance FROM w GROUP BY node HAVING min(distance) > 0""")
def causal_chain(spark, sf_dir):
    effects = _t(spark, sf_dir, "orders").filter("o_orderkey in (900, 777)").select(F.col("o_orderkey").alias("node"))
    return graph.causes(_tree_edges(spark, sf_dir), effects)


@query(f"""WITH RECURSIVE {_SQL_TREE}, w AS (SELECT 5::BIGINT AS seed, 5::BIGINT AS node, 0 AS depth, 1.0::DOUBLE AS weight, [5::BIGINT] AS path UNION ALL
SELECT w.seed, e.dst, w.depth + 1, w.weight * e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE w.depth < 4 AND NOT list_contains(w.path, e.dst))
SELECT seed, node, depth, round(weight, 6) AS weight, array_to_string(path, '>') AS path FROM w WHERE depth > 0""")
def graph_paths(spark, sf_dir):
    out = graph.paths(_tree_edges(spark, sf_dir), spark.range(5, 6).withColumnRenamed("id", "node"), 4)
    return out.select("seed", "node", "depth", F.round("weight", 6).alias("weight"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH {_SQL_EDGES}, m AS (SELECT CASE WHEN src % 10 = 2 THEN -(src % 3) - 1 ELSE src END AS s, CASE WHEN dst % 10 = 2 THEN -(dst % 3) - 1 ELSE dst END AS d, weight FROM e)
SELECT s AS src, d AS dst, round(1 - exp(sum(ln(greatest(1e-9, 1 - least(1.0, weight))))), 6) AS weight, count(*) AS edges FROM m WHERE s <> d GROUP BY 1, 2""")
def merged_edges(spark, sf_dir):
    edges = _place_edges(spark, sf_dir)
    groups = _t(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 10 + 2).alias("node")).withColumn("group", -(F.col("node") % 3) - 1)
    return graph.merged_edges(edges, groups).select("src", "dst", F.round("weight", 6).alias("weight"), "edges")


@query(f"WITH {_SQL_TREE} SELECT src, dst FROM e WHERE src NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) OR dst NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def dangling_edges(spark, sf_dir):
    live = _t(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("node"))
    return graph.dangling(_tree_edges(spark, sf_dir), live).select("src", "dst")


@query("""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 1) SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS shared FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o) AND l_partkey <> 1
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def related_items(spark, sf_dir):
    return graph.together(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("item")), 1)
