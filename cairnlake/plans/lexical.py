"""Queries on the stored word index."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.stems import ENGLISH_STOP, EXCEPTIONS, FOURTH, REGION, SECOND, SETTLED, SHORT, THIRD, with_stems
from cairnlake.operators import chunk_search, postings, search
from cairnlake.plans.base import query, table, vector
from cairnlake.shared import kept, saved


def documents_index(spark, sf_dir, stemmed: bool = False) -> postings.Index:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return kept(spark, ("documents", sf_dir, str(stemmed)), lambda: postings.build(docs, stemmed))


def parts_of(spark, sf_dir, *keep):
    """(id, part, text) and the columns ``keep``: documents in chunks."""
    return search.chunks(table(spark, sf_dir, "documents"), keep=keep).select(F.col("doc_id").alias("id"), F.col("chunk_index").alias("part"), F.col("content").alias("text"), *keep)


def parts_index(spark, sf_dir, stemmed: bool = False) -> postings.Index:
    keyed = parts_of(spark, sf_dir).select(F.struct("id", "part").alias("id"), "text")
    return kept(spark, ("parts", sf_dir, str(stemmed)), lambda: postings.build(keyed, stemmed))


def _case(suffix: str, rules: dict[str, str]) -> str:
    return f"CASE {suffix} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " ELSE '' END"


def sql_stems(source: str) -> str:
    """CTEs that end in ``stems`` (word, stem) for the distinct ``word`` of ``source``."""
    end = lambda rules: f"regexp_extract(w, '^(.*?)({'|'.join(rules)})$', 2)"
    cut = "left(w, length(w) - length(s))"
    listed = ", ".join(f"'{x}'" for x in SETTLED)
    return f"""v AS (SELECT DISTINCT word FROM {source}),
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM v WHERE regexp_full_match(word, '[a-z]{{3,}}')),
s1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
  WHEN regexp_matches(w, '{REGION}') THEN length(regexp_extract(w, '{REGION}')) ELSE length(w) END AS r1 FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{REGION}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION}')) ELSE length(w) END AS r2 FROM s1),
a1 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - 3) || CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END
  WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w) FROM s2),
b0 AS (SELECT *, {end(('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))} AS s FROM a1), b1 AS (SELECT *, {cut} AS b FROM b0),
b2 AS (SELECT word, r1, r2, CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
  WHEN s <> '' AND regexp_matches(b, '[aeiouy]') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1)
    WHEN regexp_matches(b, '{SHORT}') AND r1 >= length(b) THEN b || 'e' ELSE b END ELSE w END AS w FROM b1),
c1 AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM b2),
d0 AS (SELECT *, {end(SECOND)} AS s FROM c1), d1 AS (SELECT *, {cut} AS b FROM d0),
d2 AS (SELECT word, r1, r2, CASE WHEN s <> '' AND length(b) >= r1 AND (s <> 'ogi' OR b LIKE '%l') AND (s <> 'li' OR regexp_matches(b, '[cdeghkmnrt]$')) THEN b || {_case('s', SECOND)} ELSE w END AS w FROM d1),
e0 AS (SELECT *, {end(THIRD)} AS s FROM d2), e1 AS (SELECT *, {cut} AS b FROM e0),
e2 AS (SELECT word, r1, r2, CASE WHEN s <> '' AND length(b) >= r1 AND (s <> 'ative' OR length(b) >= r2) THEN b || {_case('s', THIRD)} ELSE w END AS w FROM e1),
f0 AS (SELECT *, {end(FOURTH)} AS s FROM e2), f1 AS (SELECT *, {cut} AS b FROM f0),
f2 AS (SELECT word, r1, r2, CASE WHEN s <> '' AND length(b) >= r2 AND (s <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END AS w FROM f1),
g1 AS (SELECT *, regexp_replace(w, '[el]$', '') AS b FROM f2),
g2 AS (SELECT word, replace(CASE WHEN (w LIKE '%e' AND (length(b) >= r2 OR (length(b) >= r1 AND NOT regexp_matches(b, '{SHORT}')))) OR (w LIKE '%ll' AND length(b) >= r2) THEN b ELSE w END, 'Y', 'y') AS w FROM g1),
stems AS (SELECT v.word, CASE v.word {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())}
  ELSE CASE WHEN v.word IN ({listed}) THEN v.word WHEN right(v.word, 1) = 's' AND left(v.word, length(v.word) - 1) IN ({listed}) THEN left(v.word, length(v.word) - 1) ELSE coalesce(g2.w, v.word) END END AS stem FROM v LEFT JOIN g2 USING (word))"""


_SQL_WORDS = "words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS word FROM documents)"


@query(f"WITH {_SQL_WORDS}, {sql_stems('words')} SELECT word, stem FROM stems")
def vocabulary_stems(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)")))
    return with_stems(table(spark, sf_dir, "documents").select(words.alias("raw")).select(F.lower("raw").alias("word")).distinct())


#: A search in English as it is typed: stems, a phrase, two groups and an exclusion.
ASKED = 'the licensed works OR "er things" OR oning thly -thble'
_TERMS = ("licens", "work", "er", "thing", "one", "thli")
_SQL_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP)
_SQL_FOUND = f"""tok AS (SELECT id, unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) AS raw, generate_subscripts(regexp_extract_all(t, '[A-Za-z0-9]+'), 1) - 1 AS pos FROM src),
low AS (SELECT id, lower(raw) AS word, pos FROM tok), {sql_stems('low')},
st AS (SELECT id, pos, stem, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM low JOIN stems USING (word) WHERE word NOT IN ({_SQL_STOP})),
said AS (SELECT id, ' ' || string_agg(stem, ' ' ORDER BY k) || ' ' AS s FROM st GROUP BY id),
good AS (SELECT id FROM said WHERE ((s LIKE '% licens %' AND s LIKE '% work %') OR s LIKE '% er thing %' OR (s LIKE '% one %' AND s LIKE '% thli %')) AND s NOT LIKE '% thble %'),
h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM st SEMI JOIN good USING (id) WHERE stem IN {_TERMS}),
l AS (SELECT *, {', '.join(f"max(CASE WHEN stem = '{t}' THEN pos END) OVER a AS {t}" for t in _TERMS)} FROM h WINDOW a AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, greatest({', '.join(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END" for a, b in zip(_TERMS[::2], _TERMS[1::2], strict=True))}) AS low FROM l),
c0 AS (SELECT f.*, lag(low) OVER (PARTITION BY id ORDER BY pos) AS before FROM f),
c AS (SELECT c0.id, c0.low AS first, c0.pos AS last, c0.n - s.n + 1 AS hits, c0.pos - c0.low - (c0.n - s.n) AS noise FROM c0 JOIN h s ON s.id = c0.id AND s.pos = c0.low WHERE c0.low IS NOT NULL AND (before IS NULL OR c0.low > before))"""


@query(f"WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_SQL_FOUND}, r AS (SELECT id, count(*) AS covers, sum(0.1 / (1 + noise)) AS r FROM c GROUP BY id) SELECT id, covers, round(r / (r + 1), 6) AS score FROM r")
def stemmed_search(spark, sf_dir):
    return postings.cover_ranks(documents_index(spark, sf_dir, True), search.web_query(ASKED)).withColumn("score", F.round("score", 6))


_SQL_SHOWN = """pc AS (SELECT id, regexp_extract_all(t, '[^A-Za-z0-9]*[A-Za-z0-9]+') AS p FROM src),
fr AS (SELECT id, hits, noise, CASE WHEN least(last - first + 1, 45) = 45 THEN first ELSE greatest(first - (45 - (last - first + 1)) // 2, 0) END AS a, len(p) AS n FROM c JOIN pc USING (id)),
rk AS (SELECT *, least(a + 45, n) AS b, row_number() OVER (PARTITION BY id ORDER BY hits DESC, noise, a, least(a + 45, n)) AS r FROM fr),
o1 AS (SELECT * FROM rk WHERE r = 1), o2 AS (SELECT k.* FROM rk k JOIN o1 USING (id) WHERE k.b <= o1.a OR k.a >= o1.b QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY k.r) = 1),
sh AS (SELECT id, a, regexp_replace(array_to_string(list_slice(p, a + 1, b), ''), '^[^A-Za-z0-9]+', '') AS t FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) JOIN pc USING (id))"""


@query(f"""WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_SQL_FOUND}, r AS (SELECT id, sum(0.1 / (1 + noise)) AS r FROM c GROUP BY id), top AS (SELECT id, r FROM r ORDER BY round(r / (r + 1), 9) DESC, id LIMIT 20), {_SQL_SHOWN}
SELECT id, string_agg(t, ' ... ' ORDER BY a) AS headline, count(*)::INTEGER AS fragments, any_value(round(r / (r + 1), 6)) AS score FROM sh JOIN top USING (id) GROUP BY id""")
def headlines(spark, sf_dir):
    index, asked = documents_index(spark, sf_dir, True), search.web_query(ASKED)
    top = postings.cover_ranks(index, asked).withColumn("_s", F.round("score", 9)).orderBy(F.desc("_s"), "id").limit(20).select("id", F.round("score", 6).alias("score"))
    top = saved(top, "headline-hits")
    texts = saved(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(top), "id"), "headline-texts")
    return postings.fragments(index, asked, texts).join(top, "id")


_NOW = "TIMESTAMP '2024-01-31'"
_SQL_CHUNKS = f"""pt AS (SELECT doc_id AS doc, i AS part, substr(text, i * 1680 + 1, 1800) AS t, source FROM documents, LATERAL (SELECT unnest(range(0, (greatest(length(text) - 1, 0) // 1680) + 1)) AS i) WHERE length(text) > 0),
cx AS (SELECT doc * 100000 + part AS id, doc, part, t, CASE WHEN doc % 17 = 3 THEN 'archived' ELSE 'active' END AS status, '/Home/' || source || '/f' || doc || '.txt' AS path, CASE WHEN doc % 3 = 0 THEN 'email' ELSE 'file' END AS source_type,
  CASE WHEN part % 2 = 0 THEN 'page' ELSE 'sheet' END AS locator_kind, part + 1 AS first_page, part + 2 AS last_page, {_NOW} - to_days((doc % 100)::INTEGER) AS created_at, {_NOW} - to_days((doc % 45)::INTEGER) AS updated_at,
  (doc % 10) / 10.0 AS trust, (doc + part) % 9 = 0 AS desk, CASE WHEN doc % 8 = 5 THEN 'private' END AS sensitivity, (doc * 7 + part) % 500 AS vec FROM pt),
lx AS (SELECT * FROM cx WHERE status = 'active' AND contains(lower(path), 'src1') AND last_page >= 1 AND first_page <= 6 AND created_at >= {_NOW} - INTERVAL 90 DAY AND created_at < {_NOW} AND coalesce(sensitivity, '') <> 'private')"""


def _chunks(spark, sf_dir):
    now, doc, part = F.lit("2024-01-31").cast("timestamp"), F.col("id"), F.col("part")
    days = lambda n: now - F.make_dt_interval((doc % n).cast("int"))
    rows = parts_of(spark, sf_dir, "source").select(
        F.struct("id", "part").alias("id"), doc.alias("doc"), part.alias("chunk_index"), "text", F.when(doc % 17 == 3, "archived").otherwise("active").alias("status"),
        F.concat(F.lit("/Home/"), "source", F.lit("/f"), doc.cast("string"), F.lit(".txt")).alias("path"), F.when(doc % 3 == 0, "email").otherwise("file").alias("source_type"),
        F.when(part % 2 == 0, "page").otherwise("sheet").alias("locator_kind"), F.lit(None).cast("string").alias("sheet"), (part + 1).alias("first_page"), (part + 2).alias("last_page"),
        days(100).alias("created_at"), days(45).alias("updated_at"), (doc % 10 / 10.0).alias("trust"), ((doc + part) % 9 == 0).alias("desk"), F.when(doc % 8 == 5, "private").alias("sensitivity"), ((doc * 7 + part) % 500).alias("vec_id"),
    )
    wanted = chunk_search.Wanted(path="SRC1", source_type=" ", first_page=1, last_page=6, after=now - F.make_dt_interval(F.lit(90)), before=now, show_private=False)
    # The 500 vectors that chunks refer to.
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").between(0, 499)).select("vec_id", "embedding")
    return rows.join(F.broadcast(vectors), "vec_id", "left").drop("vec_id"), wanted, now


_SQL_RANKED = f"""vh AS (SELECT lx.id, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS v FROM lx JOIN embeddings e ON e.vec_id = lx.vec ORDER BY v DESC, lx.id LIMIT 20),
rw AS (SELECT id, sum(0.1 / (1 + noise)) AS r FROM c GROUP BY id), lh AS (SELECT id, r / (r + 1) AS raw FROM rw SEMI JOIN lx USING (id) ORDER BY raw DESC, id LIMIT 20), ln AS (SELECT id, raw / (SELECT max(raw) FROM lh) AS l FROM lh),
mg AS (SELECT coalesce(vh.id, ln.id) AS id, v, l FROM vh FULL JOIN ln ON vh.id = ln.id),
sc AS (SELECT lx.*, v, l, exp(-greatest((epoch_us({_NOW}) - epoch_us(updated_at)) / 86400000000.0, 0.0) * ln(2) / 30.0) AS rec FROM mg JOIN lx USING (id)),
rk0 AS (SELECT *, 0.6 * coalesce(v, 0) + 0.4 * coalesce(l, 0) + 0.1 * rec + 0.1 * trust + CASE WHEN desk THEN 0.05 ELSE 0 END AS rank FROM sc ORDER BY rank DESC, updated_at DESC, doc, part LIMIT 10 OFFSET 2)"""


@query(f"""WITH {_SQL_CHUNKS}, src AS (SELECT id, t FROM cx), {_SQL_FOUND}, {_SQL_RANKED}, {_SQL_SHOWN}, hl AS (SELECT id, string_agg(t, ' ... ' ORDER BY a) AS h FROM sh GROUP BY id)
SELECT doc, part::INTEGER AS chunk_index, round(rank, 6) AS rank, round(v, 6) AS vector, round(l, 6) AS lexical, round(rec, 6) AS recency, left(coalesce(CASE WHEN l IS NOT NULL THEN h END, t), 600) AS snippet, false AS degraded FROM rk0 LEFT JOIN hl USING (id)""")
def filtered_chunk_search(spark, sf_dir):
    rows, wanted, now = _chunks(spark, sf_dir)
    out = chunk_search.found_chunks(rows, parts_index(spark, sf_dir, True), search.web_query(ASKED), vector(spark, sf_dir), now, 10, 2, wanted)
    six = [F.round(c, 6).alias(c) for c in ("rank", "vector", "lexical", "recency")]
    return out.select(F.col("id.id").alias("doc"), F.col("id.part").alias("chunk_index"), *six, "snippet", "degraded")


@query(f"""WITH {_SQL_CHUNKS} SELECT doc, part::INTEGER AS chunk_index, left(t, 600) AS snippet FROM lx ORDER BY updated_at DESC, doc, part LIMIT 10 OFFSET 5""")
def browsed_chunks(spark, sf_dir):
    rows, wanted, now = _chunks(spark, sf_dir)
    out = chunk_search.found_chunks(rows, None, None, None, now, 10, 5, wanted)
    return out.select(F.col("id.id").alias("doc"), F.col("id.part").alias("chunk_index"), "snippet")


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name, ['@' || c_custkey, 'c' || c_nationkey || '7'] AS handles, CASE WHEN c_custkey % 5 = 0 THEN 'met ' || c_mktsegment || ' C117 folk' END AS notes, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 37 % 1000 END AS last_seen FROM customer),
h AS (SELECT *, CASE WHEN lower(name) = 'c117' THEN 1 WHEN list_contains(list_transform(handles, lambda x: lower(x)), 'c117') THEN 2 WHEN contains(lower(name), 'c117') THEN 3 WHEN contains(lower(coalesce(notes, '')), 'c117') THEN 4 END AS how FROM c)
SELECT id, name, ['name', 'handle', 'part', 'notes'][how] AS how FROM h WHERE how IS NOT NULL ORDER BY h.how, last_seen DESC NULLS LAST, id LIMIT 100 OFFSET 3""")
def contact_search(spark, sf_dir):
    i = F.col("c_custkey")
    handles = F.array(F.concat(F.lit("@"), i.cast("string")), F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("7")))
    notes = F.when(i % 5 == 0, F.concat(F.lit("met "), "c_mktsegment", F.lit(" C117 folk")))
    contacts = table(spark, sf_dir, "customer").select(i.alias("id"), F.col("c_name").alias("name"), handles.alias("handles"), notes.alias("notes"), F.when(i % 3 > 0, i * 37 % 1000).alias("last_seen"))
    return chunk_search.found_people(contacts, " C117 ", 100, 3)


@query(f"""WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_SQL_FOUND}, r AS (SELECT id, sum(0.1 / (1 + noise)) AS r FROM c GROUP BY id)
SELECT id, round(r / (r + 1), 6) AS score FROM r JOIN documents d ON d.doc_id = r.id WHERE source IN ('src0', 'src1', 'src2') AND doc_id % 60 >= 10 ORDER BY round(r / (r + 1), 9) DESC, doc_id % 60 DESC, id LIMIT 15""")
def journal_search(spark, sf_dir):
    i = F.col("doc_id")
    journal = table(spark, sf_dir, "documents").select(i.alias("id"), "text", F.col("source").alias("kind"), (i % 60).alias("at"))
    out = chunk_search.found_entries(journal, documents_index(spark, sf_dir, True), search.web_query(ASKED), 15, ["src0", "src1", "src2"], F.lit(10))
    return out.select("id", F.round("score", 6).alias("score"))
