"""Source divergence audit by a baseline-correction inverted index.

How far two sources of a language are apart is a sum over all kept terms. It
starts at the number of terms times the difference that two counts of zero give,
the baseline. The index lists for every term only the sources that have it, and
emits what has to be added to the baseline for these: per source and other
source for its own terms (equal shares of a source are taken together), and per
term for two sources that both have it. So the work grows with the postings,
not with sources times sources times terms. Shares are integers, in billionths,
by long division in steps that fit 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import flat, kind_table, pieces, segments
from cairnlake.llm.common import saved, table

LEAST_DOCUMENTS = 30
#: Added to every count.
PRIOR = 5
TOP_TERMS = 50
LETTER = kind_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Letters in lower case, all else as blanks.
FOLDED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if LETTER[b] else 0x20 for b in range(256))
COUNTED = "lang string, source string, term string, occurrences long, documents long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each (lang, source), added up per
    piece of a batch, and a row without a term for each (lang, source)."""
    for batch in pieces(batches, "text", 8 << 20):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        data, at = flat(batch.column("text"))
        for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            occurrences, documents = found.setdefault(group, (Counter(), Counter()))
            text, seen = data[at[k] : at[k + 1]], set()
            for begin, end in segments(text, LETTER):
                terms = text[begin:end].tobytes().translate(FOLDED).split()
                occurrences.update(terms)
                seen.update(terms)
            documents.update(seen)
        names, terms, sums, counts = [], [], [], []
        for group, (occurrences, documents) in found.items():
            names += [group] * (len(occurrences) + 1)
            terms += [None, *occurrences]
            sums += [0, *occurrences.values()]
            counts += [0, *(documents[term] for term in occurrences)]
        lang, source = ([name[x] for name in names] for x in (0, 1))
        text = pa.array(terms, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), text, pa.array(sums, pa.int64()), pa.array(counts, pa.int64())],
            ["lang", "source", "term", "occurrences", "documents"],
        )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)): exact, since a remainder
    is below the divisor and thousand times it fits (up to 9e15 words)."""
    below = total + PRIOR * terms
    rest, out = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, below)
        rest = F.pmod(rest * 1000, below)
    return out + 1


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z as a-z; a
    language keeps those in at least ``least_documents`` of its rows, V of them.
    A source's share of a term is 1 + floor(1e9 * (count + 5) / (N + 5 * V)), N
    its count of kept terms; so is the language's. Part ``pair`` has for every
    source each other one of its language, by the summed differences of shares;
    part ``term`` the terms that a source has and whose share is above the
    language's, by the difference, ``top`` at most a source. Ties go by the item's
    UTF-8 bytes.

    Nulls count as empty strings in all three columns; texts without terms still
    make their (lang, source) one of the groups. A language without kept terms has
    pairs of value zero and no terms, a source alone in its language no pairs, an
    empty table no rows. Repeated rows count each. Other columns are not read.
    Long texts are cut into segments between terms.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = named.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
    counts = saved(counts.agg(F.sum("occurrences").alias("n"), F.sum("documents").alias("documents")), "divergence-counts")

    postings = counts.filter("term is not null").groupBy("lang", "term")
    postings = postings.agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("at"))
    postings = saved(postings.filter(F.col("documents") >= least_documents).drop("documents"), "divergence-postings")

    langs = postings.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    listed = postings.select("lang", "term", "n", F.explode("at").alias("x")).select("lang", "term", "n", F.col("x.source").alias("source"), F.col("x.n").alias("own"))
    sums = listed.groupBy("lang", "source").agg(F.sum("own").alias("own_total"))
    none = F.lit(0).cast("long")
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("terms", "total", "own_total")])
    zero = F.when(F.col("terms") > 0, share(none, F.col("own_total"), F.col("terms"))).otherwise(none)
    groups = saved(groups.withColumn("zero", zero), "divergence-groups")

    entries = listed.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", share(F.col("own"), F.col("own_total"), F.col("terms")).alias("p"),
        share(F.col("n"), F.col("total"), F.col("terms")).alias("q"),
    )
    entries = saved(entries, "divergence-entries")
    return _pairs(groups, entries).unionByName(_terms(entries, top))


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    first, second = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")

    # A source's own terms against the zero of each other; equal shares at once.
    levels = entries.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times"))
    alone = levels.join(other, "lang").filter("source <> other")
    gap = F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("other_zero"))
    alone = alone.select("lang", first, second, (gap * F.col("times")).alias("more")).filter("more <> 0")

    # Terms that both have: what the two sums above count twice or wrongly.
    mine = entries.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("z_a"))
    theirs = entries.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("z_b"))
    both = mine.join(theirs, ["lang", "term"]).filter("a < b")
    more = F.expr("abs(p_a - p_b) + abs(z_a - z_b) - abs(p_a - z_b) - abs(p_b - z_a)")
    both = both.select("lang", "a", "b", more.alias("more")).filter("more <> 0")

    # Each kind is added up for itself, on the side of the map tasks first.
    add = lambda df: df.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    corrections = add(add(alone).unionByName(add(both)))
    base = groups.join(other, "lang").filter("source < other")
    base = base.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("terms") * F.abs(F.col("zero") - F.col("other_zero"))).alias("base"))
    value = (F.col("base") + F.coalesce("more", F.lit(0))).alias("value")
    pairs = base.join(corrections, ["lang", "a", "b"], "left").select("lang", "a", "b", value)
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    rows = pairs.select("lang", F.explode(ends).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return rows.withColumn("rank", F.row_number().over(_ranked()))


def _ranked():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _terms(entries: DataFrame, top: int) -> DataFrame:
    """The limit on the rank is a literal, so that most rows go before the shuffle."""
    above = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(_ranked())).filter(F.col("rank") <= top)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_sql() -> str:
    p = lambda count, total, terms: f"(1 + (1000000000::HUGEINT * ({count} + {PRIOR})) // ({total} + {PRIOR} * {terms}))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{lower}') AS term FROM d),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM d),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {p('coalesce(c.c, 0)', 'coalesce(n.n, 0)', 'v.v')} AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT k.lang, k.term, {p('sum(c.c)', 'any_value(t.n)', 'any_value(v.v)')} AS q
  FROM kept k JOIN counts c USING (lang, term) JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) t USING (lang) GROUP BY k.lang, k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs)
UNION ALL
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= {TOP_TERMS}
"""
