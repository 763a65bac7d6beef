"""Substring dedup by hashing of lines and paragraphs.

Units are normalised (A-Z lower-cased, runs of ASCII space squeezed) and
digested inside tasks; digests are grouped over the whole corpus with map-side
combining, the earliest ranked occurrence of each stays, and the others are
removed. Offsets refer to the text as it was given, in code points.

Few texts set their paragraphs apart, and passages are pasted into the middle
of lines. So a paragraph here is what reads as one: it begins with any sentence
and takes in whole sentences until it has enough words.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import pieces
from cairnlake.llm.common import salted_join, saved, table, unused

#: Words that a unit of the query has at least: half of a passage of fifty words,
#: so that one which begins and ends inside sentences holds a whole unit still.
LEAST_WORDS = 25
#: A sentence ends with the line, or with blanks behind one of these marks.
SENTENCE_END = r"\n|[.!?][\x20\x09\x0B-\x0D]+"
LINE_END = r"\n"
BLANK_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"
UNITS = pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32())]))
UNITS_SQL = "array<struct<digest:binary,start:int,end:int>>"
NO_SPANS = "array<struct<start:int,end:int>>"
KINDS = ("line", "block", "paragraph")


#: Every ASCII space character as a blank.
BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def squeezed(data: bytes) -> bytes:
    """Runs of ASCII space as one blank, none outside; no list of words is made."""
    data = data.translate(BLANKS)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


class _Units:
    """Digests and spans of the units of each text."""

    def __init__(self, kinds: tuple[str, ...], least_words: int) -> None:
        if unknown := set(kinds) - set(KINDS):
            raise ValueError(f"no such unit: {sorted(unknown)}")
        self.kinds, self.least_words = kinds, least_words

    @staticmethod
    def parts(text: str, ends: str) -> list[tuple[int, int, bytes, int]]:
        """(start, end, normalised text, number of words) of the parts that have words."""
        out, at = [], 0
        for stop in [*(m.end() for m in re.finditer(ends, text)), len(text)]:
            part = text[at:stop]
            if bare := squeezed(part.encode().lower()):
                out.append((at, at + len(part.rstrip(" \t\n\x0b\x0c\r")), bare, bare.count(b" ") + 1))
            at = stop
        return out

    def of(self, text: str) -> list[dict]:
        spans: dict[tuple[int, int], bytes] = {}
        for kind, ends in (("line", LINE_END), ("block", BLANK_LINE)):
            if kind in self.kinds:
                spans |= {(a, b): self.digest(bare) for a, b, bare, n in self.parts(text, ends) if n >= self.least_words}
        if "paragraph" in self.kinds:
            sentences = self.parts(text, SENTENCE_END)
            total = [0, *accumulate(n for *_, n in sentences)]
            for k, (start, _, bare, _) in enumerate(sentences):
                last = bisect_left(total, total[k] + self.least_words)
                if last < len(total):
                    whole = b" ".join(x[2] for x in sentences[k:last]) if last > k + 1 else bare
                    spans[start, sentences[last - 1][1]] = self.digest(whole)
        return [{"digest": d, "start": a, "end": b} for (a, b), d in spans.items()]

    @staticmethod
    def digest(bare: bytes) -> bytes:
        return hashlib.blake2b(bare, digest_size=16).digest()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            units = [self.of(text or "") for text in batch.column(3).to_pylist()]
            counts = pa.array([len(x) for x in units], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(units, UNITS)], ["row", "doc_id", "th", "n_units", "units"])


def _repeated(docs: DataFrame, kinds: tuple[str, ...], least_words: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_units) of ``docs`` (row, doc_id, text), where ``row`` tells rows
    apart, and (_row, removed) of the rows that lose something."""
    rows = docs.select("row", "doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, th long, n_units long, units {UNITS_SQL}"
    listed = saved(rows.mapInArrow(_Units(kinds, least_words), schema), "units")
    total = listed.agg(F.sum("n_units")).first()[0] or 0

    # Most units occur once: these go before anything is ranked.
    key, spread = F.xxhash64("digest").alias("key"), F.xxhash64("row", "start")
    twice = listed.select(F.explode("units.digest").alias("digest")).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    each = listed.select("row", "doc_id", "th", F.inline("units")).withColumn("key", key)
    each = saved(salted_join(each, twice, "key", "n", total, spread).drop("key"), "units-repeated")

    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "th", "row", "end")
    firsts = each.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("digest", "n", F.col("first.row").alias("_row"), F.col("first.start").alias("_start"), F.col("first.end").alias("_end"))
    met = salted_join(each.select("digest", "row", "start", "end"), firsts, "digest", "n", each.count(), spread)
    again = met.filter((F.col("row") != F.col("_row")) | (F.col("start") != F.col("_start")))
    # What overlaps its own first occurrence leaves that one whole.
    begin = F.when(F.col("row") == F.col("_row"), F.greatest("start", "_end")).otherwise(F.col("start"))
    again = again.select("row", begin.alias("start"), "end").filter("start < end")
    spans = again.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return listed.select("row", "doc_id", "n_units"), spans.mapInArrow(_merged, f"_row long, removed {NO_SPANS}")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each row by start, with those that touch or overlap made one."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            merged: list[dict] = []
            for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
                if merged and x["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(x)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["_row", "removed"])


def repeated_units(docs: DataFrame, kinds: tuple[str, ...] = ("line", "paragraph"), least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_units, removed (spans
    that repeated units cover, merged, by start).

    ``kinds`` of units: ``line``; ``block``, lines up to a blank one; and
    ``paragraph``, which begins with any sentence and takes in whole sentences
    until it has ``least_words``, so paragraphs overlap and cross line ends. Units
    of fewer than ``least_words`` words don't count (1: all that have a word).

    A unit is removed unless it is the first of its digest by (doc_id, start);
    rows without a doc_id rank last, and ties go by a hash of the text. A repeat
    that overlaps the first occurrence goes from the end of that one on. Null and
    empty texts have no units. Every row has its own units, also where rows share
    a doc_id or have none; of equal rows one keeps what is first there and the
    others lose all their units. An empty table gives no rows; other columns are
    not read. A text of any length is one row of one task, with about ten bytes
    a byte in memory.
    """
    rows, spans = _repeated(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), kinds, least_words)
    out = rows.join(spans, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", "n_units", F.coalesce("removed", F.array().cast(NO_SPANS)).alias("removed"))


def without_repeated_units(docs: DataFrame, kinds: tuple[str, ...] = ("line", "paragraph"), least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``, and ``removed``
    (named otherwise if taken) with their offsets in the text before. Every row
    is cut at its own offsets."""
    name, key = unused(docs, "removed"), unused(docs, "_cut_row")
    # Written once, so that the numbers of the rows hold for both readers.
    docs = saved(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    _, spans = _repeated(docs.select(F.col(key).alias("row"), "doc_id", "text"), kinds, least_words)
    spans = spans.select(F.col("_row").alias(key), F.col("removed").alias(name))
    out = docs.join(spans, key, "left").drop(key)
    ends = F.transform(F.col(name), lambda x: x["end"])
    begins = F.concat(F.transform(F.col(name), lambda x: x["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), ends), begins, lambda a, b: F.substr(F.col("text"), a + 1, b - a)), "")
    return out.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_units(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("removed_spans"))


def op7_sql() -> str:
    """The same spans: every unit's text is cut out and compared as a whole."""
    space = r"[\x20\x09-\x0D]+"
    norm = lambda x: f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}', ' ', 'g'))"
    counted = lambda x: f"length({x}) - length(replace({x}, ' ', '')) + 1"
    parts = lambda source, ends: f"""(SELECT doc_id, text, k, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
    FROM (SELECT doc_id, text, generate_subscripts(p, 1) AS k, unnest(p) AS part FROM (SELECT doc_id, text, string_split(regexp_replace(text, '({ends})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source})))"""  # noqa: E731
    worded = lambda source: f"""SELECT doc_id, text, k, a, a + length(regexp_replace(part, '{space}$', '')) AS b, {counted('u')} AS w, u FROM (SELECT *, {norm('part')} AS u FROM {source}) WHERE u <> ''"""
    return f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS c FROM ({worded(parts('d', SENTENCE_END))})),
lines AS ({worded(parts('d', LINE_END))}),
units AS (SELECT doc_id, a, b, {norm('substr(text, a + 1, b - a)')} AS u FROM (
      SELECT s.doc_id, s.text, s.a, e.b FROM (SELECT *, c - w + {LEAST_WORDS} AS least FROM sentences) s ASOF JOIN sentences e ON s.doc_id = e.doc_id AND s.least <= e.c
      UNION SELECT doc_id, text, a, b FROM lines WHERE w >= {LEAST_WORDS})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id, a) AS r, first_value(doc_id) OVER (PARTITION BY u ORDER BY doc_id, a) AS d1, first_value(b) OVER (PARTITION BY u ORDER BY doc_id, a) AS b1 FROM units),
cut AS (SELECT doc_id, CASE WHEN doc_id = d1 THEN greatest(a, b1) ELSE a END AS a, b FROM ranked WHERE r > 1 AND b > CASE WHEN doc_id = d1 THEN greatest(a, b1) ELSE a END),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cut),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM grouped GROUP BY doc_id, g),
per AS (SELECT doc_id, count(*) AS n_removed, sum(b - a) AS removed_chars, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans FROM spans GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN n USING (doc_id)
"""
