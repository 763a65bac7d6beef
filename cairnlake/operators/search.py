"""Lexical search, fusion with vector scores, chunks, snippets and duplicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.text import STOP_WORDS, content_hash, tokens


def term_scores(df: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits, score) of rows that hold all terms: r/(1+r) of hits per square root of length."""
    found = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    count_of = lambda term: F.size(F.filter("w", lambda x: x == F.lit(term)))
    counts = [count_of(t) for t in terms]
    out = found.select("id", F.size("w").alias("n"), F.array(*counts).alias("c")).filter(F.forall("c", lambda x: x > 0))
    hits = F.aggregate("c", F.lit(0), lambda s, x: s + x)
    raw = hits / F.sqrt(F.col("n").cast("double"))
    return out.select("id", hits.alias("hits"), (raw / (1 + raw)).alias("score"))


def fused(by_vector: DataFrame, by_text: DataFrame, vector_weight: float = 0.6, text_weight: float = 0.4) -> DataFrame:
    """Full outer fusion of (id, score) tables; what only words found scores at least 0.35."""
    v, t = by_vector.select("id", F.col("score").alias("v")), by_text.select("id", F.col("score").alias("t"))
    both = v.join(t, "id", "full")
    score = F.when(F.col("v").isNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.35), F.col("t") + text_weight))).otherwise(vector_weight * F.col("v") + text_weight * F.coalesce("t", F.lit(0.0)))
    source = F.when(F.col("v").isNull(), "fts").when(F.col("t").isNull(), "vector").otherwise("hybrid")
    return both.select("id", score.alias("score"), source.alias("source"))


def chunks(df: DataFrame, size: int = 1800, overlap: int = 120, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of ``size`` characters that overlap, with offsets, hash and token estimate,
    and the columns ``keep`` of their rows."""
    step = max(size - min(overlap, size // 2), 1)
    some = df.select(id_col, text_col, *keep).filter(F.length(text_col) > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(step))
    out = some.select(id_col, text_col, *keep, F.posexplode(starts).alias("chunk_index", "char_start"))
    part = F.substr(F.col(text_col), F.col("char_start") + 1, F.lit(size))
    return out.select(
        id_col, *keep, "chunk_index", "char_start", F.least(F.col("char_start") + size, F.length(text_col)).alias("char_end"),
        F.sha2(part, 256).alias("content_hash"), F.greatest(F.lit(1), F.expr(f"length(substr({text_col}, char_start + 1, {size})) div 4")).cast("int").alias("token_count"), part.alias("content"),
    )


def snippets(df: DataFrame, term: str, around: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The text round the first place where the term stands, letter case aside."""
    at = F.instr(F.lower(text_col), F.lit(term.lower()))
    return df.select(F.col(id_col).alias("id"), at.alias("at"), F.col(text_col).alias("t")).filter("at > 0").select("id", "at", F.substr("t", F.greatest(F.col("at") - around, F.lit(1)), F.lit(2 * around + len(term))).alias("snippet"))


def equal_content(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, copies, first_id) of texts that occur more than once once normalised."""
    hashed = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


@dataclass(frozen=True)
class WebQuery:
    """What a search box asks for: any of the groups, each with all of its phrases
    (a word is a phrase of one), and none of the others."""

    groups: tuple[tuple[tuple[str, ...], ...], ...]
    none: tuple[tuple[str, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({w for group in self.groups for phrase in group for w in phrase})


def web_query(asked: str) -> WebQuery:
    """Words and "phrases" all count, ``or`` between two starts another group, a
    minus before one excludes it; stop words and marks are left out."""
    groups: list[list[tuple[str, ...]]] = [[]]
    none: list[tuple[str, ...]] = []
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', asked or ""):
        if bare.lower() == "or" and not minus:
            groups.append([])
            continue
        words = tuple(w for w in re.findall(r"[a-z0-9]+", (quoted or bare).lower()) if w not in STOP_WORDS)
        if words:
            (none if minus else groups[-1]).append(words)
    return WebQuery(tuple(tuple(g) for g in groups if g), tuple(none))


def matches(query: WebQuery, text: Column) -> Column:
    """Whether a text is what the query asks for; nothing is, if it has no words left."""
    said = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    holds = lambda phrase: F.contains(said, F.lit(f" {' '.join(phrase)} "))
    wanted = reduce(or_, [reduce(and_, map(holds, group)) for group in query.groups], F.lit(False))
    return reduce(and_, [~holds(phrase) for phrase in query.none], wanted)


def cover_ranks(df: DataFrame, query: WebQuery, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, covers, score) of the matching rows, by cover density.

    A cover is a shortest stretch that holds all words of a group; it adds 0.1 by
    the number of other words in it plus one, and the sum r counts as r/(r+1). Only
    the places of the query's words are listed, by row, and windows over these
    find for each place the latest start of a stretch that ends there.
    """
    if not query.groups:
        return df.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("score")).limit(0)
    some = df.filter(matches(query, F.col(text_col))).select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)")).alias("w"))
    hits = some.select("id", F.posexplode("w").alias("pos", "term")).filter(F.col("term").isin(query.terms))
    so_far = W.partitionBy("id").orderBy("pos")
    hits = hits.withColumn("_n", F.row_number().over(so_far))
    for k, term in enumerate(query.terms):
        of = F.when(F.col("term") == term, F.struct("pos", F.col("_n").alias("n")))
        hits = hits.withColumn(f"_t{k}", F.max(of).over(so_far.rowsBetween(W.unboundedPreceding, 0)))
    last = {term: F.col(f"_t{k}") for k, term in enumerate(query.terms)}
    starts = []
    for group in query.groups:
        ends = [last[w] for phrase in group for w in phrase]
        whole = reduce(and_, [e.isNotNull() for e in ends])
        starts.append(F.when(whole, F.array_min(F.array(*ends))))
    hits = hits.withColumn("_from", F.array_max(F.array(*starts)))
    fresh = F.coalesce(F.col("_from")["pos"] > F.lag(F.col("_from")["pos"]).over(so_far), F.lit(True))
    cover = hits.filter("_from is not null").withColumn("_fresh", fresh).filter("_fresh")
    noise = (F.col("pos") - F.col("_from")["pos"]) - (F.col("_n") - F.col("_from")["n"])
    r = cover.groupBy("id").agg(F.count("*").alias("covers"), F.sum(0.1 / (1 + noise)).alias("r"))
    return r.select("id", "covers", (F.col("r") / (F.col("r") + 1)).alias("score"))
