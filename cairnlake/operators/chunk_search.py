"""Search in chunks of documents: filters, two ways of finding, or browsing without a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.scoring import age_in_days
from cairnlake.operators import postings
from cairnlake.operators.search import WebQuery
from cairnlake.operators.vectors import cosine
from cairnlake.shared import saved

#: Weights of nearness, words, recency, trust and being on the desk.
WEIGHTS = {"vector": 0.6, "lexical": 0.4, "recency": 0.1, "trust": 0.1, "desk": 0.05}


@dataclass(frozen=True)
class Wanted:
    """What chunks must be; what is not given doesn't matter. ``path`` may be a part of
    the path in any case; pages overlap; ``after`` is inclusive, ``before`` is not."""

    path: str | None = None
    source_type: str | None = None
    locator_kind: str | None = None
    sheet: str | None = None
    first_page: int | None = None
    last_page: int | None = None
    after: Column | None = None
    before: Column | None = None
    show_private: bool = True

    def of(self, chunks: DataFrame) -> DataFrame:
        given = lambda x: x is not None and x.strip() != ""
        live = chunks.filter("status = 'active'")
        if given(self.path):
            live = live.filter(F.contains(F.lower("path"), F.lit(self.path.lower())))
        for column, value in (("source_type", self.source_type), ("locator_kind", self.locator_kind), ("sheet", self.sheet)):
            live = live.filter(F.col(column) == value) if given(value) else live
        if self.first_page is not None:
            live = live.filter(F.col("last_page") >= self.first_page)
        if self.last_page is not None:
            live = live.filter(F.col("first_page") <= self.last_page)
        live = live if self.after is None else live.filter(F.col("created_at") >= self.after)
        live = live if self.before is None else live.filter(F.col("created_at") < self.before)
        return live if self.show_private else live.filter(F.coalesce("sensitivity", F.lit("")) != "private")


def found_chunks(
    chunks: DataFrame, index: postings.Index | None, query: WebQuery | None, vector: list[float] | None, as_of: Column, k: int = 10, offset: int = 0, wanted: Wanted | None = None,
    half_life: float = 30.0, snippet_chars: int = 600, weights: dict[str, float] | None = None,
) -> DataFrame:
    """(id, rank, vector, lexical, recency, snippet, degraded): a page of chunks.

    ``chunks`` are (id, doc, chunk_index, text, embedding, status, path, source_type,
    locator_kind, sheet, first_page, last_page, created_at, updated_at, trust, desk,
    sensitivity), and ``index`` has their words; browsing needs none. The 2k nearest and the 2k best by words
    are joined; the score by words is divided by the greatest of these. ``degraded`` is
    true where a query has no vector, so that words alone decide. Without query and
    vector, chunks come by the last change of their document.

    Filters reach the scan of the chunks, words that of the index; what is joined to
    whole rows is at most 4k ids.
    """
    weights = WEIGHTS if weights is None else weights
    live = (wanted or Wanted()).of(chunks)
    asked = query is not None and bool(query.groups)
    none = F.lit(None).cast("double")
    latest = [F.desc("updated_at"), F.col("doc"), F.col("chunk_index")]
    if not asked and vector is None:
        ids = live.orderBy(*latest).limit(2 * k + offset).select("id", none.alias("vector"), none.alias("lexical"))
    else:
        near = live.select("id", (cosine(F.col("embedding"), vector) if vector is not None else none).alias("vector")).filter("vector is not null")
        near = near.orderBy(F.desc("vector"), "id").limit(2 * k)
        if asked:
            words = postings.cover_ranks(index, query).select("id", F.col("score").alias("raw")).join(live.select("id"), "id", "left_semi")
            words = words.orderBy(F.desc("raw"), "id").limit(2 * k)
            words = words.select("id", (F.col("raw") / F.nullif(F.max("raw").over(W.partitionBy()), F.lit(0.0))).alias("lexical"))
        else:
            words = live.limit(0).select("id", none.alias("lexical"))
        ids = near.join(words, "id", "full")
    ids = saved(ids, "chunk-hits")
    rows = live.drop("embedding").join(F.broadcast(ids), "id")
    recency = F.exp(-F.greatest(age_in_days(F.col("updated_at"), as_of), F.lit(0.0)) * F.log(F.lit(2.0)) / half_life)
    parts = {
        "vector": F.coalesce("vector", F.lit(0.0)), "lexical": F.coalesce("lexical", F.lit(0.0)), "recency": recency, "trust": F.col("trust"),
        "desk": F.when(F.col("desk"), 1.0).otherwise(0.0),
    }
    browsing = not asked and vector is None
    rank = F.lit(0.0) if browsing else sum((weights[name] * x for name, x in parts.items()), F.lit(0.0))
    page = rows.withColumns({"rank": rank, "recency": recency}).orderBy(F.desc("rank"), *latest).offset(offset).limit(k)
    page = saved(page, "chunk-page")
    plain = F.left("text", F.lit(snippet_chars))
    out = page.withColumn("degraded", F.lit(asked and vector is None))
    if asked:
        shown = postings.fragments(index, query, page.filter("lexical is not null").select("id", "text")).select("id", "headline")
        out = out.join(shown, "id", "left")
        plain = F.coalesce(F.left("headline", F.lit(snippet_chars)), plain)
    return out.select("id", "rank", "vector", "lexical", "recency", plain.alias("snippet"), "degraded")


def found_people(contacts: DataFrame, text: str, k: int = 10, offset: int = 0) -> DataFrame:
    """(id, name, how): contacts (id, name, handles, notes, last_seen) that a text names: by
    name as it is, by a handle, by a part of the name, or in the notes, in that order,
    the latest seen first. Case doesn't matter; a blank text names nobody."""
    low, given = text.strip().lower(), F.lit(bool(text.strip()))
    name = F.lower(F.coalesce("name", F.lit("")))
    handle = F.exists(F.coalesce("handles", F.array().cast("array<string>")), lambda h: F.lower(h) == low)
    how = F.when(name == low, 1).when(handle, 2).when(F.contains(name, F.lit(low)), 3).when(F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit(low)), 4)
    ways = F.element_at(F.array(*map(F.lit, ("name", "handle", "part", "notes"))), how)
    some = contacts.withColumn("_how", F.when(given, how)).filter("_how is not null")
    return some.orderBy("_how", F.desc_nulls_last("last_seen"), "id").offset(offset).limit(k).select("id", "name", ways.alias("how"))


def found_entries(journal: DataFrame, index: postings.Index, query: WebQuery, k: int = 10, kinds: list[str] | None = None, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """(id, score, excerpt): journal entries (id, text, kind, at) by the words of a query,
    ties the latest first; of no words, the latest entries with score 0."""
    some = journal if kinds is None else journal.filter(F.col("kind").isin(kinds))
    some = some if after is None else some.filter(F.col("at") >= after)
    some = some if before is None else some.filter(F.col("at") < before)
    if not query.groups:
        late = some.orderBy(F.desc_nulls_last("at"), "id").limit(k)
        return late.select("id", F.lit(0.0).alias("score"), F.left("text", F.lit(200)).alias("excerpt"))
    hits = postings.cover_ranks(index, query).select("id", "score")
    # Texts are looked up for the few that are shown.
    first = some.select("id", "at").join(hits, "id").orderBy(F.desc("score"), F.desc_nulls_last("at"), "id").limit(k).select("id", "score")
    best = saved(some.select("id", "text").join(F.broadcast(saved(first, "journal-hits")), "id"), "journal-texts")
    shown = postings.fragments(index, query, best.select("id", "text"), 20, 1)
    return best.join(shown, "id", "left").select("id", "score", F.coalesce("headline", F.left("text", F.lit(200))).alias("excerpt"))
