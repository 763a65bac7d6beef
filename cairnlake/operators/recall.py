"""Tiered recall: seeds by vector, activation over edges, one score, the best of each tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions import scoring, text
from cairnlake.operators.filters import json_holds
from cairnlake.operators.reports import meta
from cairnlake.operators.rollups import top_of_each
from cairnlake.operators.search import term_scores
from cairnlake.operators.vectors import cosine
from cairnlake.shared import saved


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(node, activation): what ``seeds`` (node, activation) reach within ``hops``
    edges either way, with the largest product of activation and weights."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    both = both.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    front, levels = seeds.select("node", "activation"), []
    for _ in range(hops):
        front = front.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.max(F.col("activation") * F.col("weight")).alias("activation"))
        levels.append(front)
    return reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.max("activation").alias("activation"))


def tiered(rows: DataFrame, query: list[float], edges: DataFrame, k: int) -> DataFrame:
    """(id, tier, score, rank): the best ``k`` of each tier.

    ``rows`` are (id, tier, embedding, strength, felt, age_days, trust, boost,
    invalid, mood). Candidates are the 2k nearest rows of each tier and the
    neighbours they activate; only these, a bounded table, are scored and ranked.
    """
    near = rows.withColumn("similarity", cosine(F.col("embedding"), query)).drop("embedding").filter("similarity is not null")
    seeds = top_of_each(near.select("id", "tier", "similarity"), ["tier"], 2 * k, F.desc("similarity"), F.col("id"))
    active = spread(edges, seeds.select(F.col("id").alias("node"), F.col("similarity").alias("activation"))).withColumnRenamed("node", "id")
    pool = seeds.select("id").join(active, "id", "full").withColumn("activation", F.coalesce("activation", F.lit(0.0)))
    score = scoring.recall_score(
        F.col("similarity"), F.col("strength"), F.col("felt"), F.col("activation"), F.lit(0.0), F.col("age_days"), F.col("trust"), F.col("boost"), F.col("invalid"), F.col("mood")
    )
    return top_of_each(near.join(pool, "id").select("id", "tier", score.alias("score")), ["tier"], k, F.desc("score"), F.col("id"))


def chunk_ranking(by_vector: DataFrame, by_text: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(id, vector_score, lexical_score, score) of the best ``k``.

    The two inputs (id, score) are cut to 2k rows each, so the largest lexical
    score, by which that part is divided, comes from a small window. ``facts``
    is (id, recency, trust, desk).
    """
    v = by_vector.orderBy(F.desc("score"), "id").limit(2 * k).select("id", F.col("score").alias("vector_score"))
    t = by_text.orderBy(F.desc("score"), "id").limit(2 * k)
    t = t.select("id", (F.col("score") / F.nullif(F.max("score").over(W.partitionBy()), F.lit(0.0))).alias("lexical_score"))
    both = v.join(t, "id", "full").join(facts, "id")
    score = 0.6 * F.coalesce("vector_score", F.lit(0.0)) + 0.4 * F.coalesce("lexical_score", F.lit(0.0)) + 0.1 * F.col("recency") + 0.1 * F.col("trust") + F.when(F.col("desk"), 0.05).otherwise(0.0)
    return both.withColumn("score", score).select("id", "vector_score", "lexical_score", "score").orderBy(F.desc("score"), "id").limit(k)


def snapshot(rows: DataFrame, phrase: str, terms: list[str], least: float = 0.35) -> DataFrame:
    """(id, score) of ``rows`` (id, content, similarity or null) by the best of
    meaning, words and trigrams; a row must pass one of their floors first."""
    words = term_scores(rows, terms, "id", "content").select("id", F.col("score").alias("lexical"))
    found = rows.join(words, "id", "left").withColumn("trigram", text.trigram_similarity(F.col("content"), F.lit(phrase)))
    some = (F.coalesce("similarity", F.lit(0.0)) >= 0.15) | F.col("lexical").isNotNull() | (F.col("trigram") >= 0.1) | F.contains(F.lower("content"), F.lit(phrase.lower()))
    lexical = F.when(F.col("lexical") > 0, F.least(F.lit(1.0), 0.35 + 4.0 * F.col("lexical"))).otherwise(0.0)
    score = F.greatest(F.coalesce("similarity", F.lit(0.0)), lexical, F.col("trigram"))
    return found.filter(some).select("id", score.alias("score")).filter(F.col("score") >= least)


def opened(chunks: DataFrame, wanted: Column, doc: str = "doc_id", index: str = "chunk_index") -> DataFrame:
    """The wanted chunks with the handles of the nearest lower and higher chunk of
    the whole document. Index numbers are unique within a document."""
    w = W.partitionBy(doc).orderBy(index)
    # Only chunks of documents that have a wanted one are put in order.
    some = chunks.join(chunks.filter(wanted).select(doc).distinct(), doc, "left_semi")
    return some.withColumns({"previous": F.lag(index).over(w), "following": F.lead(index).over(w)}).filter(wanted)


def first_of_equal(ranked: DataFrame, kind: str, content: str, *order: Column) -> DataFrame:
    """The first row in the given order of each (kind, content up to case and
    blanks). Null content is a content of its own. An id is taken to have one content."""
    key = F.sha2(F.lower(F.btrim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"[ \t\r\n]+", " "))), 256)
    marked = ranked.withColumns({"_key": key, "_none": F.col(content).isNull()})
    return marked.withColumn("_r", F.row_number().over(W.partitionBy(kind, "_key", "_none").orderBy(*order))).filter("_r = 1").drop("_key", "_none", "_r")


def cluster_samples(df: DataFrame, centers: DataFrame, query: list[float], clusters: int, samples: int, id_col: str = "vec_id", cluster_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(cluster, cluster_similarity, id, similarity): the members nearest to the query of the clusters nearest to it."""
    near = centers.select("cluster", cosine(F.col("centroid"), query).alias("cluster_similarity")).orderBy(F.desc("cluster_similarity"), "cluster").limit(clusters)
    members = df.select(F.col(cluster_col).alias("cluster"), F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("similarity"))
    return top_of_each(members.join(near, "cluster"), ["cluster"], samples, F.desc("similarity"), F.col("id")).select("cluster", "cluster_similarity", "id", "similarity")


def history(sources: dict[str, DataFrame], term: str, each: int, preview: int = 280) -> DataFrame:
    """(source, id, preview): rows (id, at, content) that hold the term, letter case
    aside; the latest ``each`` of every source."""
    def hits(name: str, df: DataFrame) -> DataFrame:
        found = df.filter(F.contains(F.lower("content"), F.lit(term.lower()))).orderBy(F.desc("at"), "id").limit(each)
        return found.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), F.substring("content", 1, preview).alias("preview"))

    return reduce(DataFrame.unionByName, [hits(n, d) for n, d in sources.items()])


def by_ids(memories: DataFrame, ids: list[int], max_chars: int | None = None) -> DataFrame:
    """The rows with these ids, their content cut to ``max_chars``."""
    some = memories.filter(F.col("id").isin(ids))
    return some if max_chars is None else some.withColumn("content", F.left("content", F.lit(max_chars)))


def recent(memories: DataFrame, k: int, as_of, types: list[str] | None = None, by_access: bool = False) -> DataFrame:
    """The k latest live memories by creation or by access, those never accessed last."""
    live = memories.filter((F.col("status") == "active") & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))
    live = live if types is None else live.filter(F.col("type").isin(types))
    return live.orderBy(F.desc_nulls_last("last_accessed" if by_access else "created_at"), "id").limit(k)


def previews(memories: DataFrame, n: int) -> DataFrame:
    """Adds the first n characters and the length of the content."""
    return memories.withColumns({"preview": F.left("content", F.lit(n)), "n_chars": F.length("content")})


def structured(hits: DataFrame, memories: DataFrame, k: int, types: list[str] | None = None, least_importance: float | None = None, content_hash: str | None = None, after=None, before=None, holds: dict | None = None) -> DataFrame:
    """The k best of scored ``hits`` (id, score) among the memories that pass all given
    filters; the memories are filtered before they are joined."""
    some = memories if types is None else memories.filter(F.col("type").isin(types))
    wanted = [
        None if least_importance is None else F.col("importance") >= least_importance, None if content_hash is None else F.col("content_hash") == content_hash,
        None if after is None else F.col("created_at") >= after, None if before is None else F.col("created_at") < before, None if holds is None else json_holds(F.col("metadata"), holds),
    ]
    for condition in wanted:
        some = some if condition is None else some.filter(condition)
    return some.join(hits, "id").filter("score is not null").orderBy(F.desc("score"), F.desc("created_at"), "id").limit(k)


#: Tier of each type of memory.
TIERS = {"episodic": "episodic", "semantic": "semantic", "procedural": "knowledge", "strategic": "knowledge", "worldview": "knowledge", "goal": "knowledge"}
#: Edges along which a memory calls up another (fixed values).
CALLING = ("SUPPORTS", "CONTRADICTS", "CAUSES", "CONTESTED_BECAUSE", "RELATED_TO", "SUPERSEDES")


def _mood(now: tuple[float, float, str]) -> Column:
    """How near a memory's mood is to the present one, by its emotional context or,
    without one, by its valence; 0.5 for what is not told."""
    of = lambda path, kind="double": meta(path, kind)
    near = lambda x, y, width: F.coalesce(1.0 - F.abs(x - y) / width, F.lit(0.5))
    felt = of("emotional_context.primary_emotion", "string")
    whole = near(of("emotional_context.valence"), now[0], 2.0) * 0.6 + near(of("emotional_context.arousal"), now[1], 1.0) * 0.3
    whole = whole + F.when(felt.isNull(), 0.5).when(felt == now[2], 1.0).otherwise(0.7) * 0.1
    return F.when(meta("emotional_context").isNotNull(), whole).otherwise(near(of("emotional_valence"), now[0], 2.0))


def in_context(
    memories: DataFrame, query: list[float], as_of: Column, neighbours: DataFrame, edges: DataFrame, open_members: DataFrame,
    ks: dict[str, int] | None = None, mood: tuple[float, float, str] = (0.0, 0.5, "neutral"), least_trust: float = 0.0, show_private: bool = True,
) -> DataFrame:
    """(id, tier, score, source, rank): the memories that a query calls up, by tier.

    Live embedded memories are compared with the query; the 2k nearest of each tier
    are seeds. Others are called up by neighbourhoods (id, neighbour, weight), by
    typed edges (src, dst, rel, weight) either way, or stand in an open episode
    (id). Only these candidates, a bounded table, are joined to their rows again
    and scored: similarity dimmed by fading, what calls them up, recency, trust,
    boost, mood, and a deduction for bad precedents.
    """
    ks = ks or {"episodic": 5, "semantic": 10, "knowledge": 5}
    live = memories.filter((F.col("status") == "active") & (F.col("embedding_status") == "embedded") & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))
    live = live if show_private else live.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    tier = F.coalesce(*[F.when(F.col("type") == t, F.lit(name)) for t, name in TIERS.items()])
    live = live.withColumns({"similarity": cosine(F.col("embedding"), query), "tier": tier}).drop("embedding").filter("similarity is not null and tier is not null")

    # The best of one tier after the other, each with a limit that cuts in every task.
    near = live.select("id", "tier", "similarity")
    seeds = [near.filter(F.col("tier") == t).orderBy(F.desc("similarity"), "id").limit(2 * k) for t, k in ks.items()]
    seeds = saved(reduce(DataFrame.unionByName, seeds).select("id", F.col("similarity").alias("vector")), "recall-seeds")

    near = neighbours.join(seeds, "id").groupBy(F.col("neighbour").alias("id")).agg(F.max(F.col("weight") * F.col("vector")).alias("association"))
    called = edges.filter(F.col("rel").isin(*CALLING)).select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    both = called.unionByName(called.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    linked = both.join(seeds, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("weight") * F.col("vector")).alias("graph"))
    present = open_members.select("id").distinct().orderBy("id").limit(20).withColumn("temporal", F.lit(0.15))
    pool = seeds.join(near, "id", "full").join(linked, "id", "full").join(present, "id", "full")

    kept = live.filter(F.col("trust_level") >= least_trust).join(pool, "id")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    strong = scoring.strength(F.col("importance"), F.col("decay_rate"), F.col("created_at"), F.col("last_reinforced"), as_of)
    felt = scoring.felt_intensity(meta("emotional_context.intensity", "double"), meta("emotional_valence", "double"), F.col("created_at"), F.col("last_reinforced"), as_of)
    fresh = F.exp(-F.log(F.lit(2.0)) * F.greatest(scoring.age_in_days(F.col("created_at"), as_of), F.lit(0.0)) / 7.0)
    score = (
        F.coalesce("vector", "similarity") * (0.5 + 0.5 * F.greatest(strong, 0.5 * felt)) + none("association") * 0.2 + none("temporal") + none("graph") * 0.12 + 0.1 * fresh
        + F.coalesce("trust_level", F.lit(0.5)) * 0.1 + scoring.clamp(none("activation_boost")) * 0.3 - F.when(F.coalesce("invalid_precedent", F.lit(False)), 0.35).otherwise(0.0) + _mood(mood) * 0.05
    )
    source = F.when(F.col("vector").isNotNull(), "vector").when(F.col("association").isNotNull(), "association").when(F.col("temporal").isNotNull(), "temporal").otherwise("graph")
    scored = kept.select("id", "tier", F.greatest(score, F.lit(0.001)).alias("score"), source.alias("source"))
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("tier").orderBy(F.desc("score"), "id")))
    return out.filter(F.col("rank") <= F.coalesce(*[F.when(F.col("tier") == t, F.lit(k)) for t, k in ks.items()]))
