"""Upserts, chunk renewal, import conflicts and turn pairing as new snapshots.

An update never changes a table in place: each operator returns what the
table becomes, or the action for each row, and the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.text import content_hash, normalized


def upserted(held: DataFrame, incoming: DataFrame, key: str, value: str, frozen: str) -> DataFrame:
    """(key, value, action) of the table after the upsert: inserted, updated,
    unchanged or kept. Rows with a true ``frozen`` column keep their value. Of rows
    that share a key the one with the greatest value counts, on either side."""
    one = lambda df, *more: df.groupBy(key).agg(F.max(value).alias(value), *more)
    held, incoming = one(held, F.max(F.coalesce(F.col(frozen), F.lit(False))).alias(frozen)), one(incoming)
    h = held.select(key, F.col(value).alias("_old"), F.coalesce(F.col(frozen), F.lit(False)).alias("_frozen"), F.lit(True).alias("_held"))
    n = incoming.select(key, F.col(value).alias("_new"), F.lit(True).alias("_came"))
    both = h.join(n, key, "full")
    action = (
        F.when(F.col("_held").isNull(), "inserted").when(F.col("_came").isNull() | F.col("_frozen"), "kept")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    )
    out = both.withColumn("action", action)
    return out.select(key, F.when(F.col("action").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old")).alias(value), "action")


def chunk_renewal(held: DataFrame, fresh: DataFrame, doc: str = "doc_id", index: str = "chunk_index", digest: str = "content_hash") -> DataFrame:
    """(doc, index, action) for the chunks of the documents in ``fresh``: unchanged
    ones keep their vectors, changed ones are embedded again, what is past the
    new end is trimmed. Documents without fresh chunks are left alone."""
    mine = held.join(fresh.select(doc).distinct(), doc, "left_semi").select(doc, index, F.col(digest).alias("_old"))
    both = mine.join(fresh.select(doc, index, F.col(digest).alias("_new")), [doc, index], "full")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "trimmed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("reembedded")
    return both.select(doc, index, action.alias("action"))


def import_conflicts(held: DataFrame, incoming: DataFrame, ref: str = "ref", content: str = "content") -> DataFrame:
    """(ref, verdict) of a dry run: same, conflict, duplicate (its content is held
    under another ref) or new. Content is compared by its canonical hash. Of rows that
    share a ref the one with the least hash counts, on either side."""
    first = lambda df, name: df.groupBy(ref).agg(F.min(content_hash(F.col(content))).alias(name))
    h = first(held, "_held")
    known = h.select(F.col("_held").alias("_digest")).distinct().withColumn("_known", F.lit(True))
    out = first(incoming, "_digest").join(h, ref, "left").join(known, "_digest", "left")
    verdict = F.when(F.col("_held") == F.col("_digest"), "same").when(F.col("_held").isNotNull(), "conflict").when(F.col("_known"), "duplicate").otherwise("new")
    return out.select(ref, verdict.alias("verdict"))


def turn_identity(asked: Column, reply: Column, session: Column, source: Column) -> Column:
    """The name of the turn's source where it has one, else a digest of both texts,
    normalised, and the session."""
    named, mark = F.btrim(F.coalesce(source, F.lit("")), F.lit(" ")), F.lit("\x1e")
    hashed = F.sha2(F.concat(normalized(asked), mark, normalized(reply), mark, F.coalesce(session.cast("string"), F.lit(""))), 256)
    return F.when(named != "", F.concat(F.lit("src:"), named)).otherwise(F.concat(F.lit("hash:"), hashed))


def turn_pairs(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text", source: str | None = None) -> DataFrame:
    """(session, order, pair, identity): each user turn with the reply right after
    it (or an empty one), and its identity."""
    w = W.partitionBy(session).orderBy(order)
    after = F.when(F.lead(role).over(w) == "assistant", F.lead(content).over(w))
    asked = turns.withColumn("_reply", F.coalesce(after, F.lit(""))).filter(F.col(role) == "user")
    said = F.coalesce(F.col(content), F.lit(""))
    named = F.col(source) if source else F.lit(None).cast("string")
    return asked.select(
        session, order, F.concat(F.lit("user: "), said, F.lit("\n\nagent: "), F.col("_reply")).alias("pair"),
        turn_identity(F.col(content), F.col("_reply"), F.col(session), named).alias("identity"),
    )


#: What stands for the middle of a shortened text; callers pass their own.
SHORTENED = "\n\n[... the full text remains stored; this input was shortened ...]\n\n"


def embedding_input(content: Column, most: int = 1800, mark: str = SHORTENED) -> Column:
    """Long texts as 70 % head, rounded up, a mark and the tail; texts of 500
    characters are never long, and with little room the head alone is taken."""
    content, most = F.coalesce(content, F.lit("")), max(most, 500)
    room = most - len(mark)
    head = -(-room * 7 // 10)
    cut = F.concat(F.left(content, F.lit(head)), F.lit(mark), F.right(content, F.lit(room - head))) if room >= 100 else F.left(content, F.lit(most))
    return F.when(F.length(content) <= most, content).otherwise(cut)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(all columns, check): a row for each check that a row fails; null passes, as in SQL."""
    broken = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("check", F.explode(broken))
