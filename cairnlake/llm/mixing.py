"""Mixing sources to target weights.

Tokens of each source are packed into blocks of a fixed length. The slots of
the output, as many of each source as its target holds, are dealt to positions
by a pseudorandom permutation: the counts of a shard are a multinomial draw
given the totals of the sources, alike in every shard. The slots of a source,
numbered by that permutation, walk pseudorandom permutations of its block
indexes (one permutation an epoch), and blocks are joined to slots by index. All
steps are DataFrame expressions; the driver sees a few sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.llm.common import saved, table, unused, word_count, words

#: Rows that are ordered together while blocks are packed.
ROWS_PER_BIN = 4_000
#: A column of documents, if there, by which rows of one id and size are told apart.
SPREAD = "_spread"
ROUNDS = 12
#: Words of a block, at most: a source's blocks are of one length, which divides
#: it into equal parts, so that a source of a few blocks meets its target too.
BLOCK_WORDS = 128


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per document with source_no, start, size, the target and the
    length of the source's blocks (n_block); ``picks``: (source_no, block, shard,
    slot, n_take), a row per slot, where n_take is the words it takes of the block
    if that is not all."""

    docs: DataFrame
    picks: DataFrame


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 at x (swap-or-not): in each round x
    is exchanged with its partner, or not, by a bit that both share."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        bit = F.xxhash64(key, r, F.greatest(at, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def _running(df: DataFrame, order: list[Column], amounts: dict[str, Column], tag: str) -> DataFrame:
    """``df`` with the sum of each amount over the rows before, in the given order.

    The rows are dealt to ranges of the order; sums go over the rows of a range
    and over the ranges, so no window holds all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged, tag)
    totals = ranged.groupBy("_range").agg(*[F.sum(x).alias(f"_all_{name}") for name, x in amounts.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_all_{name}") for name in amounts])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumns({f"_in_{name}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for name, x in amounts.items()}).join(totals, "_range")
    return out.withColumns({name: F.col(f"_in_{name}") + F.col(f"_all_{name}") for name in amounts}).drop("_range", *[f"_{k}_{name}" for name in amounts for k in ("in", "all")])


def _targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds the target: ``share`` of all sizes by weight, none above ``most`` times
    its size; the excess goes to the others by weight until none is above.

    A source is at its limit if ``level`` times its weight is above it, and each
    round raises the level: the state is one number, however many sources there are.
    """
    size, weight, limit = F.col("source_size"), F.col("weight"), F.col("source_size") * most
    total, free = sources.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    level, n_over = (share * total / free if free else 0.0), -1
    while True:
        over = F.lit(level) * weight > limit
        capped, free, n = sources.agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0)), F.count_if(over)).first()
        if n == n_over or not free:
            break
        level, n_over = (share * total - capped) / free, n
    return sources.withColumn("target", F.least(F.lit(level) * weight if free else limit, limit).cast("double"))


def _sources(docs: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: source, source_no, source_size, target, n_block (words of
    a block), blocks, slots, left (words of the last slot, if not a whole block),
    at (slots of the sources before) and bins."""
    per = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("rows"))
    order = [F.col("source").isNull(), F.col("source")]
    per = _running(per, order, {"source_no": F.lit(1).cast("long")}, "mix-sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    out = _targets(saved(per.withColumn("weight", turn), "mix-weights"), share, most)
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS))
    out = out.withColumn("blocks", blocks).withColumn("n_block", F.ceil(F.col("source_size") / F.greatest("blocks", F.lit(1))))
    wanted = F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * most).cast("long"))
    out = out.withColumn("_wanted", wanted).withColumn("left", F.col("_wanted") % F.greatest("n_block", F.lit(1)))
    out = out.withColumn("slots", F.when(F.col("blocks") > 0, F.ceil(F.col("_wanted") / F.greatest("n_block", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("bins", F.ceil(F.col("rows") / F.lit(ROWS_PER_BIN))).drop("_wanted", "weight", "rows")
    return saved(_running(out, [F.col("source_no")], {"at": F.col("slots")}, "mix-slots"), "mix-plan")


def _packed(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The documents with the place ``start`` of their words in their source."""
    known = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "n_block", "bins")
    out = docs.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # An order of its own mixes neighbours; bins of it are ordered one by one.
    # What tells rows apart is hashed too, so that rows without an id, or with one id
    # for all, and of one size do not meet in one bin.
    apart = [F.col(c) for c in (SPREAD, "text") if c in out.columns][:1]
    out = out.withColumn("_mixed", F.xxhash64(F.lit(seed), "doc_id", "size", *apart)).withColumn("_bin", F.pmod("_mixed", "bins"))
    sums = out.groupBy("source_no", "_bin").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source_no").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bin", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    within = W.partitionBy("source_no", "_bin").orderBy("_mixed", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_in_bin", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["source_no", "_bin"])
    return out.withColumn("start", F.col("_from") + F.col("_in_bin")).drop("_mixed", "_bin", "_in_bin", "_from", "bins")


def _picks(spark: SparkSession, sources: DataFrame, seed: int) -> DataFrame:
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count_if(F.col("slots") > 0)).first()
    if not total:
        return spark.createDataFrame([], "source_no long, block long, shard long, slot long, n_take long")
    drawn = spark.range(total).withColumnRenamed("id", "slot").withColumn("shard", F.expr(f"slot div {max(1, math.isqrt(total))}"))
    drawn = drawn.withColumn("_place", permuted(F.col("slot"), F.lit(total), F.lit(seed).cast("long")))
    # The source whose range holds the place: sources are listed by cells of the
    # places, a few cells a source, so that this is a join on the cell.
    width = max(1, total // (4 * n))
    cells = F.explode(F.sequence(F.expr(f"at div {width}"), F.expr(f"(at + slots - 1) div {width}")))
    ranges = sources.filter("slots > 0").select("source_no", "at", "slots", "blocks", "left", cells.alias("_cell"))
    drawn = drawn.withColumn("_cell", F.expr(f"_place div {width}")).join(ranges, "_cell").filter("_place >= at and _place < at + slots")
    # An epoch goes through all blocks of the source once.
    drawn = drawn.withColumn("_k", F.col("_place") - F.col("at")).withColumn("_epoch", F.expr("_k div blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source_no"), F.col("_epoch"))
    block = permuted(F.col("_k") % F.col("blocks"), F.col("blocks"), F.col("_key"))
    last = (F.col("_k") == F.col("slots") - 1) & (F.col("left") > 0)
    return drawn.withColumn("_key", key).select("source_no", block.alias("block"), "shard", "slot", F.when(last, F.col("left")).alias("n_take"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20240131) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source and size columns, and any others). Rows of
    one doc_id and size are spread by a column SPREAD, or by ``text``, where there is one.

    Sources in code point order, null last, take ``weights`` in turn. A document
    without words, or of null size, is taken 0 times. Rows that repeat are separate
    documents. An empty table, or one without words, gives no slots. Long texts
    count like others: a document may span any number of blocks. Other columns
    are kept; those named like columns of the plan (source_no, source_size,
    target, n_block, start) are replaced by these.
    """
    plan = ("source_no", "source_size", "target", "n_block", "start")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in plan]).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    sources = _sources(docs, weights, share, most)
    return Mix(_packed(docs, sources, seed), _picks(docs.sparkSession, sources, seed))


def _reach() -> tuple[Column, Column]:
    """First and last block that a document lies in."""
    return F.expr("start div n_block"), F.expr("(start + size - 1) div n_block")


def taken_words(mix: Mix) -> DataFrame:
    """The documents with ``taken``: words of theirs in taken blocks, repeats counted."""
    times = mix.picks.groupBy("source_no", "block").agg(F.count_if(F.col("n_take").isNull()).alias("_times"), F.coalesce(F.max("n_take"), F.lit(0)).alias("_part"))
    pieces = mix.docs.select("source_no", "start", "size", "n_block").filter("size > 0").withColumn("block", F.explode(F.sequence(*_reach())))
    low = F.greatest(F.col("start"), F.col("block") * F.col("n_block"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("n_block"))
    pieces = pieces.withColumn("_low", low).withColumn("_high", high).join(times, ["source_no", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("_high"), F.col("block") * F.col("n_block") + F.col("_part")) - F.col("_low"))
    taken = pieces.groupBy("source_no", "start").agg(F.sum((F.col("_high") - F.col("_low")) * F.col("_times") + part).alias("_taken"))
    taken = taken.withColumnsRenamed({"source_no": "_no", "start": "_start"})
    mine = (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return mix.docs.join(taken, mine, "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_no", "_start", "_taken", "source_no", "start", "n_block")


def mixed_blocks(mix: Mix, text_col: str = "text") -> DataFrame:
    """The mix itself: (shard, slot, source, block, n_words, doc_ids, text) with a row
    per slot; words are set apart by one space. Each text is split into words once
    and cut into the parts that lie in its blocks."""
    held = unused(mix.docs, "_words")
    docs = mix.docs.filter("size > 0").select("source_no", "source", "start", "size", "n_block", "doc_id", words(F.col(text_col)).alias(held))

    def part(block: Column) -> Column:
        low = F.greatest(F.col("start"), block * F.col("n_block"))
        high = F.least(F.col("start") + F.col("size"), (block + 1) * F.col("n_block"))
        some = F.slice(F.col(held), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(block.alias("block"), low.alias("low"), (high - low).alias("n"), F.array_join(some, " ").alias("part"))

    pieces = docs.select("source_no", "source", "doc_id", F.explode(F.transform(F.sequence(*_reach()), part)).alias("_x"))
    listed = F.sort_array(F.collect_list(F.struct(*[F.col(f"_x.{c}").alias(c) for c in ("low", "n")], "doc_id", F.col("_x.part").alias("part"))))
    filled = pieces.groupBy("source_no", F.col("_x.block").alias("block")).agg(F.first("source").alias("source"), listed.alias("_p"))
    out = mix.picks.join(filled, ["source_no", "block"])
    first, last = F.get(F.col("_p"), F.lit(0)), F.element_at("_p", -1)
    out = out.withColumn("n_words", F.least(last["low"] + last["n"] - first["low"], F.coalesce("n_take", F.lit(BLOCK_WORDS))))
    # Of a block that is taken in part, the words and the documents in that part.
    whole = F.array_join(F.col("_p.part"), " ")
    text = F.when(F.col("n_take").isNull(), whole).otherwise(F.array_join(F.slice(F.split(whole, " "), F.lit(1), F.col("n_words").cast("int")), " "))
    inside = F.filter("_p", lambda p: p["low"] - first["low"] < F.col("n_words"))
    return out.select("shard", "slot", "source", "block", "n_words", F.transform(inside, lambda p: p["doc_id"]).alias("doc_ids"), text.alias("text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Rows without an id are numbered, once and for all, since even their texts may be equal.
    spread = F.xxhash64("text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread.alias(SPREAD)), "mix-sizes")
    return taken_words(plan_mix(sized)).select("doc_id", "size", "source_size", "target", "taken")
