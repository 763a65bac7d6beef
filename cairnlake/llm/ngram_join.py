"""N-gram Jaccard join with Bayesian candidate pruning.

Texts that are equal collapse to one class first. Classes that share a band of
MinHash values meet in a bucket, where their signatures are compared step by
step: a pair drops out as soon as the posterior probability that its similarity
reaches the threshold falls below the tolerance. What is left links classes to
groups of close texts, and only within these whole texts are verified, on their
exact shingle sets (124 bits a shingle, of two hashes that share nothing). Large buckets and groups are dealt to tasks as pairs of
chunks, so no task holds a large one, and tasks return sums and spanning links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import U, constants, flat, mix, pieces, shingles
from cairnlake.llm.common import salted_join, saved, table, unused
from cairnlake.llm.components import components

SHINGLE = 5
#: Similarity as a fraction, so that ties at the threshold are exact.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 24, 4
HASHES = 96
STEP = 16
TOLERANCE = 1e-6
CHUNK = 512
#: Bytes of whole texts in a chunk, on average; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Pairs that are compared at once.
LOT = 1 << 18


def least_matches(n: int, threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among n for which P(similarity >= threshold)
    under a uniform prior is ``tolerance`` at least."""
    for m in range(n + 1):
        tail = sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        if tail >= tolerance:
            return m
    return n


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors, band = constants(HASHES, 13), constants(BANDS, 17)
    for batch in pieces(batches, "text"):
        data, at = flat(batch.column(2))
        hashed, first = shingles(data, at, SHINGLE)
        some = np.flatnonzero(np.diff(first))
        values = np.zeros((len(some), HASHES), np.uint32)
        if len(some):
            begin = first[:-1][some]
            for k in range(HASHES):
                values[:, k] = np.minimum.reduceat(hashed * factors[k], begin) >> U(32)
        keys = np.zeros((len(some), BANDS), U)
        for k in range(BANDS):
            code = np.full(len(some), band[k])
            for row in range(k * ROWS, (k + 1) * ROWS):
                code = mix(code + values[:, row].astype(U))
            keys[:, k] = code
        kept = batch.take(pa.array(some))
        yield pa.RecordBatch.from_arrays(
            [
                kept.column(1),
                pa.array([row.tobytes() for row in values], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                pa.array(np.diff(at)[some], pa.int64()),
            ],
            ["key", "values", "bands", "bytes"],
        )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that links a-b lead to from each of 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _jaccard(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of each pair reach the threshold; counts are exact."""
    sizes = np.array([len(s) for s in sets])
    if len(a) <= 256:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    else:  # many pairs among few texts: products of incidence blocks
        used = np.unique(np.concatenate([a, b]))
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        flat_sets, owner = np.concatenate([sets[i] for i in used]), np.repeat(np.arange(len(used)), sizes[used])
        _, column, times = np.unique(flat_sets, return_inverse=True, return_counts=True)
        common = times > 1
        number = np.cumsum(common) - 1
        keep = common[column]
        column, owner = number[column[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(used), len(used)), np.float32)
        for low in range(0, int(common.sum()), 2048):
            lo, hi = np.searchsorted(column, [low, low + 2048])
            block = np.zeros((len(used), 2048), np.float32)
            block[owner[lo:hi], column[lo:hi] - low] = 1
            both += block @ block.T
        shared = both[place[a], place[b]].astype(np.int64)
    return shared * DENOMINATOR >= NUMERATOR * (sizes[a] + sizes[b] - shared)


def _limits() -> list[tuple[int, int]]:
    return [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def _pruned(values: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may still reach the threshold after all steps."""
    same, done = np.zeros(len(a), np.int32), 0
    for n, least in limits:
        same += (values[a, done:n] == values[b, done:n]).sum(1, dtype=np.int32)
        live = same >= least
        a, b, same, done = a[live], b[live], same[live], n
    return a, b


def _lots(cut: np.ndarray, side: np.ndarray, between: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare, some at a time: of each group cut[k]:cut[k + 1] all, or,
    where it is ``between`` two chunks, those of one side and the other."""
    sizes = np.diff(cut)
    for size in np.unique(sizes[~between]):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        begins = cut[:-1][~between & (sizes == size)]
        step = max(1, LOT // len(i))
        for at in range(0, len(begins), step):
            some = begins[at : at + step, None]
            yield (some + i).ravel(), (some + j).ravel()
    for k in np.flatnonzero(between):
        left = cut[k] + np.flatnonzero(side[cut[k] : cut[k + 1]] == 0)
        right = cut[k] + np.flatnonzero(side[cut[k] : cut[k + 1]] == 1)
        yield np.repeat(left, len(right)), np.tile(right, len(left))


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows sorted by (grp, i, j) in tables of whole groups, with the cuts between
    groups and whether each is between two chunks."""
    names = ("grp", "i", "j")

    def cuts(rows: pa.Table) -> np.ndarray:
        group = np.stack([rows.column(c).to_numpy() for c in names])
        return np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1, [rows.num_rows]])

    def whole(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows, cut = rows.combine_chunks(), cuts(rows)
        return rows, cut, (rows.column("i").to_numpy() != rows.column("j").to_numpy())[cut[:-1]]

    held: list[pa.RecordBatch] = []
    for batch in pieces(batches, column, most):
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if start := int(cuts(rows)[-2]):  # the last group may go on
            yield whole(rows.slice(0, start))
            held = rows.slice(start).to_batches()
    if held:
        yield whole(pa.Table.from_batches(held))


def _values(rows: pa.Table) -> np.ndarray:
    return flat(rows.column("values"))[0].view(np.uint32).reshape(rows.num_rows, HASHES)


def _numbered(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first) of the shingles of texts; shingles share a number if both
    of their hashes are equal."""
    hashed, first = shingles(text, begin, SHINGLE)
    other, _ = shingles(text, begin, SHINGLE, kind=1)
    _, at, number = np.unique(hashed, return_index=True, return_inverse=True)
    if (other[at][number] != other).any():
        order = np.lexsort((other, hashed))
        fresh = (np.diff(hashed[order]) != 0) | (np.diff(other[order]) != 0)
        number[order] = np.cumsum(np.concatenate([[False], fresh]))
    return number, first


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets: spanning links of the pairs that pruning leaves."""
    limits = _limits()
    for rows, cut, between in _whole_groups(batches, "values", 8 << 20):
        values, node, n = _values(rows), rows.column("node").to_numpy(), rows.num_rows
        pairs = [_pruned(values, a, b, limits) for a, b in _lots(cut, rows.column("side").to_numpy(), between)]
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        root = _roots(n, a, b)
        linked = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups of close texts: per text its links' weight and the root it hangs on."""
    limits = _limits()
    for rows, cut, between in _whole_groups(batches, "text", 4 << 20):
        key, weight, values = rows.column("key").to_pylist(), rows.column("copies").to_numpy(), _values(rows)
        text, begin = flat(rows.column("text"))
        side = rows.column("side").to_numpy()
        out_key, out_links, out_root = [], [], []
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            pairs = [_pruned(values[lo:hi], a, b, limits) for a, b in _lots(np.array([0, hi - lo]), side[lo:hi], between[k : k + 1])]
            a, b = (np.concatenate([p[x] for p in pairs]) if pairs else np.zeros(0, np.int64) for x in (0, 1))
            if not len(a):
                continue
            number, first = _numbered(text[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo])
            ok = _jaccard([np.unique(number[first[x] : first[x + 1]]) for x in range(hi - lo)], a, b)
            a, b = a[ok], b[ok]
            links = np.bincount(a, weight[lo + b], hi - lo) + np.bincount(b, weight[lo + a], hi - lo)
            root = _roots(hi - lo, a, b)
            for x in np.flatnonzero(links):
                out_key.append(key[lo + x])
                out_links.append(int(links[x]))
                out_root.append(key[lo + root[x]])
        yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary())], ["key", "links", "root"])


def _dealt(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members (grp, n: size of the group, node, columns) as sorted rows (grp, i, j,
    side, columns) for tasks: a group of up to CHUNK at once, a larger one as all
    pairs of its chunks, so that its rows are repeated once a chunk. Where members
    have ``total``, the bytes of their group's texts, these are cut likewise."""
    chunks = F.ceil(F.col("n") / CHUNK)
    if "total" in members.columns:
        chunks = F.greatest(chunks, F.ceil(F.col("total") / CHUNK_BYTES))
    chunked = members.withColumn("chunks", chunks.cast("int"))
    chunked = chunked.withColumn("chunk", F.expr("cast(pmod(xxhash64(node, 1), chunks) as int)"))
    paired = chunked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = (F.col("chunk") > F.col("with")).cast("int").alias("side")
    paired = paired.select("grp", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), side, *columns)
    return paired.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _near(classes: DataFrame) -> DataFrame:
    """(node, component): groups of classes that close signatures link."""
    in_band = saved(classes.select("node", F.explode("bands").alias("band")), "ngram-bands")
    bucket = in_band.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor("node").alias("all"), F.min("node").alias("low"), F.max("node").alias("high"))
    # Buckets with the same members need a look at one of them only.
    bucket = bucket.filter("n > 1").groupBy("n", "all", "low", "high").agg(F.min("band").alias("band"))
    chosen = bucket.select("band", "n", F.col("n").alias("_n"))
    members = salted_join(in_band, chosen, "band", "_n", in_band.count(), F.col("node"))
    members = members.withColumnRenamed("band", "grp").join(classes.select("node", "values"), "node")
    links = saved(_dealt(members, ["node", "values"]).mapInArrow(_close, "a long, b long"), "ngram-close")
    # A class is linked in many blocks: it keeps its least link, and the ends of the
    # others, which are few different ones, are linked to that end.
    star = links.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))
    return components(star.select(F.explode(F.array_union(F.array("a"), "all")).alias("a"), F.col("least").alias("b")).distinct())


def _text_key():
    """128 bits of SHA-256 of the text."""
    return F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))


def _rooted(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), root (the least key
    that links lead to; null for texts without words) and n_links."""
    docs = docs.select("doc_id", _text_key().alias("key"), "text")
    keyed = saved(docs.select("doc_id", "key"), "ngram-keys")
    signed = docs.mapInArrow(_signatures, "key binary, values binary, bands array<bigint>, bytes long")
    # Copies carry equal values, so any of a class will do.
    classes = signed.groupBy("key").agg(F.count("*").alias("copies"), F.first("values").alias("values"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    classes = saved(classes.withColumn("node", F.xxhash64("key")), "ngram-classes")
    near = _near(classes)

    sized = near.join(classes.select("node", "bytes"), "node")
    sizes = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    members = salted_join(near, sizes.withColumn("_n", F.col("n")), "component", "_n", near.count(), F.col("node"))
    chosen = classes.drop("bands", "bytes").join(members.withColumnRenamed("component", "grp"), "node")
    # The texts: one document of each chosen class.
    heads = keyed.join(chosen.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("head"))
    heads = heads.withColumnRenamed("key", "_key")
    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("key") == F.col("_key"))).select("key", "text").dropDuplicates(["key"])
    dealt = _dealt(chosen.join(texts, "key"), ["key", "copies", "values", "text"])
    found = saved(dealt.mapInArrow(_verified, "key binary, links long, root binary"), "ngram-links")

    whole = components(found.select(F.hex("key").alias("a"), F.hex("root").alias("b")))
    whole = whole.select(F.unhex("node").alias("key"), F.unhex("component").alias("root"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    has = classes.select("key", "copies").join(links, "key", "left").join(whole, "key", "left")
    has = has.select("key", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return keyed.join(has, "key", "left")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links.

    Texts are linked if the Jaccard similarity of their sets of 5-word windows
    is 0.8 or more (words are runs without ASCII space; a text of fewer words is
    one window). class_id is the smallest doc_id that links lead to, the
    document's own without links; n_links counts linked documents, equal texts
    included. Null texts and such without words have no links. Repeated rows
    are equal texts.
    """
    out = _rooted(docs)
    first = out.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return out.join(first, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: one row of each class stays, with all its
    columns: the one with the smallest doc_id (null last), then the smallest digest
    of the text, then the smallest other columns as JSON.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not
    a class all stay, and rows without a doc_id are compared like others. Texts
    without words, and null ones, have no copies and stay.
    """
    given = docs.columns
    none, number, key = unused(docs, "_none"), unused(docs, "_id"), unused(docs, "_key")
    # No nulls among these, so that grouping and join share one exchange.
    by = [F.col("doc_id").isNull().alias(none), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(number)]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    heads = _rooted(docs).filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.key").alias(key)).select(*by, key)
    rest = F.to_json(F.struct(*[c for c in given if c != "text"]), {"ignoreNullFields": "false"})
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows of one doc_id and text are combined before they are moved.
    rows = docs.filter(wordy).select(*by, _text_key().alias(key), F.struct(*given).alias("row"), rest.alias("rest"))
    rows = rows.groupBy(none, number, key).agg(F.min_by("row", "rest").alias("row"))
    return rows.join(heads, [none, number, key]).select("row.*").unionByName(docs.filter(~wordy))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
