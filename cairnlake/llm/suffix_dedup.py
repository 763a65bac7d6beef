"""Suffix-array dedup of byte strings that repeat anywhere in a corpus.

Every 200-byte string is assigned to the least hash among its 48-byte strings,
so equal ones get the same key. Neighbouring starts with one key form a stretch
(its starts and the 199 bytes behind them). Stretches whose key occurs once
can't repeat. Equal stretches, told by 124 bits of hashes that share nothing,
collapse to one with its count; the remaining different stretches of a key meet
in one shard, whose suffix array (induced sorting) and permuted common prefixes
tell which strings start twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import Prefix, U, flat, pieces
from cairnlake.llm.common import salted_join, saved, table
from cairnlake.llm.suffix_sort import repeated_starts

LENGTH = 200
KEY = 48
#: Bytes of stretches sorted together, and different stretches of one key beyond
#: which their strings are counted one by one instead.
SHARD_BYTES = 2 << 20
MOST_STRETCHES = 16_384
#: Bytes of one text that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: A window's least hash is found together with its place: 32 bits each, always.
PLACE, HIGH = U((1 << 32) - 1), U(((1 << 32) - 1) << 32)
SPREAD = U(0x9E3779B97F4A7C15)

#: The columns that two stretches must share to count as equal.
SAME = ["key", "digest", "check"]
STRETCH = pa.struct([("first", pa.int32()), ("n", pa.int32()), *((c, pa.int64()) for c in SAME)])
STRETCH_SQL = "struct<first:int,n:int,key:long,digest:long,check:long>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
SPANS_SQL = "array<struct<start:int,end:int>>"
PARTS = pa.schema(
    [("row", pa.int64()), *((c, pa.int64()) for c in SAME), ("first", pa.int32()), ("copies", pa.int64()), ("part", pa.binary()), ("h", pa.int64()), ("g", pa.int64())]
)
PARTS_SQL = "row long, key long, digest long, check long, first int, copies long, part binary, h long, g long"


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def _stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, key, digest, check) of each stretch."""
    n, sizes = len(data), np.diff(at)
    if not len(sizes) or sizes.max() < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, U) for _ in range(3)))
    sums, others = Prefix(data), Prefix(data, 1)
    hashed = sums.lane(0, slice(0, n - KEY + 1), slice(KEY, n + 1))
    best = _window_min((hashed * SPREAD & HIGH) | np.arange(n - KEY + 1, dtype=U), LENGTH - KEY + 1)
    chosen = best & PLACE
    # Starts whose string lies inside one text.
    long = np.flatnonzero(sizes >= LENGTH)
    edge = np.zeros(n + 1, np.int8)
    edge[at[long]] += 1
    edge[at[long + 1] - LENGTH + 1] -= 1
    fits = np.cumsum(edge[: len(chosen)], dtype=np.int8).view(bool)
    head, last = fits.copy(), fits.copy()
    other = chosen[1:] != chosen[:-1]
    head[1:] &= ~fits[:-1] | other
    last[:-1] &= ~fits[1:] | other
    first, final = np.flatnonzero(head), np.flatnonzero(last)
    number = np.searchsorted(at, first, "right") - 1
    place = chosen[first].astype(np.int64)
    hashes = sums.substring(place, place + KEY), sums.substring(first, final + LENGTH), others.substring(first, final + LENGTH)
    return number, first - at[number], final - first + 1, *hashes


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the stretches of their texts instead of the texts."""
    for batch in pieces(batches, "text", PIECE):
        data, at = flat(batch.column("text"))
        if batch.num_rows > 1:
            found = [_stretches(data, at)]
        else:
            found = [_one(data, begin) for begin in range(0, max(1, len(data) - LENGTH + 1), PIECE)]
        number, first, n, *hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = [pa.array(first, pa.int32()), pa.array(n, pa.int32()), *(pa.array(h.view(np.int64)) for h in hashes)]
        rows = pa.StructArray.from_arrays(rows, fields=list(STRETCH))
        ends = pa.array(np.searchsorted(number, np.arange(batch.num_rows + 1)), pa.int32())
        counts = pa.array(np.bincount(number, minlength=batch.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "th")), counts, pa.ListArray.from_arrays(ends, rows)], ["row", "doc_id", "th", "n_stretches", "stretches"])


def _one(data: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """The stretches of the PIECE starts of one text from ``begin`` on."""
    part = data[begin : begin + PIECE + LENGTH - 1]
    number, first, *more = _stretches(part, np.array([0, len(part)]))
    return number, first + begin, *more


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    ends = np.arange(len(starts))[-1:]
    return starts[np.concatenate([ends * 0, cut + 1])], starts[np.concatenate([cut, ends])]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans in order, with those that touch or overlap made one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else order
    return start[fresh], end[np.concatenate([fresh[1:], [len(start)]]) - 1] if len(start) else end


def _fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of a list<struct> column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values
    return ends, {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}


def _open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each open stretch that is to be sorted, with its bytes; those of
    keys with too many different stretches give a row for each of their strings."""
    done = None
    for batch in pieces(batches, "text", 2 << 20):
        data, at = flat(batch.column("text"))
        ends, x = _fields(batch.column("open"))
        for k, row in enumerate(batch.column("row").to_pylist()):
            if row == done:  # equal rows meet one after the other
                continue
            done = row
            some = np.arange(ends[k], ends[k + 1])
            yield from _parts(row, data[at[k] : at[k + 1]], {name: v[some] for name, v in x.items()})


def _parts(row: int, text: np.ndarray, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    raw = text.tobytes()
    chosen = np.flatnonzero(x["sort"])
    stop = x["first"] + x["n"] - 1 + LENGTH
    for at in range(0, len(chosen), 4096):
        some = chosen[at : at + 4096]
        parts = [raw[a:b] for a, b in zip(x["first"][some].tolist(), stop[some].tolist(), strict=True)]
        none = pa.nulls(len(some), pa.int64())
        columns = [np.full(len(some), row), *(x[c][some] for c in (*SAME, "first", "copies"))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, PARTS, strict=False)), pa.array(parts, pa.binary()), none, none], schema=PARTS)
    for k in np.flatnonzero(~x["sort"]).tolist():
        first, n = int(x["first"][k]), int(x["n"][k])
        part, start = text[first : first + n - 1 + LENGTH], np.arange(n)
        h, g = (Prefix(part, kind).substring(start, start + LENGTH) for kind in (0, 1))
        columns = [np.full(n, row), *(np.full(n, x[c][k]) for c in SAME), first + start, np.full(n, x["copies"][k])]
        hashes = [pa.array(h.view(np.int64)), pa.array(g.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, PARTS, strict=False)), pa.nulls(n, pa.binary()), *hashes], schema=PARTS)


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in the order of SAME; whole keys go to a shard of about
    SHARD_BYTES. For those that occur once: the row and spans of repeated strings."""

    def shard(held: list[tuple]) -> pa.RecordBatch:
        row, first, copies = (np.array(x) for x in zip(*(r[3:6] for r in held), strict=True))
        found = repeated_starts([r[6] for r in held], copies, LENGTH)
        out = [(k, *runs(x)) for k, x in enumerate(found) if len(x) and copies[k] == 1]
        spans = [[{"start": a, "end": b} for a, b in zip((first[k] + low).tolist(), (first[k] + high + LENGTH).tolist(), strict=True)] for k, low, high in out]
        return pa.RecordBatch.from_arrays([pa.array([int(row[k]) for k, *_ in out], pa.int64()), pa.array(spans, pa.list_(SPAN))], ["row", "more"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in (*SAME, "row", "first", "copies", "part")), strict=True):
            if held and x[:3] == held[-1][:3] and x[6] == held[-1][6]:
                continue
            if size >= SHARD_BYTES and x[0] != held[-1][0]:
                yield shard(held)
                held, size = [], 0
            held.append(x)
            size += len(x[6])
    if held:
        yield shard(held)


class _Results:
    """The given columns with what is removed of the text and what is left."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            data, at = flat(batch.column("text"))
            ends, x = _fields(batch.column("spans"))
            sizes, starts, stops, sha, left = np.diff(at), [], [], [], []
            for k in range(batch.num_rows):
                start, end = merged(x["start"][ends[k] : ends[k + 1]], x["end"][ends[k] : ends[k + 1]])
                raw = data[at[k] : at[k + 1]].tobytes()
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                starts.append(start)
                stops.append(end)
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            offsets = pa.array(np.cumsum([0, *map(len, starts)]), pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(v), pa.int32()) for v in (starts, stops)], fields=list(SPAN))
            found = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.array(sha, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in self.columns), *found], [*self.columns, "n_bytes", "removed", "kept_sha256", "kept"])


def _total(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def _marks(listed: DataFrame) -> DataFrame:
    """(row, spans, open) of the rows with repeated keys: spans of stretches that
    occur more than once, and the stretches to be looked into."""
    each = listed.select("row", F.inline("stretches"))
    again = listed.select(F.explode("stretches.key").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    spread = F.xxhash64("row", "first")
    repeated = saved(salted_join(each, again, "key", "_n", _total(listed, "n_stretches"), spread), "suffix-repeated")
    n_repeated = repeated.count()

    kinds = repeated.groupBy(*SAME).agg(F.count("*").alias("copies"), F.min(F.struct("row", "first")).alias("head"))
    per_key = kinds.groupBy("key").agg(F.count("*").alias("different"))
    kinds = salted_join(kinds, per_key.withColumn("_n", F.col("different")), "key", "_n", n_repeated, F.col("digest"))
    kinds = saved(kinds.withColumn("_n", F.col("copies")), "suffix-kinds")

    marked = salted_join(repeated, kinds, SAME, "_n", n_repeated, spread)
    whole = F.when(F.col("copies") > 1, F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("end")))
    # Of equal stretches one is looked into, for the strings it shares with others.
    # A key with one stretch only is done: its copies are equal throughout.
    is_head = F.col("head") == F.struct("row", "first")
    sort = (F.col("different") <= MOST_STRETCHES).alias("sort")
    open_one = F.when((F.col("different") > 1) & ((F.col("copies") == 1) | is_head), F.struct(*SAME, "first", "n", "copies", sort))
    return saved(marked.groupBy("row").agg(F.collect_list(whole).alias("spans"), F.collect_list(open_one).alias("open")), "suffix-marks")


def _inner_repeats(parts: DataFrame) -> DataFrame:
    """(row, more): spans of strings that repeat in stretches which occur once."""
    shards = parts.filter("part is not null").repartition("key").sortWithinPartitions(*SAME)
    from_sorting = shards.mapInArrow(_sorted_shards, f"row long, more {SPANS_SQL}")
    strings = parts.filter("part is null").dropDuplicates(["row", "first"]).select("row", "first", "copies", "h", "g")
    twice = strings.groupBy("h", "g").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = salted_join(strings, twice, ["h", "g"], "_n", strings.count(), F.xxhash64("row", "first")).filter("copies = 1")
    from_counts = met.select("row", F.array(F.struct(F.col("first").alias("start"), (F.col("first") + LENGTH).alias("end"))).alias("more"))
    return from_sorting.unionByName(from_counts).groupBy("row").agg(F.flatten(F.collect_list("more")).alias("more"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (spans of byte
    offsets, sorted, maximal), kept_sha256; ``with_text`` gives ``kept`` (binary)
    as well, and instead of doc_id a struct ``row`` of all columns but the text.

    Every byte is removed that a 200-byte string covers which also starts
    anywhere else in the texts as they are given, in the same or another row.
    Matches stay within a text. Null text is empty. Repeated rows are each
    other's copies, so both lose all they have in 200-byte strings; rows that
    share a doc_id, or have none, are told apart by 128 bits of their text's
    SHA-256. An empty table gives no rows. Long texts are hashed in pieces.
    """
    rest = [F.struct(*[c for c in docs.columns if c != "text"]).alias("row")] if with_text else []
    text = F.coalesce("text", F.lit(""))
    th = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    docs = docs.select("doc_id", text.alias("text"), th.alias("th"), *rest)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, th binary, n_stretches long, stretches array<{STRETCH_SQL}>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "th", "text")
    listed = saved(numbered.mapInArrow(_listed, schema), "suffix-stretches")
    ids = listed.select("row", F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"))
    mine = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))

    marks = _marks(listed)
    opened = marks.filter(F.size("open") > 0).select("row", "open").join(ids, "row").withColumnRenamed("row", "_row")
    texts = docs.select("doc_id", "th", "text").join(opened, mine).select(F.col("_row").alias("row"), "open", "text")
    parts = saved(texts.mapInArrow(_open_texts, PARTS_SQL), "suffix-parts")

    spans = marks.select("row", "spans").join(_inner_repeats(parts), "row", "left")
    spans = spans.withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast(SPANS_SQL)))).drop("more")
    # Equal rows have equal spans, so any of them will do.
    per_doc = spans.join(ids, "row").groupBy("_doc_id", "_th").agg(F.min_by("spans", "row").alias("spans"))
    joined = docs.join(per_doc, mine, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS_SQL)))
    columns = ["row"] if with_text else ["doc_id"]
    given = docs.select(*columns).schema.simpleString()[len("struct<") : -1]
    out = joined.select(*columns, "text", "spans").mapInArrow(_Results(columns), f"{given}, n_bytes long, removed {SPANS_SQL}, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated bytes cut out of ``text``; n_chars follows
    where the table has it. A character that a cut splits goes as a whole."""
    out = remove_repeats(docs, with_text=True)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    mended = F.coalesce(text, F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": mended}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(mended).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
