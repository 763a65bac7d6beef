"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of benchmark words. Strings of one length share a
shift table over blocks of two words: it says how far the search may go on from
a block without passing the end of any string. Where it says zero, a string may
end; the hash of its last block selects a bucket of strings, which are compared
word by word, first on hashes, then on the characters. Stretches of all texts
of a batch are searched side by side, each at its own position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import U, constants, flat, kind_table, mix, pieces, word_hashes
from cairnlake.llm.common import saved, table

WINDOW = 10
#: Benchmark texts that go to the tasks at once; a larger benchmark is searched
#: in blocks of this size, one after the other. Tables take about 7 bytes a byte.
BLOCK_BYTES = 16 << 20

WORD = kind_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: End positions that one stretch of a text has.
STRETCH = 128
#: Candidates, or bytes of words, that are looked at together.
LOT = 1 << 20


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values from first to last - 1 of each range."""
    counts = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(first)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]


def _same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a_start:a_end] and b[b_start:b_end] of each pair are equal."""
    size = (a_end - a_start).astype(np.int64)
    same = size == b_end - b_start
    left = np.flatnonzero(same)
    total = np.cumsum(size[left])
    at = 0
    while at < len(left):
        # Up to LOT bytes at once, one pair at least.
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOT, "right")))
        some, at = left[at:stop], stop
        if len(some) == 1:
            k = some[0]
            same[k] = np.array_equal(a[a_start[k] : a_end[k]], b[b_start[k] : b_end[k]])
            continue
        which, inside = _ranges(np.zeros(len(some), np.int64), size[some])
        differ = a[a_start[some][which] + inside] != b[b_start[some][which] + inside]
        same[some[which[differ]]] = False
    return same


def _exact_numbers(words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that two words share if, and only if, they are equal."""
    _, head, number = np.unique(words, return_index=True, return_inverse=True)
    head = head[number]
    odd = np.flatnonzero(~_same_bytes(data, starts, ends, data, starts[head], ends[head]))
    more: dict[bytes, int] = {}
    for k in odd.tolist():  # words whose hash is that of another word
        number[k] = len(words) + more.setdefault(data[starts[k] : ends[k]].tobytes(), len(more))
    return number


class _Strings:
    """Shift table and buckets of the windows of one length ``m``."""

    def __init__(self, m: int, words: np.ndarray, numbers: np.ndarray, begin: np.ndarray, item: np.ndarray) -> None:
        self.m, self.block = m, min(2, m)
        by = constants(m, 19)
        whole = np.zeros(len(begin), U)
        for k in range(m):
            whole += words[begin + k] * by[k]
        # Equal windows become one, with the numbers of their items. Their hash puts
        # them side by side, their words decide.
        order = np.lexsort((item, whole))
        whole, begin, item = whole[order], begin[order], item[order]
        differ = np.ones(len(whole), bool)
        differ[1:] = whole[1:] != whole[:-1]
        for k in range(m):
            differ[1:] |= numbers[begin[1:] + k] != numbers[begin[:-1] + k]
        fresh = np.flatnonzero(differ)
        ends = np.concatenate([fresh[1:], [len(whole)]])
        last = self.code(words, begin[fresh] + m - 1)
        order = np.argsort(last, kind="stable")
        self.last, self.begin = last[order], begin[fresh][order].astype(np.int32)
        which, place = _ranges(fresh[order], ends[order])
        self.items, self.item_at = item[place].astype(np.int32), np.searchsorted(which, np.arange(len(fresh) + 1))
        bits = int(np.clip(np.ceil(np.log2(8.0 * m * len(fresh) + 1)), 12, 24))
        self.mask = U((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int32)
        for k in range(self.block - 1, m):
            np.minimum.at(self.shift, (self.code(words, begin[fresh] + k) & self.mask).astype(np.int64), m - 1 - k)

    def code(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that end at the words ``end``."""
        return mix(words[end] * U(3) + words[end - 1]) if self.block == 2 else mix(words[end])

    def ends(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The words at which a string may end, by the shift table."""
        text, begin = _ranges(np.zeros(len(first) - 1, np.int64), -(-np.maximum(np.diff(first) - self.m + 1, 0) // STRETCH))
        at = first[text] + self.m - 1 + begin * STRETCH
        stop = np.minimum(at + STRETCH, first[text + 1])
        found = []
        while len(at):
            step = self.shift[(self.code(words, at) & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Tables:
    """Shift tables and buckets for the windows of (item_id, text) rows; items
    without an id are named by the empty string."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.names = ["" if item is None else str(item) for item, _ in items]
        data, at = flat(pa.array([text for _, text in items], pa.large_string()))
        data = LOWER[data]
        self.words, starts, ends, first = word_hashes(data, at, WORD)
        self.data, self.starts, self.ends = data, starts.astype(np.int32), ends.astype(np.int32)
        counts = np.diff(first)
        sizes = np.minimum(counts, window)
        self.strings = []
        numbers = _exact_numbers(self.words, data, starts, ends)
        for m in np.unique(sizes[sizes > 0]).tolist():
            some = np.flatnonzero(sizes == m)
            which, begin = _ranges(first[some], first[some] + counts[some] - m + 1)
            self.strings.append(_Strings(m, self.words, numbers, begin, some[which]))

    def found(self, s: _Strings, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, number of the string) of the occurrences of strings of one
        length, confirmed on their characters, some at a time."""
        end = s.ends(words, first)
        code = s.code(words, end)
        low, high = np.searchsorted(s.last, code), np.searchsorted(s.last, code, "right")
        total = np.cumsum(high - low)
        at = 0
        while at < len(end):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOT, "right")))
            which, k = _ranges(low[at:stop], high[at:stop])
            begin, pattern = end[at:stop][which] - s.m + 1, s.begin[k].astype(np.int64)
            at = stop
            for j in range(s.m):
                same = words[begin + j] == self.words[pattern + j]
                begin, pattern, k = begin[same], pattern[same], k[same]
            for j in range(s.m):
                same = _same_bytes(data, starts[begin + j], ends[begin + j], self.data, self.starts[pattern + j], self.ends[pattern + j])
                begin, pattern, k = begin[same], pattern[same], k[same]
            yield begin, k

    def occurrences(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of words of each text, first and last + 1 of each stretch of words
        that occurrences cover, text and item number of each item found in a text).

        Stretches count words over all texts; none crosses texts, though one may
        end where the next text begins."""
        data = LOWER[data]
        words, starts, ends, first = word_hashes(data, at, WORD)
        edge = np.zeros(len(words) + 1, np.int32)
        pairs = np.zeros(0, np.int64)
        for s in self.strings:
            for begin, k in self.found(s, data, words, starts, ends, first):
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + s.m, -1)
                text = np.searchsorted(first, begin, "right") - 1
                # Each string once a text, before its items are listed.
                once = np.unique(text * len(s.begin) + k)
                which, place = _ranges(s.item_at[once % len(s.begin)], s.item_at[once % len(s.begin) + 1])
                pairs = np.union1d(pairs, (once // len(s.begin))[which] * len(self.names) + s.items[place])
        inside = np.cumsum(edge[:-1], dtype=np.int32) > 0
        opens, closes = inside.copy(), inside.copy()
        # Texts end stretches.
        bounds = first[(first > 0) & (first < len(words))]
        broken = np.zeros(len(words) + 1, bool)
        broken[bounds] = True
        opens[1:] &= ~inside[:-1] | broken[1:-1]
        closes[:-1] &= ~inside[1:] | broken[1:-1]
        items = max(len(self.names), 1)
        return np.diff(first), np.flatnonzero(opens), np.flatnonzero(closes) + 1, pairs // items, pairs % items


HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND_SQL = "n_words long, items array<string>, hits array<struct<start:int,end:int>>"


class _Search:
    """Adds n_words, items and hits to what an earlier block of the benchmark
    found; the last block drops the text."""

    def __init__(self, tables, last: bool) -> None:
        self.tables, self.last = tables, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = self.tables.value
        for batch in pieces(batches, "text"):
            data, at = flat(batch.column("text"))
            counts, opens, closes, texts, numbers = tables.occurrences(data, at)
            first = np.concatenate([[0], np.cumsum(counts)])
            items = [set(x) for x in batch.column("items").to_pylist()]
            for text, number in zip(texts.tolist(), numbers.tolist(), strict=True):
                items[text].add(tables.names[number])
            offsets, starts, ends = _joined(batch.column("hits"), first, opens, closes)
            hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(HITS.value_type)))
            kept = ["doc_id"] if self.last else ["doc_id", "text"]
            known = [pa.array(counts, pa.int64()), pa.array([sorted(x, key=str.encode) for x in items], pa.list_(pa.string())), hits]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *known], [*kept, "n_words", "items", "hits"])


def _joined(known: pa.ListArray, first: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, starts, ends) of the spans of each text: those known from before
    and new stretches, with such as touch or overlap made one."""
    sizes = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat_known = known.flatten()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.concatenate([first[owner] + flat_known.field(0).to_numpy(zero_copy_only=False), opens])
    ends = np.concatenate([first[owner] + flat_known.field(1).to_numpy(zero_copy_only=False), closes])
    text = np.concatenate([owner, np.searchsorted(first, opens, "right") - 1])
    order = np.lexsort((starts, text))
    starts, ends, text = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends, text[order]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] > ends[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(fresh)
    lasts = np.concatenate([heads[1:], [len(starts)]])[: len(heads)] - 1
    text = text[heads]
    return np.searchsorted(text, np.arange(len(sizes) + 1)), starts[heads] - first[text], ends[lasts] - first[text]


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[tuple[Tables, bool]]:
    """Tables for the benchmark's blocks, each with whether it is the last."""
    lined = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = lined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = lined.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Tables([(r["item_id"], r["text"]) for r in rows], window), k == n - 1


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, items (ids of
    benchmark rows with a window in the text, as sorted strings) and hits (word
    spans of the text under windows, merged).

    A-Z count as a-z; words are runs of ``[0-9a-z]`` and of characters beyond
    ASCII. A window is 10 neighbouring words of an item, all its words if it has
    fewer. Null texts have no words; items without words have no window; items
    with a null id are named by the empty string. Rows may repeat, and each is
    searched for itself. An empty table gives no rows, an empty benchmark no hits.
    Other columns are not read. Long texts are hashed in segments.

    The benchmark's size is looked up first. Up to ``block_bytes`` it goes to
    the tasks in one piece. A larger one is searched block by block: each pass
    adds its hits and is written to the shared folder, so only one block's tables
    are held at a time.
    """
    spark = docs.sparkSession
    nothing = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("hits")]
    found = docs.select("doc_id", "text", *nothing)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    for tables, last in _blocks(benchmark, block_bytes, window):
        sent = spark.sparkContext.broadcast(tables)
        found = found.mapInArrow(_Search(sent, last), f"doc_id {id_type}, {'' if last else 'text string, '}{FOUND_SQL}")
        if not last:
            found = saved(found, "benchmark-block")
            sent.unpersist()
    return found


class _Clean:
    """The rows, as they are, whose text has no window."""

    def __init__(self, tables) -> None:
        self.tables = tables

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = self.tables.value
        for batch in pieces(batches, "text"):
            *_, texts, _ = tables.occurrences(*flat(batch.column(batch.schema.get_field_index("text"))))
            clean = np.ones(batch.num_rows, bool)
            clean[texts] = False
            yield batch.filter(pa.array(clean))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with all their columns. Every
    row is judged by its own text, also where rows share a doc_id or have none.

    Windows are those of ``find_benchmark``; what one block of a large benchmark
    leaves is searched for the next. Null and empty texts stay, repeated rows are
    judged alike, an empty table gives no rows, an empty benchmark removes none,
    and columns of any name are kept.
    """
    spark = docs.sparkSession
    for tables, last in _blocks(benchmark, block_bytes, window):
        sent = spark.sparkContext.broadcast(tables)
        docs = docs.mapInArrow(_Clean(sent), docs.schema)
        if not last:
            docs = saved(docs, "benchmark-clean")
            sent.unpersist()
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
