"""Periodic runs of words, by Lyndon arrays on ordered alphabets.

Words become numbers, whose order is the alphabet's. For each order, the
numbers' own and the reverse, the next smaller suffix of every position is
looked up from right to left; it ends the longest Lyndon word there, and the
root of every run is such a word in one of the two. How far two suffixes agree
is found by comparing words until they meet a pair whose agreement is known
already, which is then reused. There are no suffix arrays or trees, no
fingerprints, and every equality is one of words.

Before that, what can't lie in a run of the exponent asked for is cut away: in
such a run every word occurs that many times, so a word which occurs less often
between two cuts is a cut itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlake.llm.bytehash import NO_SPACE, flat, pieces, segments, word_bounds
from cairnlake.llm.common import table, unused

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SQL = "array<struct<start:long,length:long,period:long>>"


def word_numbers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, starts, ends, first) of the words of texts: equal words of a
    batch, and no others, share a number. Those of text d are first[d]:first[d + 1]."""
    known: dict[bytes, int] = {}
    found = []
    for begin, stop in segments(data, NO_SPACE):
        part = data[begin:stop]
        starts, ends, _ = word_bounds(part, np.clip(at - begin, 0, len(part)), NO_SPACE)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        dense = part[NO_SPACE[part]]
        listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(dense)])
        coded = listed.dictionary_encode()
        number = np.array([known.setdefault(word, len(known)) for word in coded.dictionary.to_pylist()], np.int32)
        found.append((number[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32), starts + begin, ends + begin))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    numbers, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return numbers, starts, ends, np.searchsorted(starts, at)


def stretches(numbers: np.ndarray, first: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches in which every word occurs ``times`` times at least."""
    place = np.arange(len(numbers))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    while len(place):
        # A stretch is one of places that follow each other in one text.
        fresh = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(owner) > 0)])
        stretch = np.cumsum(fresh)
        code = stretch * (int(numbers.max()) + 1) + numbers[place]
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
        counts = np.diff(np.concatenate([heads, [len(code)]]))
        enough = np.empty(len(code), bool)
        enough[order] = np.repeat(counts >= times, counts)
        if enough.all():
            begins = np.flatnonzero(fresh)
            return place[begins], place[np.concatenate([begins[1:], [len(place)]]) - 1] + 1
        place, owner = place[enough], owner[enough]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def next_smaller(t: list[int]) -> tuple[list[int], list[int]]:
    """(next, agree): the next position whose suffix is smaller (the end, which is
    smaller than all, if none is), and on how many places the two agree."""
    n = len(t)
    following, agree = [n] * (n + 1), [0] * (n + 1)
    # The nearest smaller suffix on the left, where one is known, and the agreement.
    left, left_agree = [-1] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, k = i + 1, 0
        while True:
            # t[i:] and t[j:] agree on k places at least.
            a, b = i + k, j + k
            while b < n and t[a] == t[b]:
                a += 1
                b += 1
                if following[a] == b:
                    b += agree[a]
                    break
                if left[b] == a:
                    b += left_agree[b]
                    break
            k = b - j
            if b >= n or t[i + k] > t[b]:
                following[i], agree[i] = j, k
                break
            left[j], left_agree[j] = i, k
            onward, m = following[j], agree[j]
            # t[i:] is smaller than t[j:]; what j and its next agree on is known.
            while k < m:
                left[onward], left_agree[onward] = i, k
                onward, m = following[onward], agree[onward]
            j = onward
            if k > m:
                following[i], agree[i] = j, m
                break
            # They agree on the same number of places, so the next may go on from there.
    return following, agree


def all_runs(t: list[int], least_length: int = 2, least_exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal periodic runs of at least so many
    places and periods, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    n = len(t)
    for order in (t, [-x for x in t]):
        following, agree = next_smaller(order)
        # Roots of one run share its period and its end: only the first is looked at.
        last: dict[tuple[int, int], int] = {}
        for i in range(n):
            j = following[i]
            if j >= n:
                continue
            p, end = j - i, j + agree[i]
            # To the left of its first root a run has less than a period.
            if end - i + p - 1 < max(least_length, least_exponent * p) or (p, end) in last:
                continue
            last[p, end] = i
            start = i
            while start and order[start - 1] == order[start - 1 + p]:
                start -= 1
            if end - start >= max(least_length, least_exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> Iterator[bytes]:
    """The kept words with a blank behind each, some at a time."""
    for at in range(0, len(kept), 1 << 18):
        some = kept[at : at + (1 << 18)]
        sizes = ends[some] - starts[some]
        to = np.cumsum(sizes + 1) - sizes - 1
        out = np.full(int(sizes.sum()) + len(some), 0x20, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(to, sizes) + inside] = data[np.repeat(starts[some], sizes) + inside]
        yield out.tobytes()


class _Runs:
    """The rows with the runs of their texts and what is left without repeats."""

    def __init__(self, least_length: int, least_exponent: int, names: tuple[str, str, str]) -> None:
        self.least_length, self.least_exponent, self.names = least_length, least_exponent, list(names)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, at = flat(batch.column("text"))
            numbers, starts, ends, first = word_numbers(data, at)
            begins, stops = stretches(numbers, first, self.least_exponent)
            runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            dropped = np.zeros(len(numbers) + 1, np.int64)
            for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
                if b - a < self.least_length:
                    continue
                text = int(np.searchsorted(first, a, "right")) - 1
                for start, length, period in all_runs(numbers[a:b].tolist(), self.least_length, self.least_exponent):
                    runs[text].append({"start": a - int(first[text]) + start, "length": length, "period": period})
                    dropped[a + start + period] += 1
                    dropped[a + start + length] -= 1
            keep = np.cumsum(dropped[:-1]) == 0
            left = []
            for d in range(batch.num_rows):
                kept = first[d] + np.flatnonzero(keep[first[d] : first[d + 1]])
                left.append(b"".join(collapsed(data, starts, ends, kept))[:-1].decode())
            counts = pa.array(np.diff(first), pa.int64())
            columns = [c for c in batch.schema.names if c != "text"]
            found = [counts, pa.array(runs, pa.list_(RUN)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, *self.names])


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of ``docs``: all its columns but ``text``, and n_words,
    runs (start, length, period, by start, then period; words count from 0) and
    collapsed (what is left without the repeats, joined by single blanks). These
    are named otherwise where ``docs`` has such names.

    Words are runs without ASCII space. A run is a stretch of words with smallest
    period q (words q apart are the same), of at least ``least_length`` words and
    ``least_exponent`` (two or more) periods, that can't be made longer. Of each
    run what comes after its first q words is dropped. Null, empty and blank texts
    have no words and no runs, and collapse to the empty text. Repeated rows get
    equal results, an empty table gives no rows. A text of any length is one row
    of one task; words and their places take some 25 bytes a word there.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    given = docs.drop("text")
    names = tuple(unused(given, stem) for stem in ("n_words", "runs", "collapsed"))
    found = StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` {RUNS_SQL}, `{names[2]}` string")
    schema = StructType([*given.schema.fields, *found.fields])
    return docs.mapInArrow(_Runs(least_length, least_exponent, names), schema)


def without_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with the texts that have a run collapsed; other texts stay as they are."""
    flagged, key = docs.withColumn(unused(docs, "_given"), F.col("text")), unused(docs, "_given")
    out = periodic_runs(flagged, least_length, least_exponent)
    n_words, runs, left = out.columns[-3:]
    text = F.when(F.size(runs) > 0, F.col(left)).otherwise(F.col(key)).alias("text")
    return out.select(*[text if c == "text" else F.col(c) for c in docs.columns])


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows; the words of one text in ten become periodic from some word on."""
    for batch in pieces(batches, "text", 2 << 20):
        texts = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = zlib.crc32(str(doc_id).encode())
            if doc_id is None or h % 10:
                texts.append(text.as_py())
                continue
            raw, at = flat(pa.array([text.as_py()], pa.large_string()))
            starts, ends, _ = word_bounds(raw, at, NO_SPACE)
            if not (n := len(starts)):
                texts.append(text.as_py())
                continue
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            whole, rest = divmod(n - a, p)
            data = raw.tobytes()
            period = data[starts[a] : ends[a + p - 1]] + b" " if whole else b""
            tail = data[starts[a] : ends[a + rest - 1]] if rest else b""
            texts.append((data[: starts[a]] + period * whole + tail).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length over period; the first of those that tie."""
    ahead = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast(RUNS_SQL[len("array<") : -1])
    return F.aggregate(runs, none, lambda best, x: F.when(ahead(best, x), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.mapInArrow(_planted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
    listed = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = F.col("best")
    return periodic_runs(planted).withColumn("best", longest_exponent(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
