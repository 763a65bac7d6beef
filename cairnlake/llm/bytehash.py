"""Vectorised hashing of UTF-8 texts inside tasks: words, windows and substrings.

Texts of a batch lie one behind the other in one byte array. A prefix sum of
``table[byte] * base**i`` modulo the prime 2**31 - 1 gives the hash of any
substring in two lookups; two such polynomials with bases of their own make a
hash of 62 bits. ``kind`` 0 and 1 are two hashes that share nothing, so both
together are 124 bits. The modulus is a prime because modulo a power of two
texts of a thousand bytes over two letters can be written down that collide for
every base.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = (1 << 31) - 1
#: Bases of the four polynomials, two for each kind of hash. Each has an order of
#: P - 1 modulo P, so that no short cycle of its powers lines up.
BASES = (1_132_489_760, 715_136_305, 1_083_338_154, 1_433_925_857)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, salt: int) -> np.ndarray:
    """n odd pseudorandom 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=U) + U(salt << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


@lru_cache(4)
def _table(lane: int) -> np.ndarray:
    return constants(256, 7 + lane) % U(P - 1) + U(1)


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**i modulo P for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint32)
        while len(known) < max(n, 1 << 20):
            step = U(pow(base, len(known), P))
            known = np.concatenate([known, (known.astype(U) * step % U(P)).astype(np.uint32)])
        _powers[base] = known
    return known


class Prefix:
    """Prefix sums of both polynomials of a ``kind`` over ``data``."""

    def __init__(self, data: np.ndarray, kind: int = 0) -> None:
        self.n, self.lanes = len(data), (2 * kind, 2 * kind + 1)
        self.sums = [self._sums(data, lane) for lane in self.lanes]

    @staticmethod
    def _sums(data: np.ndarray, lane: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, U)
        terms = _table(lane)[data]
        terms *= _powers_of(BASES[lane], len(data))[: len(data)]
        terms %= U(P)
        np.cumsum(terms, out=out[1:])  # below 2**31 times the length
        return out

    def lane(self, k: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Values of one polynomial (31 bits) for data[start:end]."""
        down = _powers_of(pow(BASES[self.lanes[k]], -1, P), self.n + 1)
        value = (self.sums[k][end] - self.sums[k][start]) % U(P)
        value *= down[: self.n + 1][start]
        value %= U(P)
        return value

    def substring(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        both = self.lane(0, start, end) | (self.lane(1, start, end) << U(31))
        return mix(both + mix(np.asarray(end - start).astype(U)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches: up to ``most`` bytes of ``column`` and so many
    ``rows``, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1), i + rows)
            yield batch.slice(i, j - i)
            i = j


def kind_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Bytes of words [^\x20\x09-\x0D]+
NO_SPACE = kind_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def word_bounds(data: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words are runs of ``kinds`` that do not cross
    texts; those of text d are first[d]:first[d + 1]."""
    inside = kinds[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at[:-1]] = False
    after[: len(data)] = inside
    after[at[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Bytes hashed at once; longer texts go segment by segment.
SEGMENT = 2 << 20


def segments(data: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that no word crosses."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(begin + SEGMENT, n)
        while end < n and kinds[data[end]] and kinds[data[end - 1]]:
            breaks = np.flatnonzero(~kinds[data[end : end + 4096]])
            end = min(end + (int(breaks[0]) if len(breaks) else 4096), n)
        yield begin, end
        begin = end


def word_hashes(data: np.ndarray, at: np.ndarray, kinds: np.ndarray = NO_SPACE, kind: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of each text, as ``word_bounds``."""
    found = []
    for begin, stop in segments(data, kinds):
        part = data[begin:stop]
        starts, ends, _ = word_bounds(part, np.clip(at - begin, 0, len(part)), kinds)
        found.append((Prefix(part, kind).substring(starts, ends), starts + begin, ends + begin))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    hashed, starts, ends = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return hashed, starts, ends, np.searchsorted(starts, at)


def shingles(data: np.ndarray, at: np.ndarray, size: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of the ``size``-word windows of each text; a text
    of fewer words, but not none, has one of all its words."""
    word, _, _, first = word_hashes(data, at, kind=kind)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    by = constants(size, 11 + 12 * kind)
    n = len(word) - size + 1
    if n > 0:
        hashed = word[:n] * by[0]
        for k in range(1, size):
            hashed += word[k : n + k] * by[k]
        whole = text[:n] == text[size - 1 :]
        hashed, owner = mix(hashed[whole]), text[:n][whole]
    else:
        hashed, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = [mix((word[first[d] : first[d + 1]] * by[: counts[d]]).sum(keepdims=True, dtype=U) + U(counts[d])) for d in short]
        hashed, owner = np.concatenate([hashed, *few]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashed, owner = hashed[order], owner[order]
    return hashed, np.searchsorted(owner, np.arange(len(counts) + 1))
