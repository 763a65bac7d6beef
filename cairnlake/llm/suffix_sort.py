"""Suffix arrays of byte strings by induced sorting, as array operations.

Suffixes are classified, leftmost-smaller (LMS) substrings are sorted and named,
their order is found on the reduced string, and the array of all suffixes is
induced from it, bucket by bucket. Inside a bucket entries are handled in waves,
so a step works on arrays, not on single positions. The order is exact to
``DEPTH`` bytes; longer ties fall anyhow.
"""

from __future__ import annotations

import numpy as np

DEPTH = 256


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type)."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    up = np.zeros(n, bool)
    if len(differs):
        rising = t[differs + 1] > t[differs]
        runs = np.diff(np.concatenate([[-1], differs]))
        up[: differs[-1] + 1] = np.repeat(rising, runs)
    return up


def _grouped(ptr: np.ndarray, chars: np.ndarray, step: int) -> np.ndarray:
    """Places for entries in the given order, each in the bucket of its char."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_chars[1:] != sorted_chars[:-1]]))
    counts = np.diff(np.concatenate([first, [len(chars)]]))
    rank = np.arange(len(chars)) - np.repeat(first, counts)
    places = np.empty(len(chars), np.int64)
    places[order] = ptr[sorted_chars] + step * rank
    ptr[sorted_chars[first]] += step * counts
    return places


def induce(t: np.ndarray, up: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the LMS suffixes in the order given."""
    n = len(t)
    sigma = 256 if t.dtype == np.uint8 else int(t.max()) + 1
    all_counts = np.bincount(t, minlength=sigma)
    larger = np.bincount(t[~up], minlength=sigma)
    begin = np.cumsum(all_counts) - all_counts
    split, end = begin + larger, begin + all_counts
    present = np.flatnonzero(all_counts)
    sa = np.full(n, -1, np.int32)
    lms = lms[np.argsort(t[lms], kind="stable")]
    lms_at = np.searchsorted(t[lms], np.arange(sigma + 1))

    ptr = begin.copy()
    sa[ptr[t[n - 1]]] = n - 1
    ptr[t[n - 1]] += 1
    not_up = ~up
    for c in present:
        done = begin[c]
        while done < ptr[c]:
            upto = ptr[c]
            _push(sa, t, ptr, sa[done:upto], not_up, 1)
            done = upto
        _push(sa, t, ptr, lms[lms_at[c] : lms_at[c + 1]], not_up, 1)
    ptr = end - 1
    for c in present[::-1]:
        done = end[c] - 1
        while done > ptr[c]:
            upto = ptr[c]
            _push(sa, t, ptr, sa[upto + 1 : done + 1][::-1], up, -1)
            done = upto
        _push(sa, t, ptr, sa[begin[c] : split[c]][::-1], up, -1)
    return sa


def _push(sa: np.ndarray, t: np.ndarray, ptr: np.ndarray, js: np.ndarray, kind: np.ndarray, step: int) -> None:
    js = js[js > 0] - 1
    js = js[kind[js]]
    if len(js) == 1:
        c = t[js[0]]
        sa[ptr[c]] = js[0]
        ptr[c] += step
    elif len(js):
        sa[_grouped(ptr, t[js], step)] = js


def _names(t: np.ndarray, lms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names of LMS substrings that are given in sorted order: equal ones share one."""
    new = np.ones(len(lms), bool)
    rest = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    new[rest] = False
    a, b, left, k = lms[rest - 1], lms[rest], lengths[rest], 0
    while len(rest):
        differ = t[a + k] != t[b + k]
        new[rest[differ]] = True
        k += 1
        live = ~differ & (left > k)
        rest, a, b, left = rest[live], a[live], b[live], left[live]
    return np.cumsum(new) - 1


def _doubled(rank: np.ndarray, least_length: int = 2) -> np.ndarray:
    """Order of the suffixes of a string of ranks by doubling, to DEPTH bytes;
    only ranks that are still shared are sorted again."""
    n, h = len(rank), 1
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    first = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    while h * least_length < DEPTH:
        tied = ~(first & np.concatenate([first[1:], [True]]))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        sub = np.lexsort((nxt, rank[at]))
        order[slots] = at[sub]
        key_rank, key_next = rank[at][sub], nxt[sub]
        fresh = np.concatenate([[True], (key_rank[1:] != key_rank[:-1]) | (key_next[1:] != key_next[:-1])])
        first[slots] = fresh
        place = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[order[slots]] = place
        h *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a non-empty array of uint8 (or of small ints), in order."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    up = classify(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        draft = induce(t, up, lms)
        ranked = draft[is_lms[draft]]
        number = np.empty(n, np.int32)
        number[lms] = np.arange(len(lms))
        length = np.diff(np.concatenate([lms, [n - 1]])) + 1
        length[-1] = n - lms[-1]  # the last one ends the text and equals no other of its length
        names = _names(t, ranked.astype(np.int64), length[number[ranked]])
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ranked]] = names
        if names[-1] + 1 == len(lms):
            order = number[ranked]
        elif names[-1] < 256 and len(lms) > 4096:
            order = suffix_array(reduced.astype(np.uint8))
        else:
            order = _doubled(reduced)
        lms = lms[order]
    return induce(t, up, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position in text order the length, exact up to ``most``, of the
    prefix its suffix shares with the one before it in ``sa``.

    A value can be one less than its left neighbour's (then it is filled in);
    only the others are compared, eight bytes at a time.
    """
    n, block = len(t), 2048
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    here = np.arange(n)
    derived = np.zeros(n, bool)
    derived[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (phi[:-1] >= 0)
    derived[derived] = t[here[derived] - 1] == t[phi[derived] - 1]
    derived[::block] = False
    heads = np.flatnonzero(~derived)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = t
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    lcp = np.zeros(n, np.int64)
    live = heads[phi[heads] >= 0]
    cap = most + block + 8
    k = 0
    while len(live):
        other = phi[live]
        room = n - np.maximum(live, other) - k
        ok = room > 0
        live, other, room = live[ok], other[ok], room[ok]
        delta = eight[live + k] ^ eight[other + k]
        low = delta & (~delta + np.uint64(1))
        zeros = np.where(delta == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        gained = np.minimum(zeros, room)
        lcp[live] += gained
        k += 8
        live = live[(gained == 8) & (lcp[live] < cap)]
    last = np.maximum.accumulate(np.where(~derived, here, 0))
    return np.maximum(lcp[last] - (here - last), 0)


def repeated_starts(texts: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text the starts of its ``length``-byte strings that start anywhere
    else too, in these texts (which stand for ``copies`` equal ones each)."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not len(t):
        return [np.zeros(0, np.int64) for _ in texts]
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, length)[sa]
    group = np.cumsum(lcp < length)
    whole = sa + length <= (begin + sizes)[owner[sa]]
    weight = np.bincount(group[whole], copies[owner[sa[whole]]].astype(np.float64), group[-1] + 1 if len(group) else 1)
    again = np.zeros(len(t), bool)
    again[sa[whole]] = weight[group[whole]] > 1
    return [np.flatnonzero(again[b : b + s]) for b, s in zip(begin, sizes, strict=True)]
