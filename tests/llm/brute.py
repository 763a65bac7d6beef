"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    """{doc_id: (class, links)} of (doc_id, text) rows with different ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, by = Counter(), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    seen = set()
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                        links[a] += 1
                        links[b] += 1
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in sets}


def repeats(rows):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] for (doc_id, text) rows."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def bench_words(text):
    return BENCH_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if (some := windows.get(tuple(words[i : i + m]))) is not None:
                    found |= some
                    hit |= set(range(i, i + m))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), sha, bool(hit)))
    return out


def passages(rows, kinds=("line", "paragraph"), least=25):
    """[(doc_id, number of units, [(start, end) removed])] for rows ranked as given."""
    blank = " \t\n\x0b\x0c\r"

    def cut(text, ends):
        at, out = 0, []
        for m in re.finditer(ends, text):
            out.append((at, m.end()))
            at = m.end()
        return [(a, b, text[a:b].rstrip(blank)) for a, b in [*out, (at, len(text))] if WORD.search(text[a:b])]

    def units(text):
        found = set()
        for kind, ends in (("line", "\n"), ("block", "\n[ \t\x0b\x0c\r]*\n")):
            found |= {(a, a + len(x)) for a, _, x in cut(text, ends) if kind in kinds and len(WORD.findall(x)) >= least}
        sentences = cut(text, "\n|[.!?][ \t\x0b\x0c\r]+") if "paragraph" in kinds else []
        for k, (a, _, _) in enumerate(sentences):
            for e, _, x in sentences[k:]:
                if len(WORD.findall(text[a : e + len(x)])) >= least:
                    found.add((a, e + len(x)))
                    break
        return sorted(found)

    first, out = {}, []
    for k, (d, text) in enumerate(rows):
        some, gone = units(text or ""), bytearray(len(text or ""))
        for a, b in some:
            words = tuple(w.encode().lower() for w in WORD.findall(text[a:b]))
            row, _, end = first.setdefault(words, (k, a, b))
            if first[words] != (k, a, b):
                a = max(a, end) if row == k else a
                gone[a:b] = b"\1" * max(0, b - a)
        edges = [i for i in range(len(gone) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(gone) else 0)]
        out.append((d, len(some), list(zip(edges[::2], edges[1::2], strict=True))))
    return out


def told(net, text, window=384):
    """(language, score) of one text by the network itself: every filter at every place."""
    import numpy as np

    data = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    probs = []
    for k in range(0, len(data), window):
        k = min(k, max(len(data) - window, 0))
        x = net.embedding[np.frombuffer(data[k : k + window].ljust(window, b"\0"), np.uint8)].astype(np.float64)
        pooled = []
        for f, bias in zip(net.filters, net.bias, strict=True):
            w = len(f)
            at = [sum(x[i + j] @ f[j] for j in range(w)) for i in range(window - w + 1)]
            pooled.append(np.max(at, 0) + bias)
        z = np.maximum(np.concatenate(pooled), 0) @ net.weights + net.offset
        probs.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    mean = np.mean(probs, 0)
    return net.languages[int(mean.argmax())], float(mean.max())


def weak_statistics(text):
    """The labellers' statistics of one text, by name."""
    text = text or ""
    data = text.encode()
    words = [w.encode() for w in WORD.findall(text)]
    n = max(len(words), 1)
    lines = [tuple(WORD.findall(x)) for x in text.split("\n") if WORD.search(x)]
    counts = Counter(words)
    symbols, letters = b"#*$%&|<>~^=_{}[]\\@+", sum(65 <= b <= 90 or 97 <= b <= 122 for b in data)
    # A word's last byte and the byte before that, also where the word has one only.
    loud = sum(data[m.end() - 1] in b"!?" and data[max(m.end() - 2, 0)] in b"!?" for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))
    return {
        "n_words": len(words), "symbols_per_byte": sum(b in symbols for b in data) / max(len(data), 1), "symbol_words": sum(w[-1] in symbols or w[0] in symbols for w in words) / n,
        "distinct_words": min(len(counts) / min(n, 200), 1.0), "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "upper": sum(65 <= b <= 90 for b in data) / max(letters, 1),
        "loud": loud / n, "top_word": max(counts.values(), default=0) / n, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "ends": sum(w[-1] in b".!?" for w in words) / n, "short_words": sum(len(w) <= 3 for w in words) / n,
    }


def weak_posteriors(votes, good=0.8, rounds=200):
    """P(good) of each row of votes by expectation-maximisation, row by row."""
    from math import exp, log

    k = len(votes[0])
    table = [[[0.35, 0.4, 0.25], [0.03, 0.7, 0.27]] for _ in range(k)]

    def posterior(v):
        gap = log(1 - good) - log(good) + sum(log(table[j][0][v[j]]) - log(table[j][1][v[j]]) for j in range(k))
        return 1 / (1 + exp(max(-60, min(60, gap))))

    for _ in range(rounds):
        p = [posterior(v) for v in votes]
        new = []
        for j in range(k):
            mass = [[0.5] * 3, [0.5] * 3]
            for v, x in zip(votes, p, strict=True):
                mass[0][v[j]] += 1 - x
                mass[1][v[j]] += x
            new.append([[m / sum(row) for m in row] for row in mass])
        moved = max(abs(a - b) for x, y in zip(new, table, strict=True) for r, q in zip(x, y, strict=True) for a, b in zip(r, q, strict=True))
        good, table = min(0.99, max(0.01, (sum(p) + 1) / (len(p) + 2))), new
        if moved < 1e-7:
            break
    return [posterior(v) for v in votes]
