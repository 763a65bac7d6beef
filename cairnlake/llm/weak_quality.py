"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text. Votes are counted
by pattern over the whole corpus (a table bounded by the number of labellers);
expectation-maximisation on those counts estimates how each labeller votes on
good and on bad texts, and so the posterior of every pattern. Posteriors label
a bounded sample that trains a hashed linear scorer, which scores every text.
No label of the corpus is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import U, flat, kind_table, mix, pieces, word_hashes
from cairnlake.llm.common import saved, table

BAD, GOOD, ABSTAIN = 0, 1, 2
#: (name, statistic, bad if ..., good if ...): a bound is (sign, value), +1 for above.
LABELLERS = (
    ("symbols", "symbols_per_byte", (1, 0.02), (-1, 0.004)),
    ("lone symbols", "symbol_words", (1, 0.05), (-1, 0.005)),
    ("repetition", "distinct_words", (-1, 0.35), (1, 0.55)),
    ("stutter", "again", (1, 0.20), (-1, 0.02)),
    ("capitals", "upper", (1, 0.50), (-1, 0.15)),
    ("shouting", "loud", (1, 0.20), (-1, 0.02)),
    ("one word", "top_word", (1, 0.30), (-1, 0.15)),
    ("equal lines", "dup_lines", (1, 0.30), (-1, 0.05)),
    ("sentence ends", "ends", (-1, 0.008), (1, 0.05)),
    ("short words", "short_words", (-1, 0.08), (1, 0.20)),
    ("length", "n_words", (-1, 20), (1, 60)),
)
SYMBOL = kind_table(lambda b: chr(b) in "#*$%&|<>~^=_{}[]\\@+")
END = kind_table(lambda b: chr(b) in ".!?")
LOUD = kind_table(lambda b: chr(b) in "!?")
CAPITAL = kind_table(lambda b: 0x41 <= b <= 0x5A)
LETTER = kind_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
BITS = 14
#: At most so many texts train the scorer, each with so many of its features.
SAMPLE_TEXTS, SAMPLE_FEATURES = 8192, 2048
#: Texts whose features are held at once (as rows of 2**BITS numbers).
ROWS = 128
CUTS = 16


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of values[first[d]:first[d + 1]] hold."""
    return np.array([np.count_nonzero(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)


def _runs(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners the number of different keys and the largest count of one."""
    different, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(owner):
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]))
        count = np.diff(np.concatenate([cut, [len(o)]]))
        different = np.bincount(o[cut], minlength=n)
        np.maximum.at(most, o[cut], count)
    return different, most


def statistics(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics by name for each text; word hashes and the text of each word."""
    n, sizes = len(at) - 1, np.maximum(np.diff(at), 1)
    word, starts, ends, first = word_hashes(data, at)
    counts = np.diff(first)
    some = np.maximum(counts, 1)
    text = np.repeat(np.arange(n), counts)
    different, most = _runs(text, word, n)
    # Lines with a word, by their words in order.
    breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
    line = np.flatnonzero(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])])) if len(starts) else np.zeros(0, np.int64)
    place = np.arange(len(word)) - np.repeat(line, np.diff(np.concatenate([line, [len(word)]]))) if len(line) else line
    lines, _ = _runs(text[line], np.add.reduceat(word * (mix(place.astype(U)) | U(1)), line) if len(line) else word, n)
    n_lines = np.bincount(text[line], minlength=n)
    symbol = SYMBOL[data]
    stats = {
        "n_words": counts,
        "symbols_per_byte": _per(symbol, at) / sizes,
        "symbol_words": np.bincount(text, symbol[ends - 1] | symbol[starts], n) / some if len(text) else np.zeros(n),
        "distinct_words": np.minimum(different / np.minimum(some, 200), 1.0),
        "again": np.bincount(text[1:], (word[1:] == word[:-1]) & (text[1:] == text[:-1]), n) / some if len(text) > 1 else np.zeros(n),
        "upper": _per(CAPITAL[data], at) / np.maximum(_per(LETTER[data], at), 1),
        "loud": np.bincount(text, LOUD[data[ends - 1]] & LOUD[data[np.maximum(ends - 2, 0)]], n) / some if len(text) else np.zeros(n),
        "top_word": most / some,
        "dup_lines": (n_lines - lines) / np.maximum(n_lines, 1),
        "ends": np.bincount(text, END[data[ends - 1]], n) / some if len(text) else np.zeros(n),
        "short_words": np.bincount(text, ends - starts <= 3, n) / some if len(text) else np.zeros(n),
    }
    return stats, word, text


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A column per labeller."""
    out = []
    for _, name, (bad_sign, bad), (good_sign, good) in LABELLERS:
        x = stats[name]
        out.append(np.where(bad_sign * x > bad_sign * bad, BAD, np.where(good_sign * x > good_sign * good, GOOD, ABSTAIN)))
    return np.stack(out, 1).astype(np.int64)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of each text with unit length, votes): words, byte
    trigrams and levels of the statistics share 2**BITS places."""
    stats, word, text = statistics(data, at)
    n, size = len(at) - 1, 1 << BITS
    hashed = (mix(word) >> U(64 - BITS)).astype(np.int64)
    x = np.bincount(text * size + hashed, minlength=n * size).reshape(n, size) / np.maximum(stats["n_words"], 1)[:, None]
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for low in range(a, b - 2, 1 << 20):
            part = data[low : min(low + (1 << 20) + 2, b)].astype(U)
            three = part[:-2] << U(16) | part[1:-1] << U(8) | part[2:]
            x[k] += np.bincount((mix(three + U(1 << 40)) >> U(64 - BITS)).astype(np.int64), minlength=size) / (b - a)
    x = np.sqrt(x)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    for k, (_, name, (_, bad), (_, good)) in enumerate(LABELLERS):
        level = np.clip(np.floor((stats[name] - min(bad, good)) / abs(good - bad) * CUTS / 4), -2, CUTS).astype(np.int64) + 2
        place = (mix((level + 100 * k).astype(U) + U(1 << 41)) >> U(64 - BITS)).astype(np.int64)
        x[np.arange(n), place] += 0.5
    return x.astype(np.float32), votes(stats)


@dataclass(frozen=True)
class LabelModel:
    """good: share of good texts; table[k, y, v]: how labeller k votes on texts of class y."""

    good: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        log = np.log([1 - self.good, self.good])[None] + sum(np.log(self.table[k][:, patterns[:, k]]).T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, good: float = 0.8, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from votes that are right more often than not.
    Every vote gets a pseudocount, so an unseen one rules nothing out."""
    n = patterns.shape[1]
    start = np.array([[0.35, 0.4, 0.25], [0.03, 0.7, 0.27]])
    model = LabelModel(good, np.stack([start] * n)) if n else LabelModel(good, np.zeros((0, 2, 3)))
    for _ in range(rounds if len(patterns) else 0):
        p = model.posterior(patterns)
        mass = np.stack([(1 - p) * counts, p * counts])
        votes_of = np.stack([[np.bincount(patterns[:, k], mass[y], 3) for y in (0, 1)] for k in range(n)]) + 0.5
        new = LabelModel(float(np.clip((mass[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99)), votes_of / votes_of.sum(2, keepdims=True))
        if np.abs(new.table - model.table).max() < 1e-7:
            return new
        model = new
    return model


def fit_scorer(x: np.ndarray, posterior: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by stochastic gradients."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    scale = np.full(x.shape[1], 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            error = 1 / (1 + np.exp(-np.clip(x[some] @ w + b, -30, 30))) - posterior[some]
            grad = (error @ x[some] / len(some) + decay * w).astype(np.float32)
            scale += grad * grad
            w -= rate * grad / np.sqrt(scale)
            b -= 0.1 * float(error.mean())
    return w, b


class _Votes:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            stats, _, _ = statistics(*flat(batch.column(1)))
            code = votes(stats) @ (3 ** np.arange(len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.int32())], ["doc_id", "pattern"])


class _Sampled:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18, ROWS):
            x, v = features(*flat(batch.column("text")))
            places = [np.sort(np.argpartition(row, -SAMPLE_FEATURES)[-SAMPLE_FEATURES:]) for row in x]
            places = [p[row[p] > 0] for row, p in zip(x, places, strict=True)]
            amounts = [row[p].tobytes() for row, p in zip(x, places, strict=True)]
            code = pa.array(v @ (3 ** np.arange(len(LABELLERS))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()), pa.array(amounts, pa.binary()), code], ["draw", "places", "amounts", "pattern"])


class _Score:
    def __init__(self, w: np.ndarray, b: float, model: LabelModel, threshold: float) -> None:
        self.w, self.b, self.model, self.threshold = w, b, model, threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18, ROWS):
            data, at = flat(batch.column(1))
            x, v = features(data, at)
            score = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30).astype(np.float64)))
            score = np.where(np.diff(at) > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(self.model.posterior(v)), pa.array(score >= self.threshold)], ["doc_id", "score", "posterior", "kept"])


def score_quality(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score, posterior, kept.

    The score is the scorer's probability of a good text, the posterior that of
    the label model alone. Null and empty texts score 0 and go. Equal texts
    score alike, also in rows that share a doc_id or have none. An empty table
    gives no rows; other columns are not read. Long texts are read in segments.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    seen = saved(docs.mapInArrow(_Votes(), f"doc_id {id_type}, pattern int"), "weak-votes")
    counted = seen.groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in counted], np.int64)
    total = int(sum(r["count"] for r in counted))
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    model = fit_labels(patterns, np.array([r["count"] for r in counted], np.float64))
    # A draw per row, somewhat more than needed, and the first of these; the hash is
    # of the text too, so rows that share an id do not come all or none.
    share = min(1.0, 1.2 * sample_texts / max(total, 1))
    draw = F.xxhash64(F.lit(43), "doc_id", "text")
    drawn = docs.withColumn("draw", draw).filter((F.pmod("draw", F.lit(1 << 30)) < share * float(1 << 30)) & (F.col("text") != ""))
    drawn = drawn.mapInArrow(_Sampled(), "draw long, places binary, amounts binary, pattern int")
    got = drawn.orderBy("draw", "places").limit(sample_texts).collect()
    w, b = np.zeros(1 << BITS, np.float32), 0.0
    if got:
        code = np.array([r["pattern"] for r in got], np.int64)
        y = model.posterior(code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3)
        w, b = fit_scorer(_Rows(got), y)
    return docs.mapInArrow(_Score(w, b, model, threshold), f"doc_id {id_type}, score double, posterior double, kept boolean")


class _Rows:
    """The sample's features, dense for a batch at a time."""

    def __init__(self, rows: list) -> None:
        self.places = [np.frombuffer(r["places"], np.uint16).astype(np.int64) for r in rows]
        self.amounts = [np.frombuffer(r["amounts"], np.float32) for r in rows]
        self.shape = (len(rows), 1 << BITS)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), self.shape[1]), np.float32)
        for k, i in enumerate(some):
            x[k, self.places[i]] = self.amounts[i]
        return x


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
