"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
the maximum of each filter over a window feeds a softmax layer. The network is
trained in numpy on a bounded sample of labelled texts, and applied to all
windows of every whole text in batches. For prediction, embedding and filters
fold into lookup tables of byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bytehash import flat, mix, pieces
from cairnlake.llm.common import table, unused

WINDOW = 384
WIDTHS = (2, 3, 4, 5)
EMBEDDING, FILTERS = 8, 16
#: At most so many labelled texts are learned from, in equal parts by language,
#: with so many windows of each.
SAMPLE_TEXTS, WINDOWS_A_TEXT = 4096, 3
UNKNOWN = "und"
#: Below this score the pipeline does not trust a prediction.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: list[np.ndarray]
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam on the cross entropy, languages weighted alike."""
    rng = np.random.default_rng(seed)
    n_all = len(WIDTHS) * FILTERS
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "w": rng.normal(0, 0.1, (n_all, len(languages))), "o": np.zeros(len(languages))}
    for k, w in enumerate(WIDTHS):
        p[f"f{k}"], p[f"b{k}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    share = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
            rows = np.arange(len(x))
            pooled, places = [], []
            for k, w in enumerate(WIDTHS):
                length = WINDOW - w + 1
                conv = sum((p["e"] @ p[f"f{k}"][j])[x[:, j : j + length]] for j in range(w))
                where = conv.argmax(1)
                places.append(where)
                pooled.append(np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + p[f"b{k}"])
            h = np.concatenate(pooled, 1)
            on = np.maximum(h, 0)
            prob = softmax(on @ p["w"] + p["o"])
            prob[rows, y] -= 1
            dz = prob * share[y][:, None] / len(x)
            g = {"w": on.T @ dz, "o": dz.sum(0), "e": np.zeros_like(p["e"])}
            dh = (dz @ p["w"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                g[f"b{k}"], g[f"f{k}"] = d.sum(0), np.zeros_like(p[f"f{k}"])
                for j in range(w):
                    symbol = x[rows[:, None], places[k] + j]  # batch x FILTERS
                    g[f"f{k}"][j] = np.einsum("bfe,bf->ef", p["e"][symbol], d)
                    np.add.at(g["e"], symbol, d[:, :, None] * p[f"f{k}"][j].T[None])
            step += 1
            for key, grad in g.items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad**2
                p[key] = (p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["e"], [p[f"f{k}"] for k in range(len(WIDTHS))], [p[f"b{k}"] for k in range(len(WIDTHS))], p["w"], p["o"])


class Tables:
    """The network's filters as tables of byte pairs (and of single bytes)."""

    def __init__(self, net: Network) -> None:
        self.net, self.parts = net, []
        for f in net.filters:
            single = [net.embedding @ f[j] for j in range(len(f))]
            some = [(j, 2, (single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, len(f) - 1, 2)]
            if len(f) % 2:
                some.append((len(f) - 1, 1, single[-1]))
            self.parts.append(some)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), 256):
            x = windows[at : at + 256]
            pair = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            pooled = []
            for some, bias, w in zip(self.parts, self.net.bias, WIDTHS, strict=True):
                length = WINDOW - w + 1
                conv = None
                for j, size, values in some:
                    got = np.take(values, (pair if size == 2 else x)[:, j : j + length], axis=0)
                    conv = got if conv is None else np.add(conv, got, out=conv)
                pooled.append(conv.max(1) + bias)
            out.append(softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.net.weights + self.net.offset))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))


def counted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number in the text) of each window: windows of WINDOW bytes cover every text."""
    counts = -(-np.diff(at) // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)


def cut(data: np.ndarray, at: np.ndarray, text: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The bytes of those windows; the last one of a text ends with it, and a
    shorter text is filled up with zeros."""
    inside = np.minimum(number * WINDOW, np.maximum(np.diff(at)[text] - WINDOW, 0))
    place = at[text][:, None] + inside[:, None] + np.arange(WINDOW)
    beyond = place >= at[text + 1][:, None]
    windows = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else np.zeros((0, WINDOW), np.uint8)
    windows[beyond] = 0
    return windows


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS_A_TEXT windows from all over each text."""
    for batch in pieces(batches, "text"):
        data, at = flat(batch.column("text"))
        text, number = counted(at)
        order = np.lexsort((mix(number.astype(np.uint64)), text))
        first = np.searchsorted(text[order], text[order])
        chosen = order[np.arange(len(order)) - first < WINDOWS_A_TEXT]
        windows = cut(data, at, text[chosen], number[chosen])
        rows = batch.select(["lang", "draw"]).take(pa.array(text[chosen]))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([w.tobytes() for w in windows], pa.binary())], ["lang", "draw", "window"])


class _Predict:
    def __init__(self, net: Network) -> None:
        self.net = net

    def told(self, batches: Iterator[pa.RecordBatch], letters: str = "letters") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The batches, in pieces, with the language and score of each text."""
        tables, names = Tables(self.net), np.array(self.net.languages)
        for batch in pieces(batches, "text"):
            data, at = flat(batch.column(batch.schema.get_field_index("text")))
            text, number = counted(at)
            total = np.zeros((batch.num_rows, len(names)))
            for k in range(0, len(text), 4096):
                some = text[k : k + 4096]
                np.add.at(total, some, tables.probabilities(cut(data, at, some, number[k : k + 4096])))
            mean = total / np.maximum(np.bincount(text, minlength=batch.num_rows), 1)[:, None]
            known = batch.column(batch.schema.get_field_index(letters)).to_numpy(zero_copy_only=False).astype(bool)
            best = mean.argmax(1)
            lang = np.where(known, names[best], UNKNOWN)
            score = np.where(known, mean[np.arange(len(best)), best], 0.0)
            yield batch, lang, score

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, score in self.told(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


class _Sure(_Predict):
    """The rows, as they are, whose language is told with the least score."""

    def __init__(self, net: Network, least_score: float, letters: str) -> None:
        super().__init__(net)
        self.least_score, self.letters = least_score, letters

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, score in self.told(batches, self.letters):
            rest = batch.select([c for c in batch.schema.names if c != self.letters])
            yield rest.filter(pa.array((lang != UNKNOWN) & (score >= self.least_score)))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Network | None:
    """The network for the labelled texts that aren't held out; None without any.

    Each language has an equal part of ``sample_texts``; where it has more texts,
    a share of them by a hash of doc_id and text, and of all drawn the first
    ``sample_texts`` times ``WINDOWS_A_TEXT`` windows. So what reaches the driver
    is bounded, whatever repeats, and however many languages there are: of more
    languages than ``sample_texts`` the most frequent are learned.
    """
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id")))
    # The most frequent languages, so what is broadcast has no more rows than the sample.
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(sample_texts)
    n_langs = counts.count()
    if not n_langs:
        return None
    share = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(1.2 * sample_texts / n_langs) / F.col("_n")).alias("_share"))
    drawn = labelled.withColumn("draw", F.xxhash64(F.lit(41), "doc_id", "text")).join(F.broadcast(share), F.col("lang") == F.col("_lang"))
    drawn = drawn.filter(F.pmod("draw", F.lit(1 << 30)) < F.col("_share") * float(1 << 30)).select("text", "lang", "draw")
    rows = drawn.mapInArrow(_learned, "lang string, draw long, window binary").orderBy("draw", "window").limit(sample_texts * WINDOWS_A_TEXT).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("window", "ascending")])
    if not rows.num_rows:
        return None
    windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {x: k for k, x in enumerate(languages)}
    return train(windows, np.array([number[x] for x in names]), languages)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    The score is the mean probability over the text's windows. Null texts and
    such without a letter are ``und`` with score 0, and so is every text where
    nothing could be learned. A null doc_id counts as not held out. Equal texts
    get equal predictions, also in rows that share a doc_id or have none. An empty
    table gives no rows; other columns are not read. Of long texts some thousand
    windows are held at a time.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letters(F.col("text")).alias("letters"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_Predict(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told with ``least_score`` or more, with all
    columns. Every row is judged by its own text, also where rows share a doc_id
    or have none; where nothing could be learned none stays."""
    net, letters = learn(docs), unused(docs, "_letters")
    if net is None:
        return docs.filter(F.lit(False))
    return docs.withColumn(letters, has_letters(F.col("text"))).mapInArrow(_Sure(net, least_score, letters), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
