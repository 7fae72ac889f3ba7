"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths read one-hot bytes, so a filter bank of width w is w tables of 256 rows and a convolution is a
sum of w table look-ups. Max pooling over a window and a softmax layer follow. A text is cut into fixed-length windows
that cover all of it; the mean of the windows' probabilities, weighted by their bytes, is the prediction.

Only training is bounded: it takes at most ``sample`` labelled rows, chosen by hash. Every text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS, BATCH = 256, (2, 3, 4), 8, 64
UNDETERMINED = "und"


@dataclass
class Network:
    """tables: per width a (width, 256, filters) array; bias per width; a softmax layer over all pooled filters."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per width the maxima over positions and where they are; positions past a window's end take no part."""
        out = []
        for table, bias in zip(self.tables, self.bias):
            width, span = len(table), windows.shape[1] - len(table) + 1
            z = table[0].take(windows[:, :span], axis=0, mode="clip")
            for j in range(1, width):
                z += table[j].take(windows[:, j : j + span], axis=0, mode="clip")
            short = np.arange(span)[None, :] > np.maximum(lengths - width, 0)[:, None]
            if short.any():
                z[short] = -1e9
            at = z.argmax(axis=1)
            out.append((np.maximum(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :] + bias, 0), at))
        return out

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = np.concatenate([p for p, _ in self.pooled(windows, lengths)], axis=1) @ self.weights + self.offset
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All of ``data`` in windows of ``size`` bytes, the last one filled with zero bytes; and their lengths."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size), np.minimum(size, np.maximum(0, len(data) - size * np.arange(n)))


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 6, rate: float = 0.01, widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, per_text: int = 4, size: int = WINDOW) -> Network:
    """Train with Adam on up to ``per_text`` windows of each text, spread over it, and on shortened copies, as short texts occur too."""
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    rows, lens, gold = [], [], []
    for text, lang in zip(texts, langs):
        w, n = windows_of(text.encode("utf-8", "surrogatepass"), size)
        for i in rng.permutation(len(w))[:per_text]:
            if n[i]:
                cut = int(rng.integers(12, size)) if rng.random() < 0.4 else size
                row = w[i].copy()
                row[min(cut, n[i]) :] = 0
                rows.append(row)
                lens.append(min(cut, n[i]))
                gold.append(labels.index(lang))
    x, ends, y = np.array(rows or [np.zeros(size, np.uint8)]), np.array(lens or [0]), np.array(gold or [0])
    net = Network(labels, [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths], [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.1, (filters * len(widths), max(1, len(labels)))).astype(np.float32), np.zeros(max(1, len(labels)), np.float32))
    weight = 1 / np.maximum(1, np.bincount(y, minlength=max(1, len(labels))))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    params = [*net.tables, *net.bias, net.weights, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs if len(labels) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            some = order[at : at + 128]
            w, g = x[some], y[some]
            hidden = net.pooled(w, ends[some])
            h = np.concatenate([p for p, _ in hidden], axis=1)
            z = h @ net.weights + net.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(g)), g] -= 1
            p *= (weight[some] / len(g))[:, None]
            back = (p @ net.weights.T) * (h > 0)
            grads_t, grads_b = [], []
            for k, (table, (_, pos)) in enumerate(zip(net.tables, hidden)):
                d = back[:, k * filters : (k + 1) * filters]
                grad = np.zeros_like(table)
                for j in range(len(table)):
                    np.add.at(grad[j], (np.take_along_axis(w, pos + j, axis=1), np.arange(filters)[None, :]), d)
                grads_t.append(grad)
                grads_b.append(d.sum(axis=0))
            step += 1
            for i, (param, grad) in enumerate(zip(params, [*grads_t, *grads_b, h.T @ p, p.sum(axis=0)])):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                param -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000, per_text: int = 4) -> Network:
    """Fit on at most ``sample`` rows with a language and a letter, those with the smallest hashes of id and text.

    Each gives ``per_text`` passages of a window's length from anywhere in its text. A table without usable rows gives a
    network without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).cast("string").alias("i"))
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    share = min(1.0, 2 * sample / max(1, labelled.where(F.col(lang_col).isNotNull()).count()))
    some = rows.where((F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)) & F.col("t").rlike(r"\p{L}"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(per_text - 1)), lambda k: (F.pmod(F.xxhash64("h", k), F.greatest(F.length("t") - WINDOW // 2, F.lit(1))) + 1).cast("int"))
    picked = some.select("h", "i", "l", F.transform(starts, lambda at: F.substring(F.col("t"), at, WINDOW)).alias("w")).orderBy("h", "i", "l").limit(sample).collect()
    return fit([w for r in picked for w in r.w], [r.l for r in picked for _ in r.w], per_text=1)


def judge(network: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each whole text and its mean probability over the text's windows."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        w, n = (np.concatenate([x[i] for x in waiting]) for i in (1, 2))
        p = np.concatenate([network.probabilities(w[i : i + BATCH], n[i : i + BATCH]) for i in range(0, len(w), BATCH)])
        at = 0
        for owner, _, lengths in waiting:
            mean = np.average(p[at : at + len(lengths)], axis=0, weights=np.maximum(lengths, 1))
            names[owner], scores[owner] = network.labels[int(mean.argmax())], min(1.0, float(mean.max()))
            at += len(lengths)
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if network.labels and text and any(map(str.isalpha, text)):
            waiting.append((i, *windows_of(text.encode("utf-8", "surrogatepass"))))
            held += len(waiting[-1][2])
            if held > 32 * BATCH:
                settle()
                held = 0
    if waiting:
        settle()
    return names, scores


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language of the whole text and its mean probability.

    Null text and text without a letter are ``und`` with score 0, as is everything if nothing was learned. Texts of any
    length are read in windows that cover them whole. Repeated rows repeat; null ids are carried along; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(network, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_recognised(docs: DataFrame, network: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is recognised with a score of at least ``least``. Nothing is shuffled.

    Null text and text without a letter go. Repeated rows and null ids are judged by their texts like any; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(network, batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that training never sees: crc32 of the id as text has remainder 1 by 3. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
