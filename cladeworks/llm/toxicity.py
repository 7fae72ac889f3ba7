"""Toxicity by a linear model whose scores must not move when one group is named instead of another.

Features are the words of a text and their beginnings, hashed, with values 1 + ln(count). The logistic loss of the
labelled texts is minimised together with two terms: an L1 norm, which leaves weights only where they pay, so that long
clean texts gather nothing, and costs negative weights more, since other words hardly excuse an insult; and the
counterfactual term. For that, each labelled text that names a group is rewritten with other groups of the same kind, and
with none, and the squared difference of both scores is penalised: weight that only identity terms carry is lost, and
neutral mentions of a group are no longer taken for insults.

Only training is bounded: ``sample`` labelled rows of at most ``longest`` characters. Every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import Tables

WORD = re.compile(r"[^\W\d_]+")
BITS, PREFIXES = 20, (4, 5, 6, 7)

#: Names of groups, by kind. A swap stays within its kind.
IDENTITY_TERMS = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    "believers": ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    "origin": ["african", "american", "arab", "asian", "chinese", "european", "indian", "latino", "mexican", "turkish"],
    "colour": ["black", "white", "brown"],
    "gender": ["woman", "man", "girl", "boy", "female", "male"],
    "genders": ["women", "men", "girls", "boys", "females", "males"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer", "transgender"],
    "state": ["blind", "deaf", "disabled", "elderly", "old", "young", "poor", "immigrant", "refugee"],
    "states": ["immigrants", "refugees", "foreigners", "migrants", "natives"],
}
KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features_of_word(word: str) -> list[int]:
    """The hashed word and its hashed beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask] + [zlib.crc32(f"{word[:n]}^".encode("utf-8", "surrogatepass")) & mask for n in PREFIXES if len(word) >= n]


def features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of a text's words, and their values."""
    counts: dict[int, int] = {}
    for word, times in Counter(words).items():
        for f in features_of_word(word):
            counts[f] = counts.get(f, 0) + times
    found = np.array(sorted(counts), np.int32)
    return found, 1 + np.log([counts[f] for f in found.tolist()])


def swapped(words: list[str], turn: int) -> list[str]:
    """The words with each identity term replaced by the one that stands ``turn`` places on among the terms of its kind.

    A turn of 0 leaves the terms out: were another word put there, it could take the weight along.
    """
    if not turn:
        return [w for w in words if w not in KIND]
    return [terms[(terms.index(w) + turn) % len(terms)] if (terms := IDENTITY_TERMS.get(KIND.get(w, ""))) else w for w in words]


@dataclass
class Model:
    """Weights by hashed feature (those that are not zero), and an offset."""

    weights: dict[int, float]
    offset: float

    def logit(self, counts: dict[int, int]) -> float:
        return self.offset + sum(self.weights[f] * (1 + log(counts[f])) for f in sorted(counts))

    def judge(self, text: str | None, known: dict[str, tuple[int, ...]]) -> float:
        """The logit of a whole text. ``known`` keeps the weighty features of words seen before, up to a bound."""
        counts: dict[int, int] = {}
        for word, times in Counter(words_of(text or "")).items():
            if (own := known.get(word)) is None:
                if len(known) > 200_000:
                    known.clear()
                own = known[word] = tuple(f for f in features_of_word(word) if f in self.weights)
            for f in own:
                counts[f] = counts.get(f, 0) + times
        return self.logit(counts)


class Rows:
    """Sparse rows over ``width`` columns, each given by its columns and their values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        self.cols = np.concatenate([*(c for c, _ in rows), np.empty(0, np.int64)]).astype(np.int64)
        self.values = np.concatenate([*(v for _, v in rows), np.empty(0)])
        self.owner = np.repeat(np.arange(self.n), [len(c) for c, _ in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.cols] * self.values, self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.owner] * self.values, self.width)


def difference(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features in which two texts differ, and by how much."""
    cols = np.union1d(one[0], other[0])
    change = np.zeros(len(cols))
    change[np.searchsorted(cols, one[0])] += one[1]
    change[np.searchsorted(cols, other[0])] -= other[1]
    return cols[change != 0], change[change != 0]


def fit(texts: list[str], toxic: list[int], counterfactual: float = 5.0, sparsity: float = 4e-4, steps: int = 400, turns: int = 3, least_rows: int = 3, columns: int = 4096, excuse: float = 5.0) -> Model:
    """Accelerated proximal gradient on the mean logistic loss, both classes weighing alike, for ``steps`` steps or until nothing moves.

    ``counterfactual`` weighs the squared change of a score under a swap, averaged over the swapped texts; 0 switches it
    off. ``excuse`` is the cost of a negative weight against that of a positive one. Of the features of at least ``least_rows`` texts, the ``columns`` with the steepest loss without any weights
    take part, and so do all that a swap changes. Without texts of both
    classes all weights are zero and the offset is the logit of the share of toxic texts.
    """
    words = [words_of(t) for t in texts]
    found = [features(w) for w in words]
    y = np.array(toxic, float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(share / (1 - share))) if len(y) else -1.0)
    pairs = []
    for own, f in zip(words, found):
        if counterfactual and any(w in KIND for w in own):
            for turn in range(turns + 1):
                if len((change := difference(features(swapped(own, turn)), f))[0]):
                    pairs.append(change)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    seen, at, counts = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True, return_counts=True)
    pull = np.bincount(at, np.repeat(weight * (y - 0.5), [len(c) for c, _ in found]) * np.concatenate([v for _, v in found])) * (counts >= least_rows)
    best = np.argsort(-np.abs(pull), kind="stable")[:columns]
    kept = np.union1d(seen[best[pull[best] != 0]], np.concatenate([p for p, _ in pairs]) if pairs else np.empty(0, np.int32))
    rows = Rows([(np.searchsorted(kept, c[known]), v[known]) for c, v in found for known in [np.isin(c, kept)]], len(kept))
    swaps = Rows([(np.searchsorted(kept, c), v) for c, v in pairs], len(kept))

    def slope(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = rows.times(w) + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        value, grad = float(np.sum(weight * (np.logaddexp(0, z) - y * z))), rows.transposed_times(r)
        if pairs:
            change = swaps.times(w)
            value += counterfactual * float(np.mean(change**2))
            grad = grad + 2 * counterfactual / len(pairs) * swaps.transposed_times(change)
        return value, grad, float(r.sum())

    w, b, rate = np.zeros(len(kept)), 0.0, 1.0
    wm, bm, pace = w, b, 1.0
    for _ in range(steps):
        value, gw, gb = slope(wm, bm)
        while True:
            nw, nb = wm - rate * gw, bm - rate * gb
            nw = np.maximum(nw - rate * sparsity, 0) + np.minimum(nw + rate * sparsity * excuse, 0)
            dw, db = nw - wm, nb - bm
            if slope(nw, nb)[0] <= value + gw @ dw + gb * db + (dw @ dw + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        if max(np.abs(nw - w).max(initial=0), abs(nb - b)) < 1e-5:
            return Model({int(kept[i]): float(nw[i]) for i in np.flatnonzero(nw)}, float(nb))
        if dw @ (nw - w) + db * (nb - b) < 0:  # the momentum leads uphill
            pace = 1.0
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        wm, bm = nw + (pace - 1) / following * (nw - w), nb + (pace - 1) / following * (nb - b)
        w, b, pace, rate = nw, nb, following, rate * 1.1
    return Model({int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, longest: int = 50_000, counterfactual: float = 5.0) -> Model:
    """Fit on at most ``sample`` labelled rows of at most ``longest`` characters, those with the smallest hashes of id and text.

    ``labels``: id, label. Rows without text or label are not used. Half of the sample at most is taken of each class, so
    that rare toxic rows are seen; what one class lacks is not filled from the other. Only ids and hashes meet the labels;
    texts are read again for the rows that were picked, whose list is as small as the sample.
    """
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(F.col(id_col).alias("i"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    tables = Tables(docs.sparkSession)
    known = tables.written(rows.join(marked, "i"), "labelled")  # ids and hashes
    picked = {}
    for y, n in sorted((r.y, r["count"]) for r in known.groupBy("y").count().collect()):
        share = min(1.0, sample / n)  # twice what is taken, so that few rows are left to sort
        some = known.where((F.col("y") == y) & (F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)))
        picked |= {(r.i, r.h): r.y for r in some.orderBy(F.pmod("h", F.lit(1 << 20)), "h", "i").limit(sample // 2).collect()}
    tables.clear()
    if not picked:
        return fit([], [])
    listed = F.broadcast(docs.sparkSession.createDataFrame(list(picked), f"__i {docs.schema[id_col].dataType.simpleString()}, __h long"))  # at most ``sample`` rows
    hashed = docs.select(F.col(id_col).alias("__i"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("__h"), F.col(text_col).alias("__t"))
    texts = sorted({(r["__h"], str(r["__i"]), r["__t"], picked[r["__i"], r["__h"]]) for r in hashed.join(listed, ["__i", "__h"], "left_semi").collect()})
    return fit([t for _, _, t, _ in texts], [y for *_, y in texts], counterfactual)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row: the probability that label 1 holds, and whether it is at least ``least``.

    Whole texts are read, of any length; Null and empty
    text and text without a letter get the score of no features. Repeated rows repeat, null ids are carried along, an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                out[i] = model.judge(text.as_py(), known)
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
