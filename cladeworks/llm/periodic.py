"""Runs: stretches of words that repeat with a period, found on a grammar of the text.

Re-Pair over word ids: in each round the pairs that return, and that no overlapping pair outnumbers, become nonterminals.
It goes over many documents at once, since equal pairs of different documents share a nonterminal; a number that occurs
nowhere else stands between documents, so that no pair crosses. A run lies in the expansion of the lowest node of the
derivation that holds it, across the boundary of its two parts. So the runs across the boundary inside a nonterminal are
computed once, on one of its expansions, and translated to all derivation positions; the boundaries between the symbols
that are left are nodes of their own. Intervals of one period that overlap by a period are one run; the longest interval
with the smallest period is the result.

Candidate periods of a boundary come from words alike beside it: a run of period q repeats at least max(q, 12 - q) words
q further on, half of which stand on one side of the boundary, so they are looked up among equal stretches of a length
that grows with q. Extents are measured by comparing stretches of 2^k words, numbered by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one grammar; a longer document has one of its own.
TOGETHER = 300_000
ROUNDS = 64


def pair_up(seq: np.ndarray, pos: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Re-Pair in rounds: the symbols left with their positions, and for each rule its left part, right part and first position.

    ``seq`` holds numbers below ``first_new``; rule r has the number ``first_new + r``. Of overlapping pairs that are
    equal every second one, from the left, is replaced. Rounds end when no pair returns, or after ``ROUNDS``; a grammar
    that could go on is as right as any.
    """
    left, right, where, top = [], [], [], first_new
    alive = np.ones(max(0, len(seq) - 1), bool)
    for _ in range(ROUNDS):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        pairs, number, counts = np.unique(seq[at] * np.int64(top) + seq[at + 1], return_inverse=True, return_counts=True)
        alive[at] = again = counts[number] > 1
        if not again.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((np.arange(len(pairs)), counts))] = np.arange(1, len(pairs) + 1)
        strength = np.zeros(len(seq) + 1, np.int64)
        strength[at] = np.where(again, rank[number], 0)
        own, before, after = strength[:-1], np.concatenate([[0], strength[:-2]]), strength[1:]
        chosen = (own > 0) & (own >= before) & (own >= after)
        # a stretch of equal overlapping pairs: every second one, counted from its first
        twin = np.flatnonzero(chosen & (own == before))
        if len(twin):
            start = np.where(chosen & (own != before), np.arange(len(own)), -1)
            first = np.maximum.accumulate(start)
            ok = (first[twin] >= 0) & ((twin - first[twin]) % 2 == 0)
            chosen[twin[~ok]] = False
        at = np.flatnonzero(chosen)
        rules, one, number = np.unique(seq[at] * np.int64(top) + seq[at + 1], return_index=True, return_inverse=True)
        left.append(seq[at[one]])
        right.append(seq[at[one] + 1])
        where.append(pos[at[one]])
        seq = seq.copy()
        seq[at] = top + number
        top += len(rules)
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        fresh = np.zeros(len(seq), bool)
        fresh[at] = True
        seq, pos, fresh = seq[kept], pos[kept], fresh[kept]
        # a pair of two old symbols that did not return before never will
        old = np.concatenate([alive, [False]])[kept][: len(seq) - 1]
        alive = old | fresh[:-1] | fresh[1:]
    return seq, pos, left, right, where


class Stretches:
    """Numbers of all stretches of 2^k words: equal stretches have equal numbers; those that stand alone have none (-1)."""

    def __init__(self, ids: np.ndarray):
        self.n, self.levels = len(ids), []
        at, number = np.arange(len(ids)), ids
        while len(at):
            names, number, counts = np.unique(number, return_inverse=True, return_counts=True)
            level = np.full(self.n, -1, np.int64)
            level[at] = np.where(counts[number] > 1, number, -1)
            self.levels.append(level)
            width = 1 << (len(self.levels) - 1)
            at = np.flatnonzero((level[: max(0, self.n - width)] >= 0) & (level[width:] >= 0)) if self.n > width else at[:0]
            number = level[at] * np.int64(len(names)) + level[at + width]
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from a on and from b on, ``most`` at most; a is not b."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            while True:
                todo = np.flatnonzero(n + width <= most)
                x = level[a[todo] + n[todo]]
                todo = todo[(x >= 0) & (x == level[b[todo] + n[todo]])]
                n[todo] += width
                if k < len(self.levels) - 1 or not len(todo):
                    break
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree that end before a and before b, ``most`` at most."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            while True:
                todo = np.flatnonzero(n + width <= most)
                x = level[a[todo] - n[todo] - width]
                todo = todo[(x >= 0) & (x == level[b[todo] - n[todo] - width])]
                n[todo] += width
                if k < len(self.levels) - 1 or not len(todo):
                    break
        return n

    def near(self, k: int, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at``, period): equal stretches of 2^k words ``low`` to ``high - 1`` words before or behind."""
        if k >= len(self.levels):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        level = self.levels[k]
        if k not in self.orders:
            repeated = np.flatnonzero(level >= 0)
            key = level[repeated] * np.int64(2 * self.n) + repeated
            self.orders[k] = np.sort(key), repeated
        keys = self.orders[k][0]
        use = np.flatnonzero((at >= 0) & (at < self.n))
        use = use[level[at[use]] >= 0]
        own = level[at[use]] * np.int64(2 * self.n)
        out_i, out_q = [], []
        for lo, hi in ((at[use] + low, at[use] + high), (at[use] - high + 1, at[use] - low + 1)):
            begin, end = (np.searchsorted(keys, own + np.clip(x, 0, 2 * self.n - 1)) for x in (lo, hi))
            many = np.maximum(end - begin, 0)
            which = np.repeat(np.arange(len(use)), many)
            slot = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if many.sum() else np.empty(0, np.int64)
            found = keys[slot] - own[which]
            out_i.append(use[which])
            out_q.append(np.abs(found - at[use[which]]))
        return np.concatenate(out_i), np.concatenate(out_q)


def across(stretches: Stretches, boundary: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which boundary, start, end, period) of intervals in [begin, end) across the boundary, at least max(least, 2 periods) long."""
    parts, low, k = [], 1, 1
    longest = int((end - begin).max(initial=0)) // 2
    while low <= longest:
        high = 8 if low == 1 else 2 * low
        for anchor in (boundary, boundary - (1 << k)):
            i, q = stretches.near(k, anchor, low, high)
            parts.append(np.stack([i, q]))
        low, k = high, k + 1
    if not parts:
        return (np.empty(0, np.int64),) * 4
    i, q = np.concatenate(parts, axis=1)
    seen = np.unique(i * np.int64(2 * stretches.n) + q)
    i, q = seen // (2 * stretches.n), seen % (2 * stretches.n)
    out = []
    for shift in (0, 1):  # the words at the boundary and q further on, or q before it and at it
        a = boundary[i] - shift * q
        b = a + q
        ok = (a >= begin[i]) & (b <= end[i]) & (2 * q <= end[i] - begin[i])
        j, a, b, p = i[ok], a[ok], b[ok], q[ok]
        more, less = stretches.forward(a, b, end[j] - b), stretches.backward(a, b, a - begin[j])
        start, stop = a - less, b + more
        good = (stop - start >= np.maximum(least, 2 * p)) & (start < boundary[j]) & (stop > boundary[j])
        out.append(np.stack([j[good], start[good], stop[good], p[good]]))
    return tuple(np.concatenate(out, axis=1))


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = 12) -> np.ndarray:
    """All runs as rows (start, end, period), in order, for documents laid end to end with a word of its own behind each.

    ``ids`` are the word numbers; ``starts`` the documents' first positions, and a last one behind all.
    """
    stretches = Stretches(ids)
    n_words = int(ids.max(initial=0)) + 1
    seq, pos, left, right, where = pair_up(ids.astype(np.int64), np.arange(len(ids)), n_words)
    size = np.ones(n_words + sum(map(len, left)), np.int64)
    top = n_words
    for a, b in zip(left, right):
        size[top : top + len(a)] = size[a] + size[b]
        top += len(a)
    left_all, right_all, where_all = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right, where))
    # boundaries inside nonterminals, on one expansion each
    rule = np.flatnonzero(size[n_words:] >= least)
    of, start, stop, period = across(stretches, where_all[rule] + size[left_all[rule]], where_all[rule], where_all[rule] + size[n_words + rule], least)
    of, start, stop = rule[of], start - where_all[rule[of]], stop - where_all[rule[of]]
    # all derivation positions of the nonterminals that have such runs, from the top down
    holds = np.zeros(len(size), bool)
    holds[n_words + of] = True
    top = n_words
    for a, b in zip(left, right):
        holds[top : top + len(a)] |= holds[a] | holds[b]
        top += len(a)
    by_rule = np.argsort(of, kind="stable")
    of, start, stop, period = of[by_rule], start[by_rule], stop[by_rule], period[by_rule]
    found = []
    use = holds[seq]
    symbol, at = seq[use], pos[use]
    while len(symbol):
        r = symbol - n_words
        begin, end = np.searchsorted(of, r), np.searchsorted(of, r + 1)
        many = end - begin
        slot = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        base = np.repeat(at, many)
        found.append(np.stack([base + start[slot], base + stop[slot], period[slot]]))
        symbol, at = np.concatenate([left_all[r], right_all[r]]), np.concatenate([at, at + size[left_all[r]]])
        use = holds[symbol]
        symbol, at = symbol[use], at[use]
    # boundaries between the symbols that are left, in their documents
    doc = np.searchsorted(starts, pos[1:], "right") - 1
    inner = pos[1:] > starts[doc]
    doc, boundary = doc[inner], pos[1:][inner]
    _, start, stop, period = across(stretches, boundary, starts[doc], starts[doc + 1], least)
    found.append(np.stack([start, stop, period]))
    start, stop, period = np.concatenate(found, axis=1)
    if not len(start):
        return np.empty((0, 3), np.int64)
    # intervals of a period that overlap by a period are one
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(period * np.int64(2 * len(ids)) + stop) - period * np.int64(2 * len(ids))
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])])
    first = np.flatnonzero(new)
    start, stop, period = start[first], np.maximum.reduceat(stop, first), period[first]
    # measured once more in the document, which decides; of one interval the smallest period stays
    doc = np.searchsorted(starts, start, "right") - 1
    stop = start + period + stretches.forward(start, start + period, starts[doc + 1] - start - period)
    start = start - stretches.backward(start, start + period, start - starts[doc])
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    one = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])
    return np.stack([start[one], stop[one], period[one]], axis=1)


@dataclass
class Batch:
    """Documents whose words share one grammar."""

    words: list[list[bytes]]

    def runs(self, least: int) -> list[np.ndarray]:
        """For each document its runs as rows (start, end, period)."""
        number: dict[bytes, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in self.words]
        starts = np.concatenate([[0], np.cumsum([len(i) + 1 for i in ids])]).astype(np.int64)
        flat = np.concatenate([np.append(own, len(number) + d) for d, own in enumerate(ids)])
        found = runs_of(flat, starts, least)
        owner = np.searchsorted(starts, found[:, 0], "right") - 1
        cut = np.searchsorted(owner, np.arange(len(ids) + 1))
        return [found[cut[d] : cut[d + 1]] - [starts[d], starts[d], 0] for d in range(len(ids))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains behind its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row: its runs by start, then period, and the text with one period of each run left.

    A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 q)`` long (``least`` is 12 or
    more), that no neighbouring word extends. Whole texts are read, of any length; a task holds ``together`` words, or one
    document. Null and empty texts have no word and no run. Repeated rows repeat, null ids are carried along, an empty
    table gives an empty result; other columns are not read, so their names cannot clash. Nothing is shuffled.
    """
    if least < 12:
        raise ValueError("candidate periods are looked up for runs of at least 12 words")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def some(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        runs = Batch(words).runs(least)
        flat = np.concatenate(runs)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
        fields = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], ["start", "length", "period"])
        texts = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, fields).cast(kind), texts], ["doc_id", "n_words", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                own = (text.as_py() or b"").split()
                if words and held + len(own) > together:
                    yield some(ids, words)
                    ids, words, held = [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                words.append(own)
                held += len(own)
        if words:
            yield some(ids, words)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
