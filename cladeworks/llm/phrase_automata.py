"""Repeated passages: recurring windows of words are confirmed over the corpus, compiled into sharded Aho-Corasick automata, and every document is streamed through an automaton.

Documents are dealt to shards of about ``shard_chars`` characters, and four steps follow.

1. A shard sends the hash of each of its distinct windows once, so a passage that stands in a third of all documents is one
   entry a shard. A window goes to the bucket of its anchor, the least hash among its runs of ``gram`` words, since consecutive windows
   share anchors and travel together. Runs of words that are common in a sample of the texts are no anchors; a window
   that has no other goes to the bucket of its own hash. The sample steers only where a window is counted, never what is found.
2. A bucket confirms the windows that recur, names the smallest document of each, and asks the shard of that document for its words.
3. That shard cuts the passages out of its texts and sends them to every shard that holds them.
4. A shard compiles the windows of its passages, as words and not as hashes, into an automaton, and streams all its
   documents through it. A hit on a window that starts in a smaller document removes the hit's words, and nothing else does.

Hashes only propose: two windows that share the 63 bits and the bucket can hide a repeat behind another one, but no word goes
without a hit on equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeworks.llm.shared import WORD, partitions_for

WIDTH, GRAM, SHARD_CHARS, BUCKET_CHARS, SAMPLED_TEXTS, COMMON_SHARE = 13, 5, 2_000_000, 16_000_000, 2000, 0.01
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: A word is two characters in an automaton, so that no node has many children: one from the first range, one from the second.
_HIGH, _LOW, _BASE, _NONE = 0x10000, 0x1000, 512, ord("-")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, count: int) -> np.ndarray:
    """A hash of every run of ``count`` words; one array shorter by count - 1."""
    out = np.zeros(max(0, len(words) - count + 1), np.uint64)
    for j in range(count):
        out = out * _ODD + words[j : j + len(out)]
    return mixed(out)


class Texts:
    """The documents of one shard in the order of (doc_id, text), their words one after the other."""

    def __init__(self, table: pa.Table):
        ids, texts = (table.column(c).to_pylist() for c in ("doc_id", "text"))
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        self.ids, self.texts = [ids[i] for i in self.order], [texts[i] for i in self.order]
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in self.texts]
        self.starts = np.concatenate(([0], np.cumsum([len(w) for w in self.words], dtype=np.int64))).astype(np.int64)
        # a null id is larger than none and smaller than none: it is no source and loses nothing
        self.id_array = np.array([-(2**63) if i is None else i for i in self.ids], np.int64)

    def hashes(self) -> np.ndarray:
        known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*map(set, self.words))}
        return np.fromiter((known[w] for words in self.words for w in words), np.uint64, int(self.starts[-1]))


def pieces(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """The bytes of ``values`` between consecutive places of ``cut``."""
    data, size = values.tobytes(), values.itemsize
    return [data[a * size : b * size] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def windows_sent(texts: Texts, shard: int, width: int, gram: int, buckets: int, common: np.ndarray) -> pa.Table:
    """A row for each bucket: runs of distinct windows with one bucket, as documents, places, lengths and window hashes.

    The last bit of a window's hash says that a larger document of the shard has the window too.
    """
    flat = texts.hashes()
    owner = np.repeat(np.arange(len(texts.ids)), np.diff(texts.starts))
    windows = run_hashes(flat, width)
    place = np.flatnonzero(owner[: len(windows)] == owner[width - 1 :]) if len(windows) else np.empty(0, np.int64)
    named = np.array([i is not None for i in texts.ids], bool)
    place = place[named[owner[place]]] if len(place) else place
    if not len(place):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 4)], names=["bucket", "shard", "docs", "places", "counts", "tags"])
    hashes, own = windows[place] & ~_ONE, texts.id_array[owner[place]]
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    again = np.zeros(len(first), np.uint64)
    again[which[own > own[first][which]]] = 1
    order = np.argsort(first)
    at, tag, doc = place[first[order]], (hashes[first] | again)[order], own[first[order]]
    grams = run_hashes(flat, gram)
    grams = np.where(np.isin(grams, common), np.uint64(2**64 - 1), grams)
    anchor = grams[at]
    for j in range(1, width - gram + 1):
        anchor = np.minimum(anchor, grams[at + j])
    anchor = np.where(anchor == np.uint64(2**64 - 1), mixed(tag | _ONE), anchor)
    bucket = (mixed(anchor) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, tag, doc, bucket = at[order], tag[order], doc[order], bucket[order]
    starts = np.concatenate(([0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0)) + 1))
    count = np.diff(np.append(starts, len(at)))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[starts])) + 1, [len(starts)]))
    columns = [pieces(doc[starts], cut), pieces(at[starts].astype("<i4"), cut), pieces(count.astype("<i4"), cut), pieces(tag, np.append(starts, len(at))[cut])]
    return pa.table([pa.array(bucket[starts[cut[:-1]]]), pa.array(np.full(len(cut) - 1, shard, np.int64)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "shard", "docs", "places", "counts", "tags"])


def requests(table: pa.Table) -> pa.Table:
    """Of the rows of one bucket: for every window that recurs, the shard and place of its smallest document and the shards that hold it.

    A row for each source: shard, and runs of windows as dests (the shards that hold them), docs, places and counts.
    """
    names = ["shard", "dests", "docs", "places", "counts"]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), *[pa.binary()] * 4)], names=names)
    shards = table.column("shard").to_numpy()
    docs, places, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("docs", np.int64), ("places", "<i4"), ("counts", "<i4")))
    tags = np.frombuffer(b"".join(table.column("tags").to_pylist()), np.uint64)
    runs = np.array([len(x) // 4 for x in table.column("counts").to_pylist()])
    of_run = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(tags)) - np.repeat(np.cumsum(counts) - counts, counts)
    shard, doc, place = np.repeat(shards, runs)[of_run], docs[of_run], places[of_run] + within
    order = np.lexsort((doc, tags >> _ONE))
    same = tags[order] >> _ONE
    opens = np.append(True, same[1:] != same[:-1])
    source = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    wanted = (doc[order] > doc[source]) | (tags[order] & _ONE).astype(bool)
    source, dest = source[wanted], shard[order][wanted]
    if not len(source):
        return requests(table.slice(0, 0))
    order = np.lexsort((place[source], dest, shard[source]))
    source, dest = source[order], dest[order]
    s, d, at = shard[source], doc[source], place[source]
    starts = np.flatnonzero(np.append(True, (np.diff(s) != 0) | (np.diff(dest) != 0) | (np.diff(at) != 1) | (np.diff(d) != 0)))
    count = np.diff(np.append(starts, len(s)))
    cut = np.append(np.flatnonzero(np.append(True, np.diff(s[starts]) != 0)), len(starts))
    columns = [pieces(dest[starts].astype("<i8"), cut), pieces(d[starts], cut), pieces(at[starts].astype("<i4"), cut), pieces(count.astype("<i4"), cut)]
    return pa.table([pa.array(s[starts[cut[:-1]]]), *(pa.array(c, pa.binary()) for c in columns)], names=names)


def passages_sent(texts: Texts, asked: pa.Table, width: int) -> pa.Table:
    """The passages asked of a shard, a row each: shard (that holds them too), doc (their smallest document) and the words.

    Windows of all buckets come together first, so that a passage is one run of words and not one for each anchor.
    """
    dests, docs, places, counts = (np.frombuffer(b"".join(asked.column(c).to_pylist()), t).astype(np.int64) for c, t in (("dests", "<i8"), ("docs", np.int64), ("places", "<i4"), ("counts", "<i4")))
    order = np.lexsort((places, dests))
    dests, docs, places, counts = dests[order], docs[order], places[order], counts[order]
    opens = np.append(True, (np.diff(dests) != 0) | (np.diff(docs) != 0) | (places[1:] != (places + counts)[:-1])) if len(places) else np.empty(0, bool)
    starts = np.flatnonzero(opens)
    ends = (places + counts)[np.append(starts[1:], len(places)) - 1] + width - 1 if len(starts) else starts
    flat = list(chain.from_iterable(texts.words)) if len(starts) else []
    words = [b" ".join(flat[a:b]) for a, b in zip(places[starts].tolist(), ends.tolist())]
    return pa.table([pa.array(dests[starts]), pa.array(docs[starts]), pa.array(words, pa.binary())], names=["shard", "doc", "words"])


def spelled(ids: np.ndarray) -> str:
    """Two characters for each word number; a negative number is a word that stands in no passage."""
    out = np.full(2 * len(ids), _NONE, "<u4")
    known = ids >= 0
    out[0::2][known] = _HIGH + ids[known] // _BASE
    out[1::2][known] = _LOW + ids[known] % _BASE
    return out.tobytes().decode("utf-32-le")


class Passages:
    """The automaton of a shard: every window of its passages, with the smallest document that starts it."""

    def __init__(self, table: pa.Table, width: int):
        self.width, self.numbers = width, {}
        windows: dict[str, int] = {}
        for doc, words in zip(table.column("doc").to_pylist(), table.column("words").to_pylist()):
            text = spelled(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words.split()], np.int64))
            for at in range(0, len(text) - 2 * width + 2, 2):
                window = text[at : at + 2 * width]
                if windows.setdefault(window, doc) > doc:
                    windows[window] = doc
        self.automaton = ahocorasick.Automaton()
        for window, doc in windows.items():
            self.automaton.add_word(window, doc)
        self.automaton.make_automaton()

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Where in the shard's words a window of a passage starts, and the smallest document that starts it."""
        if not len(self.automaton):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        number, at, docs = self.numbers.get, [], []
        for words, start in zip(texts.words, texts.starts.tolist()):
            if len(words) >= self.width:
                found = list(self.automaton.iter(spelled(np.array([number(w, -1) for w in words], np.int64))))
                if found:
                    end, doc = np.array(found, np.int64).T
                    at.append(start + end // 2 - self.width + 1)
                    docs.append(doc)
        return (np.concatenate(at), np.concatenate(docs)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def removed(self, texts: Texts) -> list[np.ndarray]:
        """Per document a mask of the words to remove: those of hits that start in a smaller document."""
        at, docs = self.hits(texts)
        owner = np.searchsorted(texts.starts, at, side="right") - 1
        at = at[docs < texts.id_array[owner]] if len(at) else at
        edge = np.zeros(int(texts.starts[-1]) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width, -1)
        return np.split(np.cumsum(edge[:-1]) > 0, texts.starts[1:-1]) if texts.words else []


def cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that go and the white space after each."""
    out, at = [], 0
    for word, drop in zip(WORD.finditer(text), gone.tolist()):
        if drop:
            out.append(text[at : word.start()])
            at = word.end()
            while at < len(text) and text[at] in " \t\n\r\x0b\x0c":
                at += 1
    out.append(text[at:])
    return "".join(out).strip(" \t\n\r\x0b\x0c")


def common_grams(rows: DataFrame, count: int, gram: int, texts: int = SAMPLED_TEXTS, share: float = COMMON_SHARE) -> np.ndarray:
    """Hashes of the runs of words that stand in at least ``share`` of about ``texts`` texts, which bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(run_hashes(Texts(pa.table([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1]], names=["doc_id", "text"])).hashes(), gram)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["gram"])

    some = rows.sample(min(1.0, texts / max(1, count)), seed=3).mapInArrow(run, "gram long")
    often = some.groupBy("gram").count().where(F.col("count") >= max(4, int(share * min(count, texts))))
    return np.array([r["gram"] for r in often.select("gram").collect()], np.int64).view(np.uint64)


def located(rows: DataFrame, width: int, gram: int, shard_chars: int, act: Callable[[pa.Table, Texts, list[np.ndarray]], pa.Table], schema: str | T.StructType) -> DataFrame:
    """The four steps over ``rows`` (doc_id, text and what else ``act`` needs): ``act`` gets a shard's table, its texts and their masks of words to remove."""
    # rows without an id meet no others; rows that repeat an id need not stand in one shard
    alone, rows = rows.where("doc_id IS NULL"), rows.where("doc_id IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    shards, buckets = max(1, -(-size["chars"] // shard_chars)), max(partitions_for(rows.sparkSession), size["chars"] // BUCKET_CHARS)
    common = common_grams(rows.select("doc_id", "text"), size["rows"], gram)
    by_shard = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).groupBy("shard")

    def collect(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return windows_sent(Texts(table), key[0].as_py(), width, gram, buckets, common)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table, asked: pa.Table) -> pa.Table:
        return passages_sent(Texts(table if asked.num_rows else table.slice(0, 0)), asked, width)

    def locate(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        texts = Texts(table)
        return act(table, texts, Passages(found, width).removed(texts))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = Texts(table)
            yield from act(table, texts, [np.zeros(len(w), bool) for w in texts.words]).to_batches()

    windows = by_shard.applyInArrow(collect, "bucket long, shard long, docs binary, places binary, counts binary, tags binary")
    asked = windows.groupBy("bucket").applyInArrow(lambda table: requests(table), "shard long, dests binary, docs binary, places binary, counts binary")
    found = by_shard.cogroup(asked.groupBy("shard")).applyInArrow(answer, "shard long, doc long, words binary")
    return by_shard.cogroup(found.groupBy("shard")).applyInArrow(locate, schema).union(alone.mapInArrow(keep, schema))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id. Words are
    runs of anything but ASCII white space. Null and empty texts have no words; shorter texts than a window lose
    nothing. Rows that repeat an id are no reason to remove each other; rows without an id neither lose words nor make
    others lose them. Texts of any length are streamed whole. An empty table gives an empty result; other columns are not read.
    """

    def digest(table: pa.Table, texts: Texts, masks: list[np.ndarray]) -> pa.Table:
        kept = [b" ".join(w for w, gone in zip(words, mask.tolist()) if not gone) if mask.any() else b" ".join(words) for words, mask in zip(texts.words, masks)]
        columns = [pa.array(texts.ids, pa.int64()), pa.array([len(w) for w in texts.words], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return located(rows, width, gram, shard_chars, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", width: int = 50) -> DataFrame:
    """The rows with their columns: repeated passages of ``width`` words and more are cut out of the texts, and rows that keep no word go.

    Texts that lose nothing stay as they are, byte for byte. ``chars_col``, where it is a column, is counted anew for changed
    texts. The other columns travel with the texts, so that texts are shuffled once. Null and empty texts keep no word and go; rows
    without an id stay unless they have no word; an empty table stays empty.
    """

    def edit(table: pa.Table, texts: Texts, masks: list[np.ndarray]) -> pa.Table:
        new = [cut(t, m) if m.any() else t for t, m in zip(texts.texts, masks)]
        rest = table.column("rest").take(pa.array(texts.order, pa.int64()))
        return pa.table([rest, pa.array(new, pa.string()), pa.array([bool(m.any()) for m in masks], pa.bool_())], names=["rest", "text", "changed"])

    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    schema = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    out = located(rows, width, GRAM, SHARD_CHARS, edit, schema)
    out = out.where("NOT changed OR text <> ''")
    own = lambda c: F.col("text") if c == text_col else F.col("rest")[c]
    counted = lambda c: F.when(F.col("changed"), F.length("text")).otherwise(own(c)).cast(docs.schema[c].dataType) if c == chars_col else own(c)
    return out.select(*(counted(c).alias(c) for c in docs.columns))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(len(words) - 12), lambda p: array_to_string(words[p + 1:p + 13], ' '))) AS win, unnest(range(len(words) - 12)) AS p FROM w WHERE len(words) > 12),
m AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, p + i AS q FROM k JOIN m USING (win), range(13) t(i) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS q FROM w),
s AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY q) FILTER (g.q IS NULL) AS kept, count(g.q) AS n_removed FROM e LEFT JOIN g USING (doc_id, q) GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""
