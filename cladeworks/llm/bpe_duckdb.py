"""Byte-level BPE by DuckDB recursive queries, one database a task.

A task collects the distinct words (matches of the pattern) of a batch that it has not met before. Their bytes become
rows (word, place, token), joined with the merge table. One recursive query then contracts, round by round, the leftmost pair of minimum
rank of every word, and joins the two pairs beside the new token with the merge table, until no word has a pair. A
round holds the words that are not finished, and only finished words leave the query, so memory does not grow with the rounds.
Decoding joins ids with the vocabulary and aggregates the pieces in order; a piece is a string with one character a byte.

A word is cut beforehand between two bytes that stand side by side in no token, since no merge can ever cross there: long
runs of mixed letters fall into short words. Words are remembered up to ``remember`` entries, from one task of a worker to its next,
so memory does not depend on the input.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODE = """
WITH RECURSIVE state(word, toks, ranks) AS (
    SELECT word, list(tok ORDER BY place), list(merged ORDER BY place)[:-2]
    FROM bytes LEFT JOIN merges ON left_tok = tok AND right_tok = next_tok GROUP BY word
    UNION ALL
    (WITH least AS (SELECT word, toks, ranks, list_min(ranks) AS merged FROM state),
    spot AS (SELECT *, list_position(ranks, merged) AS p FROM least WHERE merged IS NOT NULL),
    around AS (SELECT *, CASE WHEN p > 1 THEN toks[p - 1] END AS before, toks[p + 2] AS after FROM spot)
    SELECT w.word, list_concat(toks[:p - 1], [w.merged], toks[p + 2:]),
        list_concat(ranks[:greatest(p - 2, 0)], CASE WHEN before IS NULL THEN [] ELSE [b.merged] END, CASE WHEN after IS NULL THEN [] ELSE [a.merged] END, ranks[p + 2:])
    FROM around w LEFT JOIN merges b ON b.left_tok = before AND b.right_tok = w.merged LEFT JOIN merges a ON a.left_tok = w.merged AND a.right_tok = after))
SELECT word, toks FROM state WHERE list_min(ranks) IS NULL
"""
DECODE = """
SELECT d.doc, array_to_string(list(v.piece ORDER BY d.pos), '') AS pieces FROM ids d JOIN vocabulary v ON v.tok = d.tok GROUP BY d.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encoder and decoder of one task: a DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 1_000_000, together: int = 50_000):
        self.ranks, self.pattern, self.remember, self.together = ranks, regex.compile(pattern), remember, together
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        spill = os.path.join(tempfile.gettempdir(), f"duckdb-{os.getpid()}")  # scratch of this worker alone, used beyond the memory limit
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill})
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = [str(i) for i in range(1 + max(ranks.values(), default=-1))]
        self.meet = np.zeros((256, 256), bool)  # bytes that stand side by side in a token
        inside = np.frombuffer(b"".join(ranks), np.uint8)
        held = np.delete(np.arange(len(inside)), np.cumsum([len(t) for t in ranks]) - 1)
        self.meet[inside[held], inside[held + 1]] = True
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("left_tok", "right_tok", "merged"), zip(*pairs) if pairs else ((), (), ()))})
        for name, table in (("merges", merges), ("vocabulary", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())}))):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode new words; a word that is a token as a whole is that token."""
        rest = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if data in self.ranks:
                self.known[word] = np.array([self.ranks[data]], np.int32).tobytes()
            else:
                rest.append((word, data))
        if not rest:
            return
        flat, ends = np.frombuffer(b"".join(data for _, data in rest), np.uint8), np.cumsum([len(data) for _, data in rest])
        # the last byte of a word, or of a part of it that no merge leaves
        last = np.append(~self.meet[flat[:-1], flat[1:]], True)
        last[ends - 1] = True
        tokens, places = self.bytes[flat], np.arange(len(flat), dtype=np.int32)
        part = np.cumsum(last, dtype=np.int32) - last
        self.db.register("bytes", pa.table({"word": part.astype(np.int32), "place": places, "tok": tokens, "next_tok": pa.array(np.append(tokens[1:], 0), mask=last)}))
        found = self.db.sql(ENCODE).to_arrow_table().sort_by("word").column("toks").combine_chunks()
        self.db.unregister("bytes")
        ids = found.flatten().to_numpy().tobytes()
        upto = 4 * np.append(0, np.asarray(found.value_lengths()).cumsum())[np.append(0, part[ends - 1] + 1)]
        self.known.update((word, ids[a:b]) for (word, _), a, b in zip(rest, upto[:-1].tolist(), upto[1:].tolist()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        fresh = list(set().union(*split).difference(self.known))
        at = 0
        while at < len(fresh):
            upto, size = at, 0
            while upto < len(fresh) and (upto == at or size + len(fresh[upto]) <= 8 * self.together):
                size += len(fresh[upto])
                upto += 1
            self.learn(fresh[at:upto])
            at = upto
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        tokens = np.concatenate([np.empty(0, np.int32), *ids])
        if not len(tokens):
            return [b""] * len(ids)
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), [len(some) for some in ids])
        self.db.register("ids", pa.table({"doc": docs, "pos": np.arange(len(tokens), dtype=np.int32), "tok": tokens}))
        got = {doc: pieces.encode("latin-1") for doc, pieces in self.db.execute(DECODE).fetchall()}
        self.db.unregister("ids")
        return [got.get(i, b"") for i in range(len(ids))]


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    """The coder of this worker process."""
    return Coder(read_ranks(ranks_path), pattern)


def blocks(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of about ``size`` characters."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if ``with_ids``.

    Null text counts as empty: no tokens, and the hashes of empty strings. Very long texts are encoded whole. A long
    run that the pattern leaves in one piece and that cannot be cut takes a round a merge. Repeated rows repeat, null ids are carried along, an
    empty table gives an empty result, and other columns are not read. ``ranks_path`` lies on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or coder(ranks_path, pattern)
            counts, digests, backs, kept = [], [], [], []
            for texts in blocks([x or "" for x in batch.column(1).to_pylist()]):
                ids = own.encode(texts)
                for some, data in zip(ids, own.decode(ids)):
                    counts.append(len(some))
                    digests.append(hashlib.sha256(" ".join(map(own.names.__getitem__, some.tolist())).encode()).hexdigest())
                    backs.append(hashlib.sha256(data).hexdigest())
                kept += ids if with_ids else []
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int32()))] if with_ids else columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
