"""Packing along a space-filling curve: documents that lie near each other share training sequences.

A document's token counts, hashed into a few dimensions by random signs, give a point; its Hilbert key orders the
documents so that neighbours on the curve are alike. Spark sorts by ranges of (key, id), so that a key held by many
documents is split by id. Each range is then one stream of tokens that is cut every 2048; the end of a range
is cut into powers of two, which are not padded, so that no token is padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import partitions_for, written

LENGTH, END, DIMENSIONS, BITS = 2048, 1, 4, 12
_RUN = re.compile(r"\s[ \n]|\n\s|\0")
_ODD = re.compile(r"[.,](?<![^\W_].)[ \n]")
#: The byte-level alphabet: a visible character for each byte; those that are not printable follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def atoms(text: str) -> list[str]:
    """A text cut only where the tokenizer's pattern begins a new match whatever stands around.

    That is before a space that follows other than white space, around a line feed between other characters than white
    space, and between a letter or digit and the full stop or comma that ends its word. Texts with runs of white space are one atom.
    """
    plain = " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text
    if not plain and _RUN.search(text):
        return [text]
    cut = text.replace(" ", "\0 ")
    if not _ODD.search(text):
        cut = cut.replace(".\0 ", "\0.\0 ").replace(",\0 ", "\0,\0 ").replace(".\n", "\0.\n").replace(",\n", "\0,\n").replace("\n", "\0\n\0")
    return cut.split("\0")


class Encoder:
    """Whole texts to ids: distinct atoms are tokenized once and remembered, up to ``remember`` of them."""

    def __init__(self, path: str, remember: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        # the name of a special token in a text is that token, as the tokenizer's plain call has it
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.known: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new atoms. One that is a single Latin word is a single match of the pattern and goes to the tokenizer's merges as it is."""
        rest, merges, space = [], self.tokenizer.model.tokenize, chr(_VISIBLE[32])
        for atom in fresh:
            word = atom[1:] if atom[0] == " " else atom
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)
                self.known[atom] = array("I", [t.id for t in merges(seen if atom is word else space + seen)]).tobytes()
            else:
                rest.append(atom)
        for at in range(0, len(rest), 20_000):
            self.known.update(zip(rest[at : at + 20_000], self._raw(rest[at : at + 20_000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.remember:
            self.known = {"": b""}
        cut = [[text] if self.special and self.special.search(text) else atoms(text) for text in texts]
        found = [list(map(self.known.get, some)) if len(some) > 1 else some for some in cut]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        self._learn(list({some[i] for some, own in zip(cut, gaps) for i in own}))
        for some, ids, own in zip(cut, found, gaps):
            for i in own:
                ids[i] = self.known[some[i]]
        return [b"".join(ids) if len(some) > 1 else self._raw(some)[0] for some, ids in zip(cut, found)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


def signs(size: int, dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    """(token, dimension) -> -1 or 1: feature hashing of token counts into few dimensions."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (size, dimensions))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with coordinates in [0, 2**bits): Gray code with the turn of each sub-cube undone from the coarsest bit down."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            hit = (x[i] & bit) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(doc_id, key, ids): ids are little-endian numbers of two bytes where the vocabulary allows, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(tokenizer_path), None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                encoded = own.encode([x or "" for x in part.column(1).to_pylist()])
                if table is None:
                    # tokens with one pattern of signs are counted together
                    table = (signs(own.tokenizer.get_vocab_size()) > 0).astype(np.uint8) @ (1 << np.arange(DIMENSIONS, dtype=np.uint8))
                    corners = 2.0 * ((np.arange(1 << DIMENSIONS)[:, None] >> np.arange(DIMENSIONS)[None, :]) & 1) - 1
                spots, packed = np.empty((len(encoded), DIMENSIONS)), []
                for i, data in enumerate(encoded):
                    ids = np.frombuffer(data, "<u4")
                    total = np.bincount(table[ids], minlength=1 << DIMENSIONS) @ corners
                    spots[i] = total / max(1.0, np.sqrt(len(ids)) * 8)
                    packed.append(np.append(ids, end).astype("<u2" if small else "<u4").tobytes())
                cells = np.clip((np.tanh(spots) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hilbert(cells)), pa.array(packed, pa.binary())], ["doc_id", "key", "ids"])

    small = encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, key long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``with_ids``).

    Sequences hold at most ``length`` tokens and are full, or as long as a power of two. Null and empty texts are one
    token, the end. Names of special tokens in a text are these tokens. A document longer than a sequence has several pieces, next to each other on the curve. Repeated
    rows are packed each; null ids are packed too and sort first. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    width = "<u2" if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    placed = written(tokenized(docs, tokenizer_path, id_col, text_col, end), "tokens")
    id_type = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        waiting: list[tuple[object, int, np.ndarray, int]] = []  # pieces of the sequence that is not yet full
        held = 0

        def rows(pieces: list[tuple[object, int, np.ndarray, int]]) -> list[tuple]:
            nonlocal done
            out, at = [], 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, (task << 40) + done, at, *[ids.tolist()] * with_ids))
                at += len(ids)
            done += 1
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            out: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, start = np.frombuffer(data.as_buffer(), width).astype("<u4"), 0
                while start < len(ids):
                    some = ids[start : start + length - held]
                    waiting.append((doc, start, some, len(ids)))
                    held, start = held + len(some), start + len(some)
                    if held == length:
                        out += rows(waiting)
                        waiting, held = [], 0
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
        out = []
        while held:
            size = 1 << (held.bit_length() - 1)
            some, took = [], 0
            while took < size:
                doc, start, ids, total = waiting.pop(0)
                part = ids[: size - took]
                some.append((doc, start, part, total))
                took += len(part)
                if len(part) < len(ids):
                    waiting.insert(0, (doc, start + len(part), ids[len(part) :], total))
            out += rows(some)
            held -= size
        if out:
            yield batch_of(out)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    types = [placed.select("doc_id").limit(0).toArrow().schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
    ordered = placed.repartitionByRange(partitions_for(spark), "key", "doc_id", F.xxhash64("ids")).sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "ids")
    return ordered.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)
