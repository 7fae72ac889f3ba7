"""SimHash near-duplicates, searched with pivot distance tables.

Fingerprints that link differ in few bits. Each distinct fingerprint gets a row of a pivot table, computed once and
carried beside it: its Hamming distances to many fixed reference fingerprints. By the triangle inequality two fingerprints within ``radius`` differ by
at most ``radius`` in every coordinate, so a pair with a larger difference anywhere is discarded; survivors are verified
by exclusive or and bit count.

The table alone does not enumerate pairs in less than quadratic work, since a random pair passes one random reference
more often than not. Pairs are therefore only formed among fingerprints that agree on ``blocks - radius`` of ``blocks``
bit blocks: any pair within ``radius`` does so for at least one choice of blocks, so no link is lost. The number of
blocks grows with the number of fingerprints, so that the keys grow longer and the buckets do not fill. Buckets over
``chunk`` fingerprints are cut into chunks that meet two by two in tasks of their own. A bucket's links leave it as
stars, one row a fingerprint, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.components import connected_components
from cladeworks.llm.shared import LOWER, UPPER, partitions_for, written

RADIUS, CHUNK, PIVOTS = 4, 4096, 32
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def references(count: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; a text with fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(shingle_hashes(x.as_py(), width)) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) as stars: each index in a link with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b, label = ends[: len(left)], ends[len(left) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            off = label != np.arange(len(nodes))
            return nodes[off], nodes[label[off]]
        label = new


def pivot_row(prints: np.ndarray, pivots: np.ndarray) -> pa.Array:
    """The rows of the pivot table, a byte a distance."""
    return pa.array([row.tobytes() for row in np.bitwise_count(prints[:, None] ^ pivots[None, :])], pa.binary())


def coordinates(rows: pa.Array) -> np.ndarray:
    """(pivot, row): the distances that ``pivot_row`` made."""
    return np.frombuffer(b"".join(rows.to_pylist()), np.int8).reshape(len(rows), -1).T.copy()


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int, table: np.ndarray, more: np.ndarray | None = None, total: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Stars of fingerprints within ``radius`` in runs of equal ``keys`` (sorted), with their coordinates in ``table``.

    ``more`` holds a second fingerprint of each; both together then differ in ``total`` bits at most.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step, held = np.arange(len(keys)), 0, 0
    while True:
        step += 1
        at = at[at < len(keys) - step]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        one = at
        for row in table:
            one = one[np.abs(row[one] - row[one + step]) <= radius]
        apart = np.bitwise_count(prints[one] ^ prints[one + step])
        one, apart = one[apart <= radius], apart[apart <= radius]
        if more is not None:
            one = one[apart + np.bitwise_count(more[one] ^ more[one + step]) <= total]
        left.append(one)
        right.append(one + step)
        held += len(one)
        if held > 500_000:
            stars = local_stars(np.concatenate(left), np.concatenate(right))
            left, right, held = [stars[0]], [stars[1]], len(stars[0])
    return local_stars(np.concatenate(left), np.concatenate(right))


def in_tasks(rows: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """Add ``task``: one for each group of ``keys``; a group over ``chunk`` rows is cut into chunks by ``member``, and any two chunks meet in a task."""
    large = rows.groupBy(*keys).count().where(F.col("count") > chunk).select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("g"))
    dealt = rows.join(large, keys, "left").withColumn("g", F.coalesce("g", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64(member), F.col("g")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.withColumn("task", F.xxhash64(*keys, F.least("c", "d"), F.greatest("c", "d"))).drop("g", "c", "d")


def blocks_for(count: int, radius: int) -> int:
    """How many bit blocks keep the buckets of ``count`` fingerprints short: keys have radius blocks less, so 21, 27 and 32 bits for a radius of four."""
    return radius + 2 + sum(count > limit for limit in (1 << 22, 1 << 28))


def with_pivots(prints: DataFrame) -> DataFrame:
    """Add ``pivots``, the row of the pivot table, to fingerprints ``fp``."""
    references_ = references()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pivot_row(batch.column("fp").to_numpy().view(np.uint64), references_)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "pivots"])

    return prints.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prints.schema) + ", pivots binary")


def in_runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches sorted by their first column, joined so that rows with equal values there stay together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b): stars that connect all distinct fingerprints ``fp`` within ``radius``; ``pivots`` beside them."""
    spark = prints.sparkSession
    blocks = blocks or blocks_for(prints.count(), radius)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    banded = prints.select("fp", "pivots", F.explode(keys).alias("k")).select("k.band", "k.key", "fp", "pivots")
    dealt = in_tasks(banded, ["band", "key"], "fp", chunk).select("task", "fp", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches):
            keys, fps = table.column(0).to_numpy(), table.column(1).to_numpy()
            a, b = bucket_links(keys, fps.view(np.uint64), radius, coordinates(table.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    return dealt.repartition(partitions_for(spark), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null text and text without words have fingerprint zero, which links like any other; fewer words than ``width`` make
    one shingle. Rows with one fingerprint link. Repeated rows repeat in the result; a null id never names a component
    unless all its ids are null. Texts of any length are read whole. An empty table gives an empty result; other columns are not read.
    """
    of = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    prints = written(with_pivots(of.groupBy("fp").agg(F.min("doc_id").alias("first"))), "pivot-table")
    roots = connected_components(links(prints, radius))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return of.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
