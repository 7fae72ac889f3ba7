"""Groups of near copies, for filtering: five words a shingle, and a Jaccard similarity of 0.8 or more between sets of shingles.

Two searches follow each other, and in both the sets of shingles decide. The first finds most links at little cost by
SimHash: pairs that agree in one of ``TABLES`` sets of ``SAMPLED`` bits or more (they grow with the number of texts) of the first fingerprint and, over both fingerprints,
differ in ``TOTAL`` of 128 bits at most, are joined into components, and sets are compared inside each; large components are cut
into chunks that meet two by two. The second finds every link between the groups of the first. Shingles have one order, the
rarer ones first. Two sets of that similarity share a shingle among the first fifth of each, and where the first shared one stands bounds what
they can share at most; so rows meet by those shingles, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.components import connected_components
from cladeworks.llm.shared import Tables, partitions_for, written
from cladeworks.llm.simhash import CHUNK, bucket_links, coordinates, fingerprint, in_runs, in_tasks, pivot_row, references, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
TABLES, SAMPLED, RADIUS, TOTAL, SETS = 48, 12, 22, 32, 500
#: Shingles are counted in 2**COUNTED counters, of which 2**SLICE travel together.
COUNTED, SLICE = 19, 13


def whole(hashes: np.ndarray) -> bytes:
    """128 bits that tell one sorted set of shingles from another."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, text) of the rows with an id; an id and the hash of its text name a row also where ids repeat."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text")).where("id IS NOT NULL")


def sketches(rows: DataFrame) -> DataFrame:
    """(id, own, a, b, whole, pivots, row): two fingerprints, the hash of the set of shingles and the row of the pivot table, of every keyed row with a word."""
    pivots = references()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, fingerprint(h), fingerprint((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(17))), whole(h)) for i, h in enumerate(map(shingle_set, batch.column(2).to_pylist())) if len(h)]
            at, a, b, sets = zip(*made) if made else ((), (), (), ())
            first, second = np.array(a, np.uint64), np.array(b, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(2)), *(pa.array(x.view(np.int64)) for x in (first, second)), pa.array(sets, pa.binary()), pivot_row(first, pivots)], ["id", "own", "a", "b", "whole", "pivots"])

    return rows.mapInArrow(run, "id long, own long, a long, b long, whole binary, pivots binary").withColumn("row", F.monotonically_increasing_id())


def candidates(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the rows ``first`` of distinct pairs of fingerprints that may be near copies."""
    sampled = max(SAMPLED, prints.count().bit_length() - 6)
    rng = np.random.default_rng(17)
    masks = [sum(1 << int(i) for i in rng.choice(64, sampled, replace=False)) for _ in range(TABLES)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("a").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = prints.select("first", "a", "b", "pivots", F.explode(keys).alias("k")).select("first", "a", "b", "pivots", "k.table", "k.key")
    dealt = in_tasks(rows, ["table", "key"], "first", CHUNK).select("task", "first", "a", "b", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches):
            k, first, a, b = (table.column(i).to_numpy() for i in range(4))
            left, right = bucket_links(k, a.view(np.uint64), RADIUS, coordinates(table.column(4)), b.view(np.uint64), TOTAL)
            yield pa.RecordBatch.from_arrays([pa.array(first[left]), pa.array(first[right])], ["a", "b"])

    return dealt.repartition(partitions_for(prints.sparkSession), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= least * (len(a) + len(b) - both)


def verified(table: pa.Table, least: float = SIMILARITY) -> pa.Table:
    """Stars of the ids of a task whose sets are similar; pairs that are connected already are not compared."""
    ids = table.column("first").to_numpy()
    prints = [table.column(c).to_numpy().view(np.uint64) for c in ("a", "b")]
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs: list[np.ndarray] = []
    for i in range(len(ids) - 1):
        apart = sum(np.bitwise_count(p[i] ^ p[i + 1 :]).astype(np.int16) for p in prints)
        j = np.flatnonzero((apart <= TOTAL) & (np.minimum(sizes[i], sizes[i + 1 :]) >= least * np.maximum(sizes[i], sizes[i + 1 :])))
        pairs.append(np.stack((apart[j], np.full(len(j), i), j + i + 1), axis=1))
    for _, i, j in sorted(map(tuple, np.concatenate([np.empty((0, 3), np.int64), *pairs]).tolist())):
        a, b = top(i), top(j)
        if a != b and similar(sets[i], sets[j], least):
            root[max(a, b)] = min(a, b)
    tops = np.array([top(i) for i in range(len(ids))], np.int64)
    off = np.flatnonzero(tops != np.arange(len(ids)))
    return pa.table([pa.array(ids[off]), pa.array(ids[tops[off]])], names=["a", "b"])


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """About how many texts hold a shingle, at its first ``COUNTED`` bits; shingles that share a counter add up."""
    shift, n = np.uint64(64 - COUNTED), 1 << COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, "<i8")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (shingle_set(text) >> shift).astype(np.int64), 1)
        if counts.any():
            parts = counts.astype("<i4").reshape(-1, 1 << SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table([table.column("slice")[:1].cast(pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], names=["slice", "counts"])

    parts = rows.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    counts = np.zeros(n, np.int32)
    for row in parts.collect():
        counts[row["slice"] << SLICE : (row["slice"] + 1) << SLICE] = np.frombuffer(row["counts"], "<i4")
    return counts


def shared_heads(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(key, id, own, n, at): of every keyed row with n shingles the first ones in the common order, with their place, if another row has them too."""
    counts, shift = shingle_counts(docs), np.uint64(64 - COUNTED)
    # different sets with fewer shingles differ by too much
    fewest = next(n for n in range(1, 1 << 16) if n >= least * (n + 1) - 1e-9)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, owns = [], [], []
            sizes = []
            for i, own, text in zip(*(column.to_pylist() for column in batch.columns)):
                s = shingle_set(text)
                if len(s) >= fewest:
                    take = len(s) - int(np.ceil(least * len(s) - 1e-6)) + 1
                    keys.append(s[np.lexsort((s, counts[(s >> shift).astype(np.int64)]))[:take]])
                    ids.append(i)
                    owns.append(own)
                    sizes.append(len(s))
            if ids:
                many = [len(k) for k in keys]
                columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(ids, np.int64), many), np.repeat(np.array(owns, np.int64), many), np.repeat(np.array(sizes, np.int32), many), np.concatenate([np.arange(k, dtype=np.int32) for k in many])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "own", "n", "at"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, and whether its key has been seen before it
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            before = np.concatenate(([held is not None and held.column(0)[0].as_py() == keys[0]], same))
            if held is not None and (seen or before[0]):
                yield held
            keep = before | np.concatenate((same, [False]))
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held, seen = batch.slice(batch.num_rows - 1), bool(before[-1])
        if held is not None and seen:
            yield held

    schema = "key long, id long, own long, n int, at int"
    return docs.mapInArrow(heads, schema).repartition(partitions_for(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(repeated, schema)


def head_pairs(batches: Iterator[pa.RecordBatch], least: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of ids in runs of equal tasks whose groups differ and that may be similar by their sizes and the places of what they share.

    The columns are task, id, group, n, at. A run stays whole and has a bounded number of rows.
    """
    held = [np.empty(0, np.int64)] * 5

    def found(task: np.ndarray, ids: np.ndarray, group: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, step = np.arange(len(task)), 0
        while True:
            step += 1
            one = one[one < len(task) - step]
            one = one[task[one] == task[one + step]]
            if not len(one):
                return
            two = one + step
            both = n[one] + n[two]
            # what stands before the first shared shingle is not shared
            may = (group[one] != group[two]) & (np.minimum(n[one] - at[one], n[two] - at[two]) * (1 + least) >= least * both - 1e-6)
            if may.any():
                x, y = ids[one[may]], ids[two[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for batch in batches:
        held = [np.concatenate((x, batch.column(i).to_numpy().astype(np.int64))) for i, x in enumerate(held)]
        if len(held[0]) >= 1 << 16:
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from found(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
    if len(held[0]):
        yield from found(*held)


def links_between(docs: DataFrame, named: DataFrame, held: Tables) -> DataFrame:
    """Links (a, b) between different groups of ``named`` (first, id, own, group): of every two similar sets, each under the row ``first``; ``docs`` is keyed."""
    spark = docs.sparkSession
    rows = shared_heads(docs).join(named, ["id", "own"]).select("key", F.col("first").alias("id"), "group", "n", "at")
    rows = held.written(rows, "shared-heads")
    mixed = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    dealt = in_tasks(rows.join(mixed, "key"), ["key"], "id", CHUNK).select("task", "id", "group", "n", "at")
    pairs = dealt.repartition(partitions_for(spark), "task").sortWithinPartitions("task").mapInArrow(head_pairs, "a long, b long")
    pairs = held.written(pairs.distinct(), "head-pairs")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingle_set(t).astype("<u8").tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["first", "group", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), SIMILARITY) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["ga", "gb"]).filter(pa.array(yes, pa.bool_()))

    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "first").join(named, "first")
    texts = docs.join(wanted, ["id", "own"]).dropDuplicates(["first"]).select("first", "group", "text")
    sets = held.written(texts.mapInArrow(to_sets, "first long, group long, shingles binary"), "pair-sets")
    left = sets.select(F.col("first").alias("a"), F.col("group").alias("ga"), F.col("shingles").alias("x"))
    right = sets.select(F.col("first").alias("b"), F.col("group").alias("gb"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("ga", "gb", "x", "y")
    return both.mapInArrow(compare, "ga long, gb long").select(F.col("ga").alias("a"), F.col("gb").alias("b"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, group) of every row with an id and a word: own is the hash of its text, group the smallest id of the near copies it is linked to.

    Rows with equal sets of shingles are one text here; texts with equal fingerprints are candidates like any other.
    Rows that share an id but not a text are texts of their own. An empty table gives an empty result.
    """
    rows, held = keyed(docs, id_col, text_col), Tables(docs.sparkSession)
    of = held.written(sketches(rows), "sketches")
    prints = of.groupBy("whole").agg(F.min("row").alias("first"), *(F.min_by(c, "row").alias(c) for c in ("id", "own", "a", "b", "pivots")))
    prints = held.written(prints, "distinct-sketches")
    heads = prints.groupBy("a", "b").agg(F.min("first").alias("first"), F.min_by("pivots", "first").alias("pivots"))
    alike = prints.withColumnRenamed("first", "other").join(heads.select("a", "b", "first"), ["a", "b"]).where("other <> first").select(F.col("other").alias("a"), F.col("first").alias("b"))
    maybe = connected_components(candidates(heads).union(alike)).withColumnRenamed("node", "first")
    members = held.written(prints.drop("pivots", "whole").join(maybe, "first"), "maybe-near")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).astype("<u8").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], ["first", "a", "b", "shingles"])

    texts = rows.join(members, ["id", "own"]).dropDuplicates(["first"]).select("first", "a", "b", "text")
    sets = texts.mapInArrow(to_sets, "first long, a long, b long, shingles binary")
    dealt = in_tasks(members.select("root", "first"), ["root"], "first", SETS).select("task", "first")
    linked = sets.join(dealt, "first").select("task", "first", "a", "b", "shingles").groupBy("task").applyInArrow(lambda table: verified(table), "a long, b long")
    groups = connected_components(linked).withColumnRenamed("node", "first")
    named = prints.select("first", "whole", "id", "own").join(groups, "first", "left").withColumn("group", F.coalesce("root", "first"))
    named = held.written(named.drop("root"), "first-groups")
    higher = connected_components(links_between(rows, named.select("first", "id", "own", "group"), held)).withColumnRenamed("node", "group")
    named = named.join(higher, "group", "left").select("whole", F.coalesce("root", "group").alias("root"))
    found = written(of.select("id", "own", "whole").join(named, "whole").select("id", "own", "root"), "near-rows")
    held.clear()
    return found.join(found.groupBy("root").agg(F.min("id").alias("group")), "root").select("id", "own", "group")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group) of ``grouped``."""
    return grouped(docs, id_col, text_col).select("id", "group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, less those whose group holds a smaller id.

    Rows without an id or a word stay. A row is judged by its own text also where its id repeats.
    """
    gone = grouped(docs, id_col, text_col).where("id <> group").select(F.col("id").alias("__gone"), F.col("own").alias("__own")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__own"]), "left_anti")
