"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all trees, exact reranking.

The trees are fitted on a bounded sample on the driver: a node splits at the median along the difference of two sample
vectors. Inner product becomes an angle by one more component, sqrt(M^2 - |x|^2), M being the largest norm of the table.
Every vector is filed in one leaf of each tree. A query walks all trees through one queue ordered by the distance to
the splitting planes, and so visits the ``visit`` most promising leaves of the forest that hold rows.

Leaves are dealt to bins of bounded size, large leaves in several parts; the number of leaves is fixed by the parameters, so
their counts fit the driver. A bin's task holds its vectors and streams the queries that visit it and keeps the nearest of
each; a row counts in the first leaf where a query meets it. Rows come from visited leaves only. The fitted sample prunes what bins report: of its rows that lie in
visited leaves, which the forest finds anyway, the k-th best score is a floor that the k nearest found reach. A window keeps the
nearest over all bins. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, DEPTH, VISIT, SAMPLE, BIN_ROWS = 8, 9, 512, 20_000, 8192


@dataclass
class Forest:
    """normals: (trees, 2**depth, dims); thresholds: (trees, 2**depth); node 1 is a root, 2k and 2k+1 are below k."""

    normals: np.ndarray
    thresholds: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree, numbered over the whole forest."""
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t, (normals, thresholds) in enumerate(zip(self.normals, self.thresholds)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", x, normals[node]) > thresholds[node])
            out[:, t] = (t << self.depth) + node - (1 << self.depth)
        return out

    def visited(self, query: np.ndarray, visit: int, held: Container[int]) -> list[int]:
        """The first ``visit`` leaves of ``held`` in the order of the shared queue."""
        margins = self.normals @ query - self.thresholds
        queue, out, full = [(0.0, t, 1) for t in range(len(margins))], [], 1 << self.depth
        while queue and len(out) < visit:
            far, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < full:
                margin = own[node]
                right = margin > 0
                heapq.heappush(queue, (far + margin * margin, t, 2 * node + (not right)))
                node = 2 * node + bool(right)
            leaf = (t << self.depth) + node - full
            if leaf in held:
                out.append(leaf)
        return out


def grow(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    normals, thresholds = np.zeros((trees, 1 << depth, dims)), np.zeros((trees, 1 << depth))
    for t in range(trees):
        node = np.ones(len(sample), np.int64)
        for k in range(1, 1 << depth):
            own = sample[node == k]
            normal = np.zeros(dims)
            if len(own) > 1:
                a, b = rng.choice(len(own), 2, replace=False)
                normal = own[a] - own[b]
            if not normal.any():
                normal = rng.normal(size=dims)
            normals[t, k] = normal / np.linalg.norm(normal)
            if len(own):
                values = own @ normals[t, k]
                thresholds[t, k] = np.median(values)
                node[node == k] = 2 * k + (values > thresholds[t, k])
    return Forest(normals, thresholds, depth)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that is not zero, of the most frequent length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, depth: int = DEPTH, visit: int = VISIT, sample: int = SAMPLE, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, ties to the smaller id, never the query's own id.

    Null, zero and non-finite vectors, vectors of another length than most, and rows without an id take no part, neither
    as candidates nor as queries. An id that repeats is one candidate with its best score. Fewer candidates than ``k``
    give fewer rows, and so do visited leaves that hold fewer; an empty table gives an empty result; other columns are not read.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if largest is None:
        return spark.createDataFrame([], schema)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow().combine_chunks()
    fitted, (fitted_ids, once) = matrix(picked.column("v").combine_chunks()), np.unique(picked.column("id").to_numpy(), return_index=True)
    fitted, slack = fitted[once], 1e-9 * max(1.0, largest)

    def augmented(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0.0, largest - np.einsum("ij,ij->i", x, x)))))

    forest = grow(augmented(fitted), trees, depth)
    fitted_in = forest.leaves(augmented(fitted))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(augmented(matrix(batch.column(1)))) if batch.num_rows else np.empty((0, trees), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, trees, dtype=np.int32)), pa.array(leaves.ravel()))], ["id", "v", "leaves"])

    in_leaves = rows.mapInArrow(filed, "id long, v array<double>, leaves array<long>")
    counts = dict(in_leaves.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())
    bins: list[list[tuple[int, int]]] = []  # of (leaf, part)
    place: dict[int, list[int]] = {}
    room = 0
    for leaf in range(trees << depth):
        parts = -(-counts.get(leaf, 0) // bin_rows)
        for part in range(parts):
            need = counts[leaf] // parts
            if not bins or room < need:
                bins.append([])
                room = bin_rows
            room -= need
            bins[-1].append((leaf, part))
            place.setdefault(leaf, []).append(len(bins) - 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: tuple[list[int], list[int], list[list[int]]] = ([], [], [])
            for i, (key, leaves) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                to: dict[int, list[int]] = {}
                for leaf in leaves:
                    spots = place[leaf]
                    to.setdefault(spots[(key * 0x9E3779B97F4A7C15 >> 17) % len(spots)], []).append(leaf)
                for spot, some in to.items():
                    own[0].append(spot)
                    own[1].append(i)
                    own[2].append(some)
            at = pa.array(own[1], pa.int64())
            yield sent(batch, own, [pa.array(own[2], pa.list_(pa.int32())), batch.column(2).cast(pa.list_(pa.int32())).take(at), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.float64())])

    def floors(query_ids: np.ndarray, queries: np.ndarray, every: list[list[int]]) -> list[float]:
        """Per query the k-th best score among the fitted rows of the leaves it visits; none where they are fewer."""
        out = []
        for own, scores, leaves in zip(query_ids, queries @ fitted.T, every):
            met = np.zeros(trees << depth, bool)
            met[leaves] = True
            scores = scores[met[fitted_in].any(axis=1) & (fitted_ids != own)]
            out.append(float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf)
        return out

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: tuple[list[int], list[int]] = ([], [])
            bits: list[bytes] = []
            least: list[float] = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                queries, every = matrix(part.column(1)), []
                for i, query in enumerate(queries, start):
                    every.append(forest.visited(np.append(query, 0.0), visit, place))
                    met = np.zeros(trees << depth, bool)
                    met[every[-1]] = True
                    bits.append(np.packbits(met).tobytes())
                    spots = sorted({spot for leaf in every[-1] for spot in place[leaf]})
                    own[0].extend(spots)
                    own[1].extend([i] * len(spots))
                least += floors(part.column(0).to_numpy(), queries, every)
            at = pa.array(own[1], pa.int64())
            yield sent(batch, own, [pa.nulls(len(at), pa.list_(pa.int32())), pa.nulls(len(at), pa.list_(pa.int32())), pa.array(bits, pa.binary()).take(at), pa.array(least, pa.float64()).take(at)])

    def sent(batch: pa.RecordBatch, own: tuple[list[int], ...], more: list[pa.Array]) -> pa.RecordBatch:
        at = pa.array(own[1], pa.int64())
        kind = int(more[0].null_count > 0)
        return pa.RecordBatch.from_arrays([pa.array(own[0], pa.int32()), pa.array([kind] * len(at), pa.int32()), batch.column(0).take(at), batch.column(1).take(at), *more], ["bin", "kind", "id", "v", "leaves", "filed", "visits", "floor"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, stored, slots, filed_in, ready = None, [], [], [], [], None
        for batch in batches:
            spots, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((spots[1:] != spots[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(spots)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if spots[a] != now:
                    now, ids, stored, slots, filed_in, ready = spots[a], [], [], [], [], None
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    ids.append(part.column(2).to_numpy())
                    stored.append(matrix(part.column(3)))
                    slots += part.column(4).to_pylist()
                    filed_in.append(matrix(part.column(5)))
                    continue
                if not ids:
                    continue
                if ready is None:
                    leaves = sorted({x for some in slots for x in some})
                    number, most = np.zeros(trees << depth, np.int64), max(map(len, slots))
                    number[leaves] = np.arange(1, len(leaves) + 1)
                    by_id = np.argsort(np.concatenate(ids), kind="stable")
                    ready = (np.concatenate(ids)[by_id], np.concatenate(stored)[by_id], number, np.array([[number[x] for x in some] + [0] * (most - len(some)) for some in slots])[by_id], np.concatenate(filed_in)[by_id])
                for at in range(0, b - a, 128):
                    yield best(part.slice(at, 128), *ready)

    def best(part: pa.RecordBatch, ids: np.ndarray, stored: np.ndarray, number: np.ndarray, slots: np.ndarray, filed_in: np.ndarray) -> pa.RecordBatch:
        """The bin's nearest rows for each query. A row that a query meets in several leaves is reported in the first of them only."""
        asked_ids, asked_v, sample_floor = part.column(2).to_numpy(), matrix(part.column(3)), part.column(7).to_numpy()
        every = np.unpackbits(np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(len(asked_ids), -1), axis=1).astype(bool)
        visits = np.zeros((len(asked_ids), number.max() + 1), bool)
        visits[:, number[number > 0]] = every[:, : len(number)][:, number > 0]
        scores = asked_v @ stored.T
        seen = visits[:, slots[:, 0]]
        for j in range(1, slots.shape[1]):
            seen |= visits[:, slots[:, j]]
        scores[~seen | (asked_ids[:, None] == ids[None, :])] = -np.inf
        # an id that repeats counts with its best row
        firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        best_of = scores if len(firsts) == len(ids) else np.maximum.reduceat(scores, firsts, axis=1)
        few = min(k, len(firsts))
        floor = np.maximum(np.partition(best_of, -few, axis=1)[:, -few], sample_floor)
        out: tuple[list[np.ndarray], ...] = ([], [], [])
        for i, query in enumerate(asked_v):
            near = np.flatnonzero((scores[i] >= floor[i] - slack) & (scores[i] > -np.inf))
            exact = (stored[near] * query).sum(axis=1)
            order = np.lexsort((ids[near], -exact))
            if len(firsts) < len(ids):
                order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
            near, exact = near[order[:k]], exact[order[:k]]
            shared = every[i][filed_in[near]]
            first = filed_in[near, shared.argmax(axis=1)] if len(near) else near
            mine = (slots[near] == number[first][:, None]).any(axis=1) & (number[first] > 0)
            out[0].append(np.full(int(mine.sum()), asked_ids[i]))
            out[1].append(ids[near][mine])
            out[2].append(exact[mine])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    layout = "bin int, kind int, id long, v array<double>, leaves array<int>, filed array<int>, visits binary, floor double"
    sides = in_leaves.mapInArrow(dealt, layout).unionByName(asked.mapInArrow(asking, layout))
    found = sides.repartition(max(1, len(bins)), "bin").sortWithinPartitions("bin", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
