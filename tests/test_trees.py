"""Golden values of pair, tree and solver operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import clones, pairs, spatial
from cladeworks.operators import trees as T
from cladeworks.solve import agglomerate, greedy

TREE = "node string, parent string, length double"


def tree(spark, edges, length=1.0):
    children = {c for _, c in edges}
    root = next(p for p, _ in edges if p not in children)
    return spark.createDataFrame([(str(root), None, 0.0)] + [(str(c), str(p), length) for p, c in edges], TREE)


def test_dissimilarities(spark):
    s1, s2 = [0, 1, 0, -1, 1, 2], [1, 1, 0, 0, 1, 3]
    df = spark.createDataFrame([(s1, s2)], "a array<int>, b array<int>")
    w = lambda i, s: F.when((i == 0) & (s == 1), -math.log(0.5)).when(s == 2, -math.log(0.05)).when(s == 3, -math.log(0.85)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    got = df.select(pairs.weighted_hamming(a, b).alias("x"), pairs.weighted_hamming(a, a).alias("y"), pairs.weighted_hamming(a, b, weights=w).alias("z"), pairs.hamming(a, b).alias("h"), pairs.hamming(a, b, ignore_missing=True).alias("k")).first()
    assert (got.x, got.y, got.h, got.k) == (pytest.approx(3 / 5), 0, 3, 2)
    assert got.z == pytest.approx(-(math.log(0.5) + math.log(0.05) + math.log(0.85)) / 5)
    gone = spark.createDataFrame([([-1], [1])], "a array<int>, b array<int>")
    assert gone.select(pairs.weighted_hamming(a, b)).first()[0] == 0 and gone.select(pairs.exponential_similarity(a, b)).first()[0] == 0


def test_equal_cells_are_compared_once(spark):
    cells = spark.createDataFrame([("a", [1, 0]), ("b", [1, 0]), ("c", [2, 0])], "cell string, states array<int>")
    assert {(r.a, r.b): r.d for r in pairs.dissimilarity_map(cells).collect()} == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


def test_parsimony(spark):
    t = tree(spark, [(7, 5), (7, 6), (5, 0), (5, 1), (6, 2), (6, 3), (6, 4)])
    cells = spark.createDataFrame([("0", [1, -1, -1]), ("1", [2, 1, -1]), ("2", [2, -1, -1]), ("3", [1, 2, 2]), ("4", [1, 1, 2])], "node string, states array<int>")
    states = T.ancestral_states(t, T.closure(t), cells)
    assert T.mutations(t, states).count() == 8 and T.mutations(t, states, count_missing=True).count() == 12


def test_fitch(spark):
    t = tree(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7), (3, 8), (4, 9), (4, 10), (5, 11), (5, 12), (6, 13), (6, 14)])
    labels = spark.createDataFrame([(str(7 + i), c) for i, c in enumerate("AGAACAGG")], "node string, label string")
    sets = {r.node: "".join(r.labels) for r in T.fitch_hartigan(t, T.closure(t), labels).collect()}
    assert [sets[str(i)] for i in range(7)] == ["A", "A", "ACG", "AG", "A", "AC", "G"]
    assert T.small_parsimony(t, T.closure(t), labels).first()[0] == 3


def test_expansion(spark):
    t = tree(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (3, 8), (3, 9), (3, 16), (7, 10), (7, 11), (8, 12), (8, 13), (9, 14), (9, 15), (16, 17), (16, 18)])
    p = {r.node: r.pvalue for r in T.expansion_pvalues(t, T.closure(t), 2).collect()}
    assert [p[n] for n in ("1", "2", "3", "7", "8")] == pytest.approx([0.3, 0.8, 1 / 21, 0.5, 0.6]) and p["0"] == p["4"] == 1.0
    assert all(r.pvalue == 1.0 for r in T.expansion_pvalues(t, T.closure(t), 20).collect())


def test_morans_i(spark):
    t = spark.createDataFrame([("F", None, 0.0), ("A", "F", 0.1), ("B", "F", 0.2), ("E", "F", 0.5), ("C", "E", 0.3), ("D", "E", 0.4)], TREE)
    two = spark.createDataFrame([(a, b) for a in "ABCD" for b in "ABCD" if a < b], "a string, b string")
    distances = T.lowest_common_ancestors(two, T.closure(t))
    x = spark.createDataFrame(list(zip("ABCD", [10.0, 10.0, 3.0, 3.0])), "node string, x double")
    assert T.morans_i(distances, x).first()[0] == pytest.approx(0.084456, abs=1e-6)


def test_morans_i_needs_no_pairs(spark):
    t = spark.createDataFrame([("F", None, 0.0), ("A", "F", 0.1), ("B", "F", 0.2), ("E", "F", 0.5), ("C", "E", 0.3), ("D", "E", 0.4)], TREE)
    x = spark.createDataFrame([("A", 10.0), ("B", 10.0), ("C", 3.0), ("D", 3.0), ("elsewhere", 6.5)], "node string, x double")
    assert T.morans_i_of_tree(t, T.closure(t), x.where("node <> 'elsewhere'")).first()[0] == pytest.approx(0.084456, abs=1e-6)
    two = spark.createDataFrame([(a, b) for a in "ABCD" for b in "ABCD" if a < b], "a string, b string")
    some = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 4.0), ("D", 2.5)], "node string, x double")
    assert T.morans_i_of_tree(t, T.closure(t), some).first()[0] == pytest.approx(T.morans_i(T.lowest_common_ancestors(two, T.closure(t)), some).first()[0])
    assert T.morans_i_of_tree(t, T.closure(t), x.withColumn("x", F.lit(1.0))).first()[0] is None
    # 30000 leaves below 10 nodes: pairs of one node at distance 1, others at 3; pairs themselves would be 450 million rows
    n, k = 30_000, 10
    wide = spark.createDataFrame([("r", None, 0.0)], TREE).union(spark.range(k).select(F.concat(F.lit("n"), "id"), F.lit("r"), F.lit(1.0))).union(spark.range(n).select(F.concat(F.lit("s"), "id"), F.concat(F.lit("n"), F.col("id") % k), F.lit(0.5)))
    value = lambda i: (i * i) % 101 + (i % k) * 3.0
    z = [value(i) for i in range(n)]
    mean = sum(z) / n
    sd = (sum((v - mean) ** 2 for v in z) / n) ** 0.5
    z = [(v - mean) / sd for v in z]
    near = sum(sum(z[j::k]) ** 2 for j in range(k))
    size = n // k
    total = (near - sum(v * v for v in z)) / 2 + (sum(z) ** 2 - near) / 6
    weight = k * size * (size - 1) / 2 + (n * n - k * size * size) / 6
    got = T.morans_i_of_tree(wide, T.closure(wide), spark.range(n).select(F.concat(F.lit("s"), "id").alias("node"), ((F.col("id") * F.col("id")) % 101 + (F.col("id") % k) * 3.0).alias("x")))
    assert got.first()[0] == pytest.approx(total / weight, rel=1e-9)


def test_trees_reject_what_is_none(spark):
    with pytest.raises(T.TreeError):
        T.validate(spark.createDataFrame([("a", None, 0.0), ("b", None, 0.0)], TREE))
    with pytest.raises(T.TreeError):
        T.validate(spark.createDataFrame([("a", None, 0.0), ("b", "z", 0.0)], TREE))


def test_collapse_and_prune(spark):
    t = tree(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("b", "d"), ("a", "e"), ("e", "f")])
    once = {r.node: (r.parent, r.length) for r in T.collapse_unifurcations(t, T.closure(t)).collect()}
    assert once == {"r": (None, 0.0), "b": ("r", 2.0), "c": ("b", 1.0), "d": ("b", 1.0), "f": ("r", 3.0)}
    gone = spark.createDataFrame([("c",), ("d",)], "node string")
    assert {r.node for r in T.prune(t, T.closure(t), gone).collect()} == {"r", "a", "e", "f"}


def test_robinson_foulds(spark):
    one = tree(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)] + [(n, 2 * n + 1) for n in range(3, 7)] + [(n, 2 * n + 2) for n in range(3, 7)])
    assert tuple(T.robinson_foulds(one, one).first()) == (0, 10)


def test_closure_of_a_deep_tree(spark):
    t = tree(spark, [(i, i + 1) for i in range(70)])
    assert T.node_times(T.closure(t)).agg(F.max("depth"), F.max("time")).first() == (70, 70.0)


def test_neighbor_joining_recovers_an_additive_tree():
    import numpy as np

    # a and b, c and d are the cherries of the unrooted tree
    d = np.array([[0, 3, 7, 8], [3, 0, 8, 9], [7, 8, 0, 3], [8, 9, 3, 0]], float)
    assert set(agglomerate.cherries(d, "nj")[0]) in ({0, 1}, {2, 3})
    first = agglomerate.cherries(d, "upgma")
    assert set(first[0]) == {0, 1} and len(first) == 3


def test_hybrid_tree_loses_no_cell_when_rounds_run_out(spark):
    cells = spark.createDataFrame([(i, [int(k < i) for k in range(5)]) for i in range(6)], "cell int, states array<int>")
    with pytest.raises(RuntimeError):
        greedy.hybrid_tree(cells, cutoff=1, rounds=2)


def test_hybrid_tree_holds_every_cell_once(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 0, 1, 2]) for _ in range(8)]) for i in range(120)] + [(200, [1] * 8), (201, [1] * 8)]
    got = greedy.hybrid_tree(spark.createDataFrame(rows, "cell int, states array<int>"), cutoff=10)
    T.validate(got)
    names = {r.node.rstrip("'") for r in T.leaves(got).collect()}
    assert {str(i) for i, _ in rows} <= names | {r.parent for r in got.collect()}


def test_lineage_groups(spark):
    rows = [(f"c{i}", b) for i in range(12) for b in ("AB" if i < 8 else "XY")]
    got = {r.cell: r.lineage for r in clones.call_lineage_groups(spark.createDataFrame(rows, "cell string, intbc string"), cluster_prop=0.1).collect()}
    assert got == {f"c{i}": 1 if i < 8 else 2 for i in range(12)}
    m = spark.createDataFrame(rows, "cell string, intbc string")
    lineages = spark.createDataFrame(list(got.items()), "cell string, lineage int")
    assert clones.filter_inter_doublets(m, lineages).count() == len(rows)


def test_radius_graph_and_imputation(spark):
    xy = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 10.0), ("c", 10.0, 0.0), ("d", 90.0, 100.0)], "cell string, x double, y double")
    graph = spatial.radius_graph(xy, 15.0)
    assert graph.count() == 6
    cells = spark.createDataFrame([("a", [-1, 1]), ("b", [2, -1]), ("c", [2, 3]), ("d", [5, -1])], "cell string, states array<int>")
    got = {(r.cell, r.character): r.state for r in spatial.impute(cells, graph, 0.8, 1).collect()}
    assert got[("a", 0)] == 2 and got[("b", 1)] == -1 and got[("d", 1)] == -1


def test_transition_counts(spark):
    t = tree(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7), (3, 8), (4, 9), (4, 10), (5, 11), (5, 12), (6, 13), (6, 14)])
    labels = spark.createDataFrame([(str(7 + i), c) for i, c in enumerate("AGAACAGG")], "node string, label string")
    got = {(r.s1, r.s2): round(r.n, 6) for r in T.transition_counts(t, T.closure(t), labels).collect()}
    assert got == {("A", "A"): 9, ("A", "G"): 2, ("A", "C"): 1, ("G", "G"): 2}
