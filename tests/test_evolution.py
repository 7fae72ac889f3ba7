"""Coupling, rates and likelihoods against brute force."""

import itertools
import math

import pytest

from cladeworks.operators import evolution as E
from cladeworks.operators import pairs
from cladeworks.operators import trees as T
from cladeworks.solve import agglomerate

TREE = [("r", None, 0.0), ("x", "r", 0.5), ("a", "x", 0.3), ("b", "x", 0.4), ("c", "r", 0.7), ("d", "x", 0.2)]
CELLS = {"a": [1, 1, 0, -1, -1], "b": [1, 2, 0, 1, -1], "c": [1, 0, 0, -1, -1], "d": [1, -1, 2, 1, -1]}
P = {1: 0.6, 2: 0.4}


def brute(character, rate, lost):
    inner, total = ["r", "x"], 0.0
    parent = {n: (p, t) for n, p, t in TREE if p}
    for states in itertools.product([0, 1, 2], repeat=6):
        s = dict(zip(["r", "x", "a", "b", "c", "d"], states))
        if s["r"] != 0:
            continue
        p = 1.0
        for n, (up, t) in parent.items():
            stay = math.exp(-rate * t)
            p *= (stay if s[n] == 0 else (1 - stay) * P[s[n]]) if s[up] == 0 else float(s[n] == s[up])
        for n, row in CELLS.items():
            p *= lost if row[character] == -1 else (1 - lost) * (row[character] == s[n])
        total += p
    assert inner
    return math.log(total)


def test_likelihood(spark):
    t = spark.createDataFrame(TREE, "node string, parent string, length double")
    cells = spark.createDataFrame(list(CELLS.items()), "node string, states array<int>")
    priors = spark.createDataFrame([(c, s, p) for c in range(5) for s, p in P.items()], "character int, state int, p double")
    got = {r.character: r.loglik for r in E.log_likelihood(t, T.closure(t), cells, priors, 0.8, 0.2).collect()}
    assert got == {c: pytest.approx(brute(c, 0.8, 0.2)) for c in range(5)}


def test_mutation_rate(spark):
    t = spark.createDataFrame(TREE, "node string, parent string, length double")
    paths = T.closure(t)
    assert E.mutation_rate(t, paths, 0.5, root_branch=False) == pytest.approx(-math.log(0.5) / ((0.8 + 0.9 + 0.7 + 0.7) / 4))
    assert E.mutation_rate(t, paths, 0.5, continuous=False, root_branch=False) == pytest.approx(1 - 0.5 ** (1 / 1.75))


def test_coupling_tells_near_groups_from_far_ones(spark):
    cells = spark.createDataFrame([(i, [i % 2 + 1] * 4 + [i % 3]) for i in range(24)], "cell int, states array<int>")
    groups = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(24)], "cell int, grp string")
    got = {(r.g1, r.g2): r for r in E.coupling(pairs.dissimilarity_map(cells), groups, 60).collect()}
    assert got[("a", "a")].z < -2 and got[("b", "b")].z < -2 and got[("a", "b")].z > 2
    assert E.coupling(pairs.dissimilarity_map(cells), groups, 5, min_share=0.6).count() == 0


def test_coupling_in_blocks_equals_coupling_of_pairs(spark):
    cells = spark.createDataFrame([(i, [i % 2 + 1] * 4 + [i % 3, i % 5 - 1]) for i in range(50)], "cell int, states array<int>")
    groups = spark.createDataFrame([(i, "abcd"[i % 3 if i else 3]) for i in range(50)], "cell int, grp string")
    pairwise = {(r.g1, r.g2): (r.d, r.z) for r in E.coupling(pairs.dissimilarity_map(cells), groups, 70).collect()}
    blocked = {(r.g1, r.g2): (r.d, r.z) for r in E.coupling_of(cells, groups, 70, size=12).collect()}
    assert set(blocked) == set(pairwise) == {(g, h) for g in "abc" for h in "abc" if g <= h}
    assert all(blocked[k] == pytest.approx(pairwise[k]) for k in pairwise)
    assert E.coupling_of(cells, groups, 5, min_share=0.6).count() == 0


def test_registered_coupling_has_the_reference_background(spark, monkeypatch):
    import inspect

    from cladeworks.plans import bindings

    given = []
    monkeypatch.setattr(bindings, "cm", lambda *_: spark.createDataFrame([(0, [1]), (1, [2])], "cell int, states array<int>"))
    signature = inspect.signature(E.coupling)

    def coupling(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        given.append(bound.arguments["shuffles"])

    monkeypatch.setattr(E, "coupling", coupling)
    bindings.QUERIES["evolutionary_coupling"](spark, "/root/testdata/sf0.001")
    assert given == [500]


def test_shuffled_labels_are_permutations(spark):
    groups = spark.createDataFrame([(i, "aab"[i % 3]) for i in range(30)], "cell int, grp string")
    shuffled = E.shuffled_labels(groups, 7)
    assert "row_number" not in shuffled._jdf.queryExecution().toString()
    got = {r.cell: r.labels for r in shuffled.collect()}
    assert all(got[i][0] == "aab"[i % 3] for i in range(30))
    assert all(sorted(x[s] for x in got.values()) == ["a"] * 20 + ["b"] * 10 for s in range(8))
    assert len({tuple(got[i][s] for i in range(30)) for s in range(8)}) == 8


def test_shared_mutation_joining():
    import numpy as np

    states = np.array([[1, 1, 0, 0], [1, 1, 2, 0], [0, 3, 0, 4], [0, -1, 0, 4]])
    assert agglomerate.shared_cherries(states)[:2] == [(0, 1), (2, 3)]
