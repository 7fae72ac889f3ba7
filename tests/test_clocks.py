"""Node times under a clock against a direct recursion over single states and against closed forms."""

import math
from functools import lru_cache

import numpy as np
import pytest

from cladeworks.operators import clocks

SCHEMA = "node string, parent string, cuts int, present int"


def brute(nodes, r, lam, s, steps):
    """log joints of inner nodes, in plain probabilities, one state at a time."""
    parent = {n: p for n, p, _, _ in nodes}
    cuts = {n: c for n, _, c, _ in nodes}
    known = {n: k for n, _, _, k in nodes}
    children = {n: [c for c in parent if parent[c] == n] for n in parent}
    root, dt = next(n for n in parent if parent[n] is None), 1 / steps
    lost = [0.0] * steps + [1 - s]
    for t in range(steps - 1, -1, -1):
        lost[t] = (1 - lam * dt) * lost[t + 1] + lam * dt * lost[t + 1] ** 2

    def valid(v, x):
        return x == 0 if v == root else cuts[parent[v]] <= x <= cuts[v]

    @lru_cache(None)
    def down(v, t, x):
        if not valid(v, x):
            return 0.0
        if t == steps:
            return s if not children[v] and x == cuts[v] else 0.0
        p = (1 - lam * dt - (known[v] - x) * r * dt + 2 * lam * dt * lost[t + 1]) * down(v, t + 1, x)
        p += (known[v] - x) * r * dt * down(v, t + 1, x + 1)
        if x == cuts[v] and children[v]:
            p += lam * dt * math.prod(down(c, t + 1, x) for c in children[v])
        return p

    @lru_cache(None)
    def up(v, t, x):
        if not valid(v, x):
            return 0.0
        if v == root:
            return float(t == 0)
        if t == 0:
            return 0.0
        p = (1 - lam * dt - (known[v] - x) * r * dt + 2 * lam * dt * lost[t - 1]) * up(v, t - 1, x)
        p += (known[v] - (x - 1)) * r * dt * up(v, t - 1, x - 1)
        if x == cuts[parent[v]]:
            p += lam * dt * up(parent[v], t - 1, x) * math.prod(down(c, t, x) for c in children[parent[v]] if c != v)
        return p

    top = children[root][0]
    return {v: [up(v, t, cuts[v]) * math.prod(down(c, t, cuts[v]) for c in children[v]) for t in range(steps + 1)] for v in parent if v != root and children[v]}, down(top, 0, 0)


SMALL = [("0", None, 0, 9), ("1", "0", 2, 8), ("2", "1", 4, 6), ("3", "1", 3, 5)]
MEDIUM = [("0", None, 0, 2), ("1", "0", 0, 2), ("2", "1", 1, 2), ("3", "2", 1, 2), ("4", "2", 2, 2), ("5", "1", 1, 2)]


@pytest.mark.parametrize("nodes,r,lam,s,steps", [(SMALL, 0.3, 1.5, 0.1, 60), (SMALL, 0.3, 0.5, 1.0, 40), (MEDIUM, 0.625, 0.75, 0.1, 100)])
def test_log_joints_equal_a_direct_recursion(spark, nodes, r, lam, s, steps):
    want, total = brute(nodes, r, lam, s, steps)
    table = spark.createDataFrame(nodes, SCHEMA)
    post = clocks.posterior_times(table, r, lam, s, steps)
    got = {x.node: x for x in post.collect()}
    assert set(got) == set(want)
    for v, joint in want.items():
        assert np.allclose(np.exp(got[v].log_joint), joint, rtol=1e-9, atol=0)
        assert np.allclose(got[v].posterior, np.array(joint) / sum(joint), rtol=1e-9)
        assert got[v].mean == pytest.approx(sum(t * p for t, p in enumerate(joint)) / sum(joint) / steps, abs=1e-9)
    assert math.exp(clocks.log_likelihood(post, "1").first().loglik) == pytest.approx(total, rel=1e-2)
    times = {x.node: x for x in clocks.clock_lengths(table, post).collect()}
    assert times["0"].time == 0 and times["3"].time == 1 and all(x.length >= 0 for x in times.values())
    for x in times.values():
        if x.parent:
            assert x.length == pytest.approx(x.time - times[x.parent].time)


def test_posterior_mean_of_one_division_equals_its_closed_form(spark):
    """One character, cut above the division: the density of the time is known, up to its factor."""
    r, lam, s = 0.3, 1.5, 0.1
    nodes = [("0", None, 0, 1), ("1", "0", 1, 1), ("2", "1", 1, 1), ("3", "1", 1, 1)]
    mean = clocks.posterior_times(spark.createDataFrame(nodes, SCHEMA), r, lam, s, 1000).first()["mean"]
    t = np.linspace(0, 1, 20001)
    # a lineage that starts with time x to go and leaves exactly one sampled cell: s e^(lam x) / (1 + s (e^(lam x) - 1))^2 is for its descent from one
    left = lambda x: s * np.exp(-lam * x) / (s + (1 - s) * np.exp(-lam * x)) ** 2
    above = np.exp(0.0) * left(1.0) / left(1 - t)
    density = lam * above * left(1 - t) ** 2 * (1 - np.exp(-r * t))
    assert mean == pytest.approx(float((density * t).sum() / density.sum()), abs=2e-3)


def test_bad_trees_and_steps_are_refused(spark):
    fine = spark.createDataFrame(SMALL, SCHEMA)
    with pytest.raises(ValueError, match="steps"):
        clocks.posterior_times(fine, 1.0, 1.0, 1.0, 2)
    with pytest.raises(ValueError, match="sampling"):
        clocks.posterior_times(fine, 0.1, 1.0, 0.0)
    for rows in ([("0", None, 0, 1), ("1", "0", 1, 1), ("2", "0", 0, 1)], [("0", None, 0, 1), ("1", "0", 1, 1), ("2", "1", 1, 1)]):
        with pytest.raises(ValueError, match="child"):
            clocks.posterior_times(spark.createDataFrame(rows, SCHEMA), 0.1, 1.0, 1.0)
    with pytest.raises(ValueError, match="along"):
        clocks.posterior_times(spark.createDataFrame([*SMALL[:3], ("3", "1", 1, 5)], SCHEMA), 0.1, 1.0, 1.0)


def test_cuts_are_counted_from_states(spark):
    tree = spark.createDataFrame([("0", None), ("1", "0")], "node string, parent string")
    states = spark.createDataFrame([("0", [0, 0, 0]), ("1", [2, -1, 0])], "node string, states array<int>")
    assert {tuple(r) for r in clocks.cut_counts(tree, states).collect()} == {("0", None, 0, 3), ("1", "0", 1, 2)}
