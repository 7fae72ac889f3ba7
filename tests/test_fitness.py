"""Fitness of nodes: order in a known tree, and a recursion over one node at a time with matrices and short steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.operators.fitness import inferred_fitness

KNOWN = [("root", None, 0.0), ("i1", "root", 0.25), ("i2", "i1", 0.25), ("i3", "i1", 0.25), *((f"l{i}", "i2" if i < 4 else "i3", 0.5) for i in range(1, 6))]
UNEVEN = [("r", None, 0.0), ("a", "r", 0.4), ("b", "r", 1.0), ("c", "a", 0.3), ("d", "a", 0.9), ("e", "c", 0.2), ("f", "c", 0.35), ("g", "c", 0.5)]


def brute(rows, unit, h=0.004, d=0.2, eps=0.01):
    x = np.linspace(-4, 8, 49)
    dx = 0.25
    m = np.zeros((49, 49))
    for i in range(1, 48):
        m[i, i - 1] += d / dx**2 + 0.5 / dx
        m[i, i] -= 2 * d / dx**2
        m[i, i + 1] += d / dx**2 - 0.5 / dx
    m[0, 0], m[0, 1], m[48, 48], m[48, 47] = 1 / dx, -1 / dx, -1 / dx, 1 / dx

    def rk(f, y, k):
        a = f(y, 0)
        b = f(y + k / 2 * a, k / 2)
        c = f(y + k / 2 * b, k / 2)
        return np.maximum(y + k / 6 * (a + 2 * b + 2 * c + f(y + k * c, k)), 1e-20)

    phi = [np.full(49, eps)]
    while len(phi) * h < 60:
        phi.append(rk(lambda y, _: m @ y + x * y - y * y, phi[-1], h))
    phi = np.array(phi)

    def chance(t):
        at = t / h
        i = int(at)
        return phi[i] + (at - i) * (phi[i + 1] - phi[i])

    def propagator(t, end):
        y = np.eye(49)[:, 4:-4] / dx
        n = max(1, int(np.ceil((end - t) / h)))
        k = (end - t) / n
        for i in range(n):
            y = rk(lambda p, s: m @ p + (x - 2 * chance(t + i * k + s))[:, None] * p, y, k)
        return y

    parent = {n: p for n, p, _ in rows}
    length = {n: b for n, _, b in rows}
    kids = {n: [c for c in parent if parent[c] == n] for n in parent}
    depth = lambda n: length[n] + (depth(parent[n]) if parent[n] else 0)
    leaves = lambda n: sum((leaves(c) for c in kids[n]), []) or [n]
    near = {n: np.mean([depth(v) for v in leaves(n)]) - depth(n) if kids[n] else 0 for n in parent}
    ways = {n: propagator(near[n] / unit, (near[n] + length[n] + 1e-7) / unit) for n in parent}
    shares = lambda v: v / v.sum()

    def up(n):
        here = shares(np.prod([up(c) for c in kids[n]], axis=0) if kids[n] else np.ones(49))
        return np.maximum(ways[n] @ here[4:-4], 1e-20)

    def down(n):
        if parent[n] is None:
            return np.exp(-x * x / 2)
        above = shares(down(parent[n]) * np.prod([up(c) for c in kids[parent[n]] if c != n], axis=0))
        out = np.full(49, 1e-20)
        out[4:-4] = np.maximum(ways[n].T @ above, 1e-20)
        return out

    return {n: shares(down(n) * np.prod([up(c) for c in kids[n]], axis=0)) @ x for n in parent}


def fitness(spark, rows, **options):
    tree = spark.createDataFrame(rows, "node string, parent string, length double").withColumn("fitness", F.lit("other"))
    return {r.node: r.fitness for r in inferred_fitness(tree, **options).collect()}


def test_order_in_a_known_tree(spark):
    got = fitness(spark, KNOWN)
    assert got["i2"] > got["i3"] and got["l1"] > got["l4"] and got["i2"] > got["l1"] and got["i3"] > got["l4"]
    assert got["l1"] == pytest.approx(got["l2"]) and got["l2"] == pytest.approx(got["l3"]) and got["l4"] == pytest.approx(got["l5"])
    # 25 ordered pairs: six meet half before the present and four of i3's likewise, twelve a quarter earlier, five leaves meet themselves
    unit = 0.2 * ((6 + 2) * 0.5 + 12 * 0.75 + 5 * 0.5) / 25
    want = brute(KNOWN, unit)
    assert {n: pytest.approx(v, abs=0.02) for n, v in want.items()} == got


def test_uneven_tree_equals_brute_force(spark):
    want = brute(UNEVEN, 0.15)
    assert {n: pytest.approx(v, abs=2e-3) for n, v in want.items()} == fitness(spark, UNEVEN, time_scale=0.15, dt=0.01)


def test_trees_that_have_no_answer(spark):
    with pytest.raises(ValueError, match="one root"):
        fitness(spark, [("a", None, 0.0), ("b", None, 0.0)])
    with pytest.raises(ValueError, match="no length"):
        fitness(spark, [("a", None, 0.0), ("b", "a", None), ("c", "a", 0.0)])
