"""Drawn triplets against the list of all triplets of small trees."""

import itertools
from collections import Counter

from cladeworks.operators import trees as T
from cladeworks.operators import triplets

EDGES = [("r", "x"), ("r", "y"), ("r", "l1"), ("x", "l2"), ("x", "l3"), ("x", "z"), ("z", "l4"), ("z", "l5"), ("z", "l6"), ("y", "l7"), ("y", "l8")]


def tree_of(spark, edges, root="r"):
    return spark.createDataFrame([(root, None, 0.0)] + [(c, p, 1.0) for p, c in edges], "node string, parent string, length double")


def line(up, n):
    out = [n]
    while n in up:
        n = up[n]
        out.append(n)
    return out


def all_triplets(edges):
    """frozenset of leaves -> (depth of their common ancestor, the leaf outside the closest pair or None)."""
    up = {c: p for p, c in edges}
    tips = [c for c in up if c not in up.values()]
    out = {}
    for three in itertools.combinations(sorted(tips), 3):
        common = {}
        for a, b in itertools.combinations(three, 2):
            common[a, b] = len(set(line(up, a)) & set(line(up, b)))
        best = max(common.values())
        pairs = [k for k, v in common.items() if v == best]
        depth = min(common.values()) - 1
        out[frozenset(three)] = depth, next(iter(set(three) - set(pairs[0]))) if len(pairs) == 1 else None
    return out


def test_counts_of_kinds_add_up_to_all_triplets(spark):
    t = tree_of(spark, EDGES)
    paths = T.closure(t)
    kinds = triplets.triplet_kinds(t, paths, triplets.leaf_numbers(t, paths)).collect()
    want = Counter((d, o is not None) for d, o in all_triplets(EDGES).values())
    got = Counter()
    for k in kinds:
        got[k.depth, k.pair == 1] += k.n
    assert got == want


def test_more_triplets_than_a_long_counts(spark):
    t = tree_of(spark, [("r", "x"), ("r", "y"), ("x", "a"), ("x", "b"), ("y", "c"), ("y", "d")])
    numbers = spark.createDataFrame([("a", 0), ("b", 2_999_999), ("c", 3_000_000), ("d", 8_999_999)], "node string, at long")  # the ends of 3 and 6 million leaves
    kinds = {(k.child, k.pair): k.n for k in triplets.triplet_kinds(t, T.closure(t), numbers).collect()}
    x, y = 3_000_000, 6_000_000
    assert kinds["x", 1] == x * (x - 1) // 2 * y and kinds["y", 1] == y * (y - 1) // 2 * x and kinds["y", 1] > 1 << 63


def test_every_triplet_of_a_depth_is_as_likely(spark):
    t = tree_of(spark, EDGES)
    paths, known = T.closure(t), all_triplets(EDGES)
    trials = 3000
    rows = triplets.sample_triplets(t, paths, trials, seed=4).collect()
    per_depth = Counter(d for d, _ in known.values())
    assert Counter(r.depth for r in rows) == {d: trials for d in per_depth}
    seen = Counter()
    for r in rows:
        three = frozenset((r.a, r.b, r.c))
        assert known[three] == (r.depth, r.out)
        seen[three] += 1
    for three, (depth, _) in known.items():
        expected = trials / per_depth[depth]
        assert abs(seen[three] - expected) < 6 * expected**0.5 + 3
    again = triplets.sample_triplets(t.repartition(3), paths, trials, seed=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_shares_by_depth(spark):
    t = tree_of(spark, EDGES)
    other = tree_of(spark, [e for e in EDGES if e not in (("x", "l2"), ("z", "l6"))] + [("z", "l2"), ("x", "l6")])
    paths = T.closure(t)
    samples = triplets.sample_triplets(t, paths, 400)
    same = {r.depth: tuple(r)[1:4] for r in triplets.triplets_correct_by_depth(samples, paths).collect()}
    assert set(same) == {0, 1, 2} and all(s == (1, 1, 1) for s in same.values())
    changed = {r.depth: r for r in triplets.triplets_correct_by_depth(samples, T.closure(other)).collect()}
    assert 0 < changed[1].correct < 1 and changed[2].unresolvable == 1 and changed[2].correct == 0
