"""Collapsing of reads, barcode correction, ambiguous states and cell graphs against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.operators import characters as C
from cladeworks.operators import collapse
from cladeworks.operators import graphs as G
from cladeworks.operators import molecules as M
from cladeworks.operators.sequencing import align_global


def consensus(reads):
    out = []
    for i in range(max(len(s) for _, s, _ in reads)):
        votes = defaultdict(list)
        for _, s, q in reads:
            if i < len(s):
                votes[s[i]].append(ord(q[i]) - 33)
        ranked = sorted(((sum(x >= 30 for x in v), len(v), sum(v) / len(v), b) for b, v in votes.items()), reverse=True)
        tie = len(ranked) > 1 and ranked[0][:3] == ranked[1][:3]
        majority = ranked[0][1] * 2 > sum(r[1] for r in ranked)
        out.append(("N", 2) if tie else (ranked[0][3], 31 if majority and ranked[0][0] else 10))
    return "".join(b for b, _ in out), "".join(chr(33 + q) for _, q in out)


def brute_clusters(reads, radius):
    out = []
    while reads:
        if len(reads) == 1:
            return [*out, (*reads[0][1:], 1)]
        seq, n = Counter(s for _, s, _ in sorted(reads)).most_common(1)[0]
        seed = seq if n > 1 else consensus(reads)[0]
        near = [r for r in reads if sum(a != b and ord(q) - 33 >= 20 for a, b, q in zip(seed, r[1], r[2])) <= radius]
        if not near:
            return out + [(s, q, 1) for _, s, q in reads]
        out.append((*consensus(near), len(near)))
        reads = [r for r in reads if r not in near]
    return out


@pytest.fixture(scope="module")
def reads():
    rng = np.random.default_rng(3)
    rows = []
    for cell in "AB":
        for umi in range(6):
            kinds = ["".join(rng.choice(list("ACGT"), 14)) for _ in range(int(rng.integers(1, 4)))]
            for k in range(int(rng.integers(1, 14))):
                s = list(kinds[int(rng.integers(len(kinds)))])
                for at in rng.choice(14, int(rng.integers(0, 3)), replace=False):
                    s[at] = str(rng.choice(list("ACGT")))
                rows.append((cell, f"u{umi}", len(rows), "".join(s), "".join(chr(33 + int(x)) for x in rng.choice([5, 15, 25, 35, 40], 14))))
    return rows


SCHEMA = "cell string, umi string, read long, seq string, qual string"


def test_clusters(spark, reads):
    groups = defaultdict(list)
    for cell, umi, *r in reads:
        groups[cell, umi].append(tuple(r))
    want = sorted((c, u, *x) for (c, u), some in groups.items() for x in brute_clusters(some, 2))
    got = sorted((r.cell, r.umi, r.seq, r.qual, r.n) for r in collapse.form_clusters(spark.createDataFrame(reads, SCHEMA), 2).collect())
    assert got == want


@pytest.mark.parametrize("method", ["cutoff", "likelihood"])
def test_collapse_counts_every_read(spark, reads, method):
    odd = [("A", None, 900, "ACG", "III"), ("A", "u0", 901, None, None), (None, "u0", 902, "ACG", "III"), ("C", "u0", 903, "ACG", "II")]
    got = collapse.collapse_umis(spark.createDataFrame(reads + odd, SCHEMA), 2, 2, method, many=10).collect()
    total = Counter((c, u) for c, u, *_ in reads)
    seen = Counter()
    for r in got:
        seen[r.cell, r.umi] += r.n
    assert seen == total
    for key in total:
        mine = sorted((r for r in got if (r.cell, r.umi) == key), key=lambda r: int(r.id.rstrip("+")))
        assert mine[0].id.rstrip("+") == "0" and all("+" not in r.id for r in mine[1:])
    assert collapse.collapse_umis(spark.createDataFrame([], SCHEMA), 2, 2, method).count() == 0


def test_small_clusters_join_the_largest(spark):
    rows = [("A", "u", 0, "ACGTACGTACGTACGT", "I" * 16, 9), ("A", "u", 1, "ACGTACGTTACGTACGT", "I" * 17, 2), ("A", "u", 2, "TTTTGGGGCCCCAAAA", "I" * 16, 3), ("A", "v", 0, "ACGTACGT", "I" * 8, 2), ("A", "v", 1, "ACGTACGA", "I" * 8, 2)]
    df = spark.createDataFrame([(c, u, k, None, s, q, n) for c, u, k, s, q, n in rows], "cell string, umi string, cluster int, read long, seq string, qual string, n long")
    got = sorted((r.umi, r.id, r.n) for r in collapse.merge_clusters(df, 1, 2).collect())
    assert got == [("u", "0+", 11), ("u", "1", 3), ("v", "0", 2), ("v", "1", 2)]


def test_global_alignment():
    assert align_global("ACGTACGTTTGACCA", "ACGTACGTTTGACCA")[:3] == ("15M", 0, 0)
    assert align_global("ACGTACGTACTTGACCATGACCAA", "TACGTACTTGACCA")[:3] == ("14M", 0, 3)
    left, right = "ACGGTCATTGCA" * 2, "TTGACCGATGCA" * 2
    assert align_global(left + "GGATC" + right, left + right)[0] == "24M5D24M"
    assert align_global(left + right, left + "GG" + right)[0] == "24M2I24M"
    assert align_global("AACCGGTTACGTAA", "CCGGTTACGTAA", free=False)[:3] == ("2D12M", 0, 0)
    assert align_global("ACGT", "TTTT", free=False)[0] == "4M" and align_global("ACGT", "", free=False)[0] == "4D"
    assert align_global("CCCCACGTACGTAA", "ACGTACGTAAGGGG")[:3] == ("10M", 0, 4)


def test_cells_are_corrected_by_quality(spark):
    low, high = "".join(chr(33 + q) for q in (40, 40, 40, 2)), "IIII"
    rows = [("AAAA", high)] * 50 + [("CCCC", high)] * 2 + [("AAAC", low), ("AAGG", high), ("CCCA", high), (None, high), ("AACA", None)]
    got = {(r.raw, r.qual): r.cell for r in M.correct_cells(spark.createDataFrame(rows, "raw string, qual string"), spark.createDataFrame([("AAAA",), ("CCCC",), ("AACC",)], "cell string")).collect()}
    assert got[("AAAA", high)] == "AAAA" and got[("AAGG", high)] is None and got[("CCCA", high)] == "CCCC" and got[(None, high)] is None and got[("AACA", None)] is None
    assert got[("AAAC", low)] == "AAAA"


def test_ambiguous_states(spark):
    m = spark.createDataFrame([("a", "x", [3, 1, 3, 2]), ("a", "y", [2]), ("b", "x", [5, 4])], "cell string, character string, states array<int>")
    assert {(r.cell, r.character): r.state for r in C.resolve_ambiguous(m).collect()} == {("a", "x"): 3, ("a", "y"): 2, ("b", "x"): 4}
    assert {(r.cell, r.character): r.state for r in C.resolve_ambiguous(m, F.array_max).collect()} == {("a", "x"): 3, ("a", "y"): 2, ("b", "x"): 5}
    assert sorted(r.states for r in C.collapse_ambiguous(m).collect()) == [[1, 2, 3], [2], [4, 5]]
    assert {r.cell: r.ambiguous for r in C.ambiguous_cells(m).collect()} == {"a": True, "b": True} and C.unravel(m).count() == 7


def test_percolation(spark):
    rng = np.random.default_rng(5)
    cells = [(c, i) for c in "pq" for i in range(9)] + [("one", 0), ("bare", 0), ("bare", 1)]
    graph = [(c, a, b, float(rng.integers(1, 6))) for c in "pq" for a, b in combinations(range(9), 2) if rng.random() < 0.7]

    def parts(c, least):
        root = {i: i for k, i in cells if k == c}
        for _ in root:
            for k, a, b, w in graph:
                if k == c and w > least:
                    root[a] = root[b] = min(root[a], root[b])
        return root

    want = set()
    for c in ("p", "q", "one", "bare"):
        for least in range(0, 6):
            root = parts(c, least)
            if len(set(root.values())) > 1 or len(root) < 2:
                break
        want |= {(c, i, r) for i, r in root.items()}
    got = G.percolate(spark.createDataFrame(cells, "clade string, cell long"), spark.createDataFrame(graph, "clade string, a long, b long, w double"))
    assert set(map(tuple, got.collect())) == want


def test_max_cut_moves_raise_the_cut(spark):
    rng = np.random.default_rng(7)
    edges = spark.createDataFrame([(a, b, float(rng.normal())) for a, b in combinations(range(12), 2)], "a long, b long, w double").cache()
    sides = spark.createDataFrame([(i, int(rng.integers(2))) for i in range(12)], "cell long, side int")
    better = G.max_cut_improve(edges, sides)
    assert G.evaluate_cut(edges, better).first().w >= G.evaluate_cut(edges, sides).first().w
    assert G.move_gains(edges, better).where("gain > 1e-6").count() == 0 and better.count() == 12


def test_a_row_of_the_map_must_be_whole(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 3.0)], "a long, b long, d double")
    new = spark.createDataFrame([(1, 9.0), (3, 8.0)], "other long, d double")
    assert {(r.a, r.b): r.d for r in G.set_dissimilarities(pairs, 2, new).collect()} == {(1, 2): 9.0, (1, 3): 2.0, (2, 3): 8.0}
    with pytest.raises(ValueError):
        G.set_dissimilarities(pairs, 2, new.where("other = 1"))
