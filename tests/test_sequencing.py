"""Consensus, alignment and allele calling."""

import pytest

from cladeworks.operators import sequencing as S
from cladeworks.operators import trees as T
from tests.test_trees import tree

REF = "AATTGGCCTTAACCGGATCTGACTAGCATCGGATATCGCTAAGCTTGGCATTCCGATACGT"


def score(ref, seq, cigar, q, r):
    total, at = 0, ""
    for ch in cigar:
        if ch.isdigit():
            at += ch
            continue
        n, at = int(at), ""
        if ch == "M":
            total += sum(5 if seq[q + k] == ref[r + k] else -4 for k in range(n))
            q, r = q + n, r + n
        else:
            total -= 20 + (n - 1)
            q, r = (q + n, r) if ch == "I" else (q, r + n)
    return total


@pytest.mark.parametrize("seq", [REF, REF[:25] + REF[33:], REF[:30] + "TTTTTTT" + REF[30:], "GG" + REF[5:50], REF[:20] + "C" + REF[21:40] + REF[43:]])
def test_local_alignment(seq):
    cigar, q, r, best = S.align_local(REF, seq)
    assert score(REF, seq, cigar, q, r) == best
    if len(seq) < len(REF) and seq[:25] == REF[:25]:
        assert "8D" in cigar


def test_alleles(spark):
    rows = [(1, REF, ), (2, REF[:28] + REF[34:]), (3, REF[:30] + "GGG" + REF[30:])]
    df = S.align(spark.createDataFrame(rows, "id int, seq string"), REF)
    got = {r.id: r for r in S.call_alleles(df, barcode=(4, 10), sites=(30, 50), width=4, context=0).collect()}
    assert all(r.intbc == REF[4:10] for r in got.values())
    assert got[1].r1 == got[1].r2 == "None" and got[1].allele == "NoneNone"
    assert got[2].r1.endswith("6D") and got[2].r2 == "None" and got[3].r1.endswith("3I")
    assert "[None]" in S.call_alleles(df, barcode=(4, 10), sites=(30,)).where("id = 1").first().r1


def test_consensus(spark):
    reads = [("c", "ACGT", "IIII"), ("c", "ACGA", "III#"), ("c", "ACTT", "II#I"), ("d", "AC", "II"), ("d", "AG", "II")]
    got = {r.cell: (r.seq, r.qual, r.n) for r in S.consensus(spark.createDataFrame(reads, "cell string, seq string, qual string"), ["cell"]).collect()}
    assert got["c"] == ("ACGT", "@@@@", 3) and got["d"] == ("AN", "@#", 2)


def test_triplets(spark):
    one = tree(spark, [("r", "x"), ("r", "c"), ("x", "a"), ("x", "b")])
    two = tree(spark, [("r", "x"), ("r", "a"), ("x", "c"), ("x", "b")])
    three = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string")
    p1, p2 = T.closure(one), T.closure(two)
    assert T.outgroups(three, p1).first().out == "c"
    assert T.triplets_correct(three, p1, p2).first()[0] == 0 and T.triplets_correct(three, p1, p1).first()[0] == 1


def test_missing_rates():
    assert T.missing_rates(0.19, stochastic=0.1)[0] == pytest.approx(0.10536, abs=1e-4)
    with pytest.raises(T.TreeError):
        T.missing_rates(0.1)
