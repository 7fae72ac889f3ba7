"""Golden values and edge cases of molecule and character operators."""

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import characters as C
from cladeworks.operators import molecules as M

MOLS = "cell string, umi string, reads long, seq string"
READS = [("cell1", "UMIA", 9, "AATCCG"), ("cell1", "UMIA", 20, "AAGGTT"), ("cell1", "UMIC", 11, "CCATTA"), ("cell2", "UMIA", 2, "ATACTG"), ("cell2", "UMIB", 1, "GGGAAT"), ("cell3", "UMIA", 40, "TTTCCTT"), ("cell3", "UMIB", 30, "CCAATTG")]


def test_resolve_umi(spark):
    df = spark.createDataFrame(READS, MOLS)
    got = {(r.cell, r.umi): (r.seq, r.reads) for r in M.resolve_umi_sequence(df, 1, 2).collect()}
    assert got == {("cell1", "UMIA"): ("AAGGTT", 20), ("cell1", "UMIC"): ("CCATTA", 11), ("cell3", "UMIA"): ("TTTCCTT", 40), ("cell3", "UMIB"): ("CCAATTG", 30)}
    assert {r.cell for r in M.resolve_umi_sequence(df, 1, 30).collect()} == {"cell3"}
    assert M.resolve_umi_sequence(df.limit(0), 1, 2).count() == 0


def test_whitelist(spark):
    seen = ["ACTT", "TAAG", "ACTA", "GCTT", "AAGG", "AAGN", "TACT", "TNNG", "ANNN", "NNNN", "AAAA", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seen)], "id int, intbc string")
    white = spark.createDataFrame([("ACTT",), ("TAAG",)], "intbc string")
    assert {seen[r.id]: r.intbc for r in M.correct_to_whitelist(df, white).collect()} == {"ACTT": "ACTT", "TAAG": "TAAG", "ACTA": "ACTT", "GCTT": "ACTT"}


TABLE = "cell string, intbc string, allele string, umi string, reads long"


def test_umi_correction(spark):
    rows = [("A", "b", "x", "AACCT", 10), ("A", "b", "x", "AACCG", 30), ("A", "b", "x", "AACCC", 30), ("A", "b", "x", "GGGGG", 5), ("B", "b", "x", "AACCG", 40)]
    got = {(r.cell, r.umi): r.reads for r in M.correct_umis(spark.createDataFrame(rows, TABLE), 2).collect()}
    assert got == {("A", "AACCG"): 70, ("A", "GGGGG"): 5, ("B", "AACCG"): 40}
    assert M.correct_umis(spark.createDataFrame(rows, TABLE), 0).count() == 5


def test_barcode_correction_is_strict_and_takes_the_nearest_rank(spark):
    rows = [("A", b, "x", f"{b}{i}", 1) for b, n in (("TA", 2), ("AA", 2), ("CA", 1), ("GG", 9)) for i in range(n)]
    got = sorted({(r.umi[:2], r.intbc) for r in M.correct_intbcs(spark.createDataFrame(rows, TABLE)).collect()})
    # two against two is no minority; CA is nearest in rank to the lower of the two that have more
    assert got == [("AA", "AA"), ("CA", "TA"), ("GG", "GG"), ("TA", "TA")]
    with pytest.raises(M.ParameterError):
        M.correct_intbcs(spark.createDataFrame(rows, TABLE), prop=0.7)


def test_doublets_keep_the_threshold_itself(spark):
    rows = [("A", "T", a, str(i), 1) for i, a in enumerate("1122")] + [("C", "A", a, str(i), 1) for i, a in enumerate("33322")]
    df = spark.createDataFrame(rows, TABLE)
    assert {r.cell for r in M.filter_intra_doublets(df, 0.4).collect()} == {"C"}
    assert M.map_intbcs(df).where("cell = 'C'").count() == 3


def test_quality(spark):
    df = spark.createDataFrame([("IIII",), ("II*I",), ("",), (None,)], "q string")
    assert [r.q for r in M.quality_filter(df, ["q"], 10).collect()] == ["IIII", ""]


ALLELES = "cell string, intbc string, r1 string, r2 string, r3 string"
ROWS = [("cellA", "A", "None", "None", "ATC"), ("cellA", "B", "ATC", "AAA", "TTT"), ("cellA", "C", "GGG", "GAA", "ATA"), ("cellB", "A", "None", "None", "ATA"), ("cellC", "C", "GAA", "GAA", "ATA")]


def test_character_matrix(spark):
    df = spark.createDataFrame(ROWS, ALLELES)
    keys = [b + s for b in "ABC" for s in ("r1", "r2", "r3")]
    got = {r.cell: r.states for r in C.wide(C.character_matrix(df, ["r1", "r2", "r3"]), keys).collect()}
    assert got == {"cellA": [0, 0, 1, 1, 1, 1, 1, 1, 1], "cellB": [0, 0, 2] + [-1] * 6, "cellC": [-1] * 6 + [2, 1, 1]}
    more = C.character_matrix(spark.createDataFrame([*ROWS, ("cellA", "A", "None", "ACT", None)], ALLELES), ["r1", "r2", "r3"])
    assert more.where("cell = 'cellA' AND character = 'Ar2'").first().states == [0, 1]


def test_priors(spark):
    p = {r.indel: r.freq for r in C.indel_priors(spark.createDataFrame(ROWS, ALLELES), ["r1", "r2", "r3"], ["intbc"]).collect()}
    assert p["ATC"] == pytest.approx(2 / 3) and "None" not in p
    bad = spark.createDataFrame([("x", 1.5)], "indel string, freq double")
    with pytest.raises(C.ParameterError):
        C.prior_weights(bad)


def test_bootstrap_repeats_itself(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5, 6])], "cell string, states array<int>")
    one, two = (sorted(map(tuple, C.bootstrap(df, 3, 4, seed=3).select("sample", "cell", F.concat_ws(",", F.col("states").cast("array<string>"))).collect())) for _ in range(2))
    assert one == two and len(one) == 8
