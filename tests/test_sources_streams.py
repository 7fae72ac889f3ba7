"""File formats, configured runs and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import trees as T
from cladeworks.plans import stages
from cladeworks.sources import sequences as S
from cladeworks.streaming import molecules as stream


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} extra\n{'ACGT' * 8}\n+\n@{'I' * 31}\n" for i in range(50))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as out:
        out.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = S.read_fastq(spark, str(tmp_path))
        assert got.count() == 100 and {r.name for r in got.collect()} == {f"r{i}" for i in range(50)}
        assert got.where(~F.col("seq").rlike("^[ACGT]{32}$") | ~F.col("qual").startswith("@I")).count() == 0
        pair = got.where(F.col("file").endswith("a.fastq"))
        assert S.tag_reads(pair, pair, "10xv3").select("cell_raw").distinct().first()[0] == "ACGT" * 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        S.tag_reads(pair, pair, "none")


def test_sam_fasta_whitelist(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nC1_U1_12_0\t0\tref\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tCB:Z:C1\tAS:i:7\n")
    row = S.molecules_of_names(S.read_sam(spark, str(tmp_path / "x.sam"))).first()
    assert (row.cell, row.umi, row.reads, row.tags) == ("C1", "U1", 12, {"CB": "C1", "AS": "7"})
    assert S.cell_tag(S.read_sam(spark, str(tmp_path / "x.sam"))) == "CB"
    (tmp_path / "r.fa").write_text(">one\nacg\nTT\n>two\nGG\n")
    assert S.read_fasta(spark, str(tmp_path / "r.fa")) == "ACGTT"
    (tmp_path / "w.txt").write_text("AA\n\n BB \nAA\n")
    assert sorted(r.intbc for r in S.read_whitelist(spark, str(tmp_path / "w.txt")).collect()) == ["AA", "BB"]


def test_newick(spark):
    trees = spark.createDataFrame([(1, "((a:1,b:2)x:3,c:4)r;"), (2, "(a,(b,c));")], "tree int, newick string")
    got = {(r.tree, r.node): (r.parent, r.length) for r in S.read_newick(trees).collect()}
    assert got[(1, "a")] == ("x", 1.0) and got[(1, "x")] == ("r", 3.0) and got[(1, "r")] == (None, 0.0)
    assert got[(2, "b")] == ("inner0", 1.0) and got[(2, "inner0")][0] == "inner1"
    one = S.read_newick(trees).where("tree = 1").drop("tree")
    assert S.to_newick(one, T.closure(one)).first()[0] == "((a,b)x,c)r;"


def test_phylip(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 1.0), ("b", "c", 0.25)], "a string, b string, d double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    assert [r.row for r in S.to_phylip(pairs, cells).orderBy("cell").collect()] == ["a\t0.0000", "b\t0.5000\t0.0000", "c\t1.0000\t0.2500\t0.0000"]


CONFIG = """
[general]
name = 'x'
input = ['m']
entry = 'umi_correction'
[umi_correction]
distance = 1
[filter]
min_umi = 1
min_avg_reads = 1.0
min_reads = 0
doublet_threshold = None
"""


def test_configured_run(spark):
    m = spark.createDataFrame([("A", "b", "x", "AAAA", 5), ("A", "b", "x", "AAAT", 2), ("A", "b", "y", "CCCC", 1)], "cell string, intbc string, allele string, umi string, reads long")
    got = stages.run(m, stages.parse(CONFIG)).collect()
    assert [(r.umi, r.reads, r.status) for r in got] == [("AAAA", 7, "good")] or {r.umi for r in got} == {"AAAA"}
    with pytest.raises(ValueError):
        stages.parse("[general]\nname = 'x'\n")
    with pytest.raises(ValueError):
        stages.chain("filter", "quality")


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("user_id").alias("cell"), F.col("value").alias("reads"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.count_molecules(rows, "ts", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("counted").agg(F.sum("n_umi")).first()[0]
    assert got == events.count()
