"""Readers and writers of sequence and tree files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number in the file, however Spark splits the files.

    Lines are counted by split, the counts are summed up over a file's splits in order, and each line adds its place in its split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("least")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, seq, qual) of FASTQ files, plain or compressed, four lines a record."""
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    at = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    records = lines.groupBy("file", "record").agg(at(0).alias("head"), at(1).alias("seq"), at(3).alias("qual"))
    return records.where("head IS NOT NULL").select("file", "record", F.regexp_extract("head", r"^@(\S+)", 1).alias("name"), "seq", "qual")


#: Where cell barcode and UMI stand: (file of the pair, start, length) from 0. Fixed values of the chemistries.
CHEMISTRIES = {"dropseq": ((0, 0, 12), (0, 12, 8)), "10xv2": ((0, 0, 16), (0, 16, 10)), "10xv3": ((0, 0, 16), (0, 16, 12)), "slideseq2": ((0, 0, 14), (0, 14, 9))}


def tag_reads(first: DataFrame, second: DataFrame, chemistry: str) -> DataFrame:
    """(name, cell_raw, cell_qual, umi_raw, umi_qual, seq, qual): barcodes of the first read of a pair, sequence of the second."""
    if chemistry not in CHEMISTRIES:
        raise ValueError(f"unknown chemistry {chemistry}")
    pair = [d.select("name", F.col("seq").alias(f"s{i}"), F.col("qual").alias(f"q{i}")) for i, d in enumerate((first, second))]
    cut = lambda kind, where: F.substring(f"{kind}{where[0]}", where[1] + 1, where[2])
    cell, umi = CHEMISTRIES[chemistry]
    return pair[0].join(pair[1], "name").select("name", cut("s", cell).alias("cell_raw"), cut("q", cell).alias("cell_qual"), cut("s", umi).alias("umi_raw"), cut("q", umi).alias("umi_qual"), F.col("s1").alias("seq"), F.col("q1").alias("qual"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(name, flag, ref, pos, cigar, seq, qual, tags) of SAM text; tags is a map, header lines go."""
    f = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.filter(F.slice(f, 12, 10_000), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1_000_000))))
    return spark.read.text(path).where("value <> '' AND NOT value LIKE '@%'").select(f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("ref"), f[3].cast("int").alias("pos"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"))


def molecules_of_names(reads: DataFrame, name: str = "name") -> DataFrame:
    """Add cell, umi, reads and flag, which a collapsed read's name joins by underscores."""
    f = F.split(name, "_")
    return reads.withColumns({"cell": f[0], "umi": f[1], "reads": f[2].cast("long"), "flag": F.get(f, F.lit(3))})


def cell_tag(reads: DataFrame) -> str:
    """CB if any read carries the corrected tag, else CR."""
    return "CB" if reads.where(F.array_contains(F.map_keys("tags"), "CB")).take(1) else "CR"


def read_fasta(spark: SparkSession, path: str) -> str:
    """The first record's sequence, upper case; a reference of one record is small."""
    lines = [r.value.strip() for r in numbered_lines(spark, path).orderBy("file", "line").select("value").limit(100_000).toLocalIterator()]
    out: list[str] = []
    for line in lines:
        if line.startswith(">"):
            if out:
                break
        elif line:
            out.append(line)
    return "".join(out).upper()


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(intbc): one entry a line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("intbc")).where("intbc <> ''").distinct()


def newick_nodes(text: str) -> list[tuple[str, str | None, float]]:
    """(node, parent, length) of one Newick string; unnamed inner nodes are numbered in the order they close."""
    out: list[tuple[str, str | None, float]] = []
    waiting: list[list[int]] = []
    last: list[int] = []
    unnamed, at, text = 0, 0, text.strip()
    while at < len(text) and text[at] != ";":
        mark = text[at]
        if mark in "(,":
            if mark == "(":
                waiting.append([])
            at += 1
            continue
        if mark == ")":
            last = waiting.pop()
            at += 1
        else:
            last = []
        stop = at
        while stop < len(text) and text[stop] not in "(),;":
            stop += 1
        name, _, length = text[at:stop].strip().partition(":")
        if not name:
            name, unnamed = f"inner{unnamed}", unnamed + 1
        for child in last:
            out[child] = (out[child][0], name, out[child][2])
        out.append((name, None, float(length) if length else 1.0 if waiting else 0.0))
        if waiting:
            waiting[-1].append(len(out) - 1)
        at = stop
    return out


def read_newick(trees: DataFrame, id_col: str = "tree", newick_col: str = "newick") -> DataFrame:
    """(tree, node, parent, length) of many trees, one string a row."""
    rows = F.udtf(_NewickRows, returnType="node string, parent string, length double")
    session = trees.sparkSession
    session.udtf.register("newick_nodes", rows)
    return session.sql(f"SELECT t.`{id_col}` AS tree, n.* FROM {{t}} t, LATERAL newick_nodes(t.`{newick_col}`) n", t=trees)


class _NewickRows:
    def eval(self, newick: str):
        if newick:
            yield from newick_nodes(newick)


def to_newick(tree: DataFrame, paths: DataFrame, lengths: bool = False) -> DataFrame:
    """(newick): bottom-up, one aggregation a level; children stand by name."""
    from cladeworks.operators.trees import node_times
    from cladeworks.sources.scratch import written

    depth = written(tree.join(node_times(paths), "node").select("node", "parent", "length", "depth"), "newick")
    deepest = depth.agg(F.max("depth")).first()[0]
    own = (F.concat("node", F.lit(":"), F.col("length").cast("string")) if lengths else F.col("node"))
    below = None
    for level in range(deepest, -1, -1):
        here = depth.where(F.col("depth") == level)
        if below is not None:
            here = here.join(below, "node", "left").withColumn("text", F.concat(F.when(F.col("inner").isNotNull(), F.concat(F.lit("("), "inner", F.lit(")"))).otherwise(F.lit("")), own))
        else:
            here = here.withColumn("text", own)
        if level == 0:
            return here.select(F.concat("text", F.lit(";")).alias("newick"))
        below = written(here.groupBy(F.col("parent").alias("node")).agg(F.concat_ws(",", F.array_sort(F.collect_list("text"))).alias("inner")), "newick")
    raise ValueError("an empty tree has no Newick form")


def to_phylip(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, row): a lower triangle with the diagonal, four decimals, tab separated. ``pairs``: a, b, d with a < b."""
    rows = pairs.select(F.col("b").alias("cell"), F.col("a").alias("other"), "d").union(cells.select("cell", "cell", F.lit(0.0)))
    return rows.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("other", "d"))).alias("r")).select("cell", F.concat_ws("\t", F.array_insert(F.transform("r", lambda e: F.format_string("%.4f", e["d"])), 1, F.col("cell").cast("string"))).alias("row"))
