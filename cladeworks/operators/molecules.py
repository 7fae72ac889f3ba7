"""Molecule tables: filters, sequence resolution, barcode and UMI correction, doublets, allele mapping.

A molecule table has a row for each molecule (or UMI sequence): cell, umi, intbc, allele, reads, and for some operators
seq. All operators are DataFrame expressions. Similar strings are found by joining on shared fragments, so no group is ever
expanded into all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ParameterError(ValueError):
    """A parameter outside its range."""


def quality_filter(reads: DataFrame, columns: list[str], threshold: int = 10) -> DataFrame:
    """Reads whose every base quality (PHRED, offset 33) in ``columns`` reaches the threshold; a null quality fails, an empty one passes."""
    keep = F.lit(True)
    for name in columns:
        keep &= F.coalesce(F.forall(F.split(name, ""), lambda c: (c == "") | (F.ascii(c) - 33 >= threshold)), F.lit(False))
    return reads.where(keep)


def filter_umis(molecules: DataFrame, min_reads: int = 100) -> DataFrame:
    """Molecules with at least ``min_reads`` reads."""
    return molecules.where(F.col("reads") >= min_reads)


def dynamic_min_reads(molecules: DataFrame) -> int:
    """A tenth of the 99th percentile of reads, rounded down; 0 for an empty table."""
    top = molecules.agg(F.percentile("reads", 0.99).alias("p")).first().p
    return int(top // 10) if top is not None else 0


def cell_counts(molecules: DataFrame) -> DataFrame:
    """(cell, n_umi, n_reads)."""
    return molecules.where("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n_umi"), F.sum("reads").alias("n_reads"))


def filter_cells(molecules: DataFrame, min_umi: int = 10, min_avg_reads: float = 2.0) -> DataFrame:
    """Molecules of cells with enough molecules and enough reads a molecule; molecules without a cell go."""
    good = cell_counts(molecules).where((F.col("n_umi") >= min_umi) & (F.col("n_reads") >= F.lit(float(min_avg_reads)) * F.col("n_umi")))
    return molecules.join(good.select("cell"), "cell", "left_semi")


def resolve_umi_sequence(molecules: DataFrame, min_umi: int = 10, min_avg_reads: float = 2.0) -> DataFrame:
    """Of the sequences of a (cell, umi) the one with most reads stays, with its own count; ties go to the smaller sequence. Then cells are filtered."""
    others = [c for c in molecules.columns if c not in ("cell", "umi", "reads", "seq")]
    best = molecules.where("cell IS NOT NULL AND umi IS NOT NULL").groupBy("cell", "umi").agg(F.min(F.struct((-F.col("reads")).alias("less"), "seq", *others)).alias("b"))
    best = best.select("cell", "umi", "b.seq", (-F.col("b.less")).alias("reads"), *[F.col(f"b.{c}").alias(c) for c in others])
    return filter_cells(best, min_umi, min_avg_reads).select(*molecules.columns)


def deletions(text: Column, distance: int) -> Column:
    """All strings that ``text`` becomes by deleting up to ``distance`` characters: two strings within that edit distance share one."""
    level = F.array(text)
    every = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        every = F.array_union(every, level)
    return every


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, distance: int, on: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` with Levenshtein(a, b) <= distance and equal ``on``, with the distance as ``d``."""
    on = on or []
    fragments = left.withColumn("fragment", F.explode(deletions(F.col(a), distance))).join(right.withColumn("fragment", F.explode(deletions(F.col(b), distance))), [*on, "fragment"]).drop("fragment")
    return fragments.dropDuplicates().withColumn("d", F.levenshtein(a, b)).where(F.col("d") <= distance)


def correct_to_whitelist(molecules: DataFrame, whitelist: DataFrame, distance: int = 1) -> DataFrame:
    """Barcodes on the whitelist stay; others become their single nearest entry within ``distance``; ties, misses and nulls go.

    ``whitelist`` has a column intbc.
    """
    entries = whitelist.select(F.col("intbc").alias("entry")).where("entry IS NOT NULL").distinct()
    seen = molecules.select("intbc").where("intbc IS NOT NULL").distinct()
    near = near_pairs(seen, entries, "intbc", "entry", distance).groupBy("intbc", "d").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry"))
    best = near.groupBy("intbc").agg(F.min(F.struct("d", "n", "entry")).alias("b")).where("b.d = 0 OR b.n = 1").select("intbc", F.col("b.entry").alias("entry"))
    return molecules.join(best, "intbc").withColumn("intbc", F.col("entry")).select(*molecules.columns)


def correct_intbcs(molecules: DataFrame, prop: float = 0.5, umi_thresh: int = 10, distance: int = 1) -> DataFrame:
    """Within (cell, allele) a barcode with few molecules takes the name of a similar, more frequent one.

    Barcodes are ranked by molecules, then by name. A barcode is renamed if the share n2 / (n1 + n2) is below ``prop`` and n2 is at
    most ``umi_thresh``; of several such partners the lowest-ranked one wins. Names are not followed further.
    """
    if not 0 <= prop <= 0.5:
        raise ParameterError("prop must lie in [0, 0.5]")
    counts = molecules.where("intbc IS NOT NULL").groupBy("cell", "allele", "intbc").agg(F.count(F.lit(1)).alias("n"))
    small = counts.where(F.col("n") <= umi_thresh).select("cell", "allele", "intbc", F.col("n").alias("n2"))
    large = counts.select("cell", "allele", F.col("intbc").alias("partner"), F.col("n").alias("n1"))
    pairs = near_pairs(small, large, "intbc", "partner", distance, ["cell", "allele"])
    # with prop up to a half the partner always has more molecules
    pairs = pairs.where((F.col("intbc") != F.col("partner")) & (F.col("n2") < F.lit(float(prop)) * (F.col("n1") + F.col("n2"))))
    last = pairs.groupBy("cell", "allele", "intbc").agg(F.max_by("partner", F.struct(-F.col("n1"), "partner")).alias("partner"))
    return molecules.join(last, ["cell", "allele", "intbc"], "left").withColumn("intbc", F.coalesce("partner", "intbc")).select(*molecules.columns)


def correct_umis(molecules: DataFrame, distance: int = 2, by_allele: bool = False, rounds: int = 40) -> DataFrame:
    """Within (cell, intbc), or (cell, intbc, allele), a UMI is merged into the most abundant UMI of equal length within Hamming ``distance``; chains are followed to their end.

    UMIs are ranked by reads, then by name, both descending. The surviving row keeps its own columns and gets the chain's
    reads. Candidates share one of ``distance + 1`` pieces of the UMI. UMIs must be unique in their group.
    """
    if distance == 0:
        return molecules
    group = ["cell", "intbc", *["allele"] * by_allele]
    rows = molecules.select(*group, "umi", "reads")
    size = F.length("umi")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(i.alias("i"), size.alias("size"), F.substring("umi", (F.floor(i * size / (distance + 1)) + 1).cast("int"), (F.floor((i + 1) * size / (distance + 1)) - F.floor(i * size / (distance + 1))).cast("int")).alias("piece")))
    keyed = rows.withColumn("key", F.explode(pieces))
    ahead = keyed.select(*group, "key", F.col("umi").alias("umi1"), F.col("reads").alias("reads1"))
    apart = F.size(F.filter(F.zip_with(F.split("umi", ""), F.split("umi1", ""), lambda x, y: x != y), lambda d: d))
    pairs = keyed.join(ahead, [*group, "key"]).where(F.struct("reads1", "umi1") > F.struct("reads", "umi")).where(apart <= distance)
    target = pairs.groupBy(*group, "umi").agg(F.max(F.struct("reads1", "umi1")).alias("t")).select(*group, "umi", F.col("t.umi1").alias("target"))
    from cladeworks.sources.scratch import written

    target = written(target, "umi-targets")
    for _ in range(rounds):
        step = target.select(*group, F.col("umi").alias("target"), F.col("target").alias("next"))
        jumped = written(target.join(step, [*group, "target"], "left").select(*group, "umi", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")), "umi-targets")
        target = jumped.drop("moved")
        if not jumped.where("moved").take(1):
            break
    sums = rows.join(target, [*group, "umi"], "left").groupBy(*group, F.coalesce("target", "umi").alias("umi")).agg(F.sum("reads").alias("total"))
    return molecules.join(sums, [*group, "umi"]).withColumn("reads", F.col("total")).select(*molecules.columns)


def allele_counts(molecules: DataFrame) -> DataFrame:
    """(cell, intbc, allele, n_umi, n_reads); rows without a barcode or allele go."""
    named = molecules.where("cell IS NOT NULL AND intbc IS NOT NULL AND allele IS NOT NULL")
    return named.groupBy("cell", "intbc", "allele").agg(F.count(F.lit(1)).alias("n_umi"), F.sum("reads").alias("n_reads"))


def conflict_share(molecules: DataFrame) -> DataFrame:
    """(cell, share): the share of a cell's molecules that are not of their barcode's main allele."""
    each = allele_counts(molecules).groupBy("cell", "intbc").agg(F.sum("n_umi").alias("total"), F.max("n_umi").alias("most"))
    return each.groupBy("cell").agg(((F.sum("total") - F.sum("most")) / F.sum("total")).alias("share"))


def filter_intra_doublets(molecules: DataFrame, prop: float = 0.1) -> DataFrame:
    """Molecules of cells whose conflicting share is at most ``prop``."""
    return molecules.join(conflict_share(molecules).where(F.col("share") <= prop).select("cell"), "cell", "left_semi")


def map_intbcs(molecules: DataFrame) -> DataFrame:
    """Molecules of each (cell, intbc)'s main allele: most molecules, then most reads, then the smaller name. Null barcodes go."""
    best = allele_counts(molecules).groupBy("cell", "intbc").agg(F.min(F.struct((-F.col("n_umi")).alias("u"), (-F.col("n_reads")).alias("r"), "allele")).alias("b"))
    return molecules.join(best.select("cell", "intbc", F.col("b.allele").alias("allele")), ["cell", "intbc", "allele"], "left_semi")


def filter_molecule_table(molecules: DataFrame, min_umi: int = 10, min_avg_reads: float = 2.0, min_reads: int = -1, prop: float = 0.5, umi_thresh: int = 10, distance: int = 1, doublet_threshold: float | None = 0.35, allow_conflicts: bool = False) -> DataFrame:
    """Reads and cell filters, barcode correction, doublet filter and allele mapping, in this order; adds status 'good'."""
    m = filter_umis(molecules, dynamic_min_reads(molecules) if min_reads < 0 else min_reads)
    m = filter_cells(m, min_umi, min_avg_reads)
    if distance > 0:
        m = correct_intbcs(m, prop, umi_thresh, distance)
    if doublet_threshold is not None and not allow_conflicts:
        m = filter_intra_doublets(m, doublet_threshold)
    if not allow_conflicts:
        m = map_intbcs(m)
    return m.withColumn("status", F.lit("good"))


def umis_per_cell(molecules: DataFrame) -> DataFrame:
    return molecules.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def umis_per_intbc(molecules: DataFrame) -> DataFrame:
    return molecules.groupBy("cell", "intbc").agg(F.count(F.lit(1)).alias("n"))


def allele_table(molecules: DataFrame, sites: list[str]) -> DataFrame:
    """(cell, intbc, allele, sites..., n_umi, n_reads): molecules folded into alleles."""
    return molecules.groupBy("cell", "intbc", "allele", *sites).agg(F.count(F.lit(1)).alias("n_umi"), F.sum("reads").alias("n_reads"))


def second_share(molecules: DataFrame) -> DataFrame:
    """(cell, umi, top, second): the two largest read counts of the sequences of a (cell, umi); second is null for one sequence."""
    ranked = molecules.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "umi").orderBy(F.desc("reads"), "seq")))
    return ranked.where("rank <= 2").groupBy("cell", "umi").agg(F.max(F.when(F.col("rank") == 1, F.col("reads"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("reads"))).alias("second"))


def correct_cells(reads: DataFrame, whitelist: DataFrame, least: float = 0.975) -> DataFrame:
    """Add ``cell`` to reads (raw, qual): the barcode itself if it is listed, else the listed one at one difference whose posterior reaches ``least``, else null.

    A candidate's weight is its prior, one more than the reads that show it exactly, times the chance of an error at the
    differing base, 10 ** (-q / 10). Candidates meet by barcodes with one place masked. ``whitelist``: cell.
    """
    listed = whitelist.select("cell").where("cell IS NOT NULL").distinct()
    prior = listed.join(reads.groupBy(F.col("raw").alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cell", "left").select("cell", (F.coalesce("n", F.lit(0)) + 1).alias("prior"))
    masks = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.struct(i.alias("i"), F.concat(F.substring(c, F.lit(1), i - 1), F.lit("*"), F.substring(c, i + 1, F.length(c))).alias("mask")))
    odd = reads.select("raw", "qual").where("raw IS NOT NULL AND qual IS NOT NULL").distinct().join(listed.withColumnRenamed("cell", "raw"), "raw", "left_anti")
    asked = odd.select("raw", "qual", F.explode(masks(F.col("raw"))).alias("m"))
    near = asked.join(prior.select("cell", "prior", F.explode(masks(F.col("cell"))).alias("m")), "m")
    weight = F.col("prior") * F.pow(F.lit(10.0), -(F.ascii(F.substring("qual", F.col("m.i"), F.lit(1))) - 33) / 10)
    ranked = near.select("raw", "qual", "cell", weight.alias("w")).groupBy("raw", "qual").agg(F.max(F.struct("w", "cell")).alias("best"), F.sum("w").alias("all"))
    found = ranked.where(F.col("best.w") >= F.lit(float(least)) * F.col("all")).select("raw", "qual", F.col("best.cell").alias("__near"))
    exact = listed.select(F.col("cell").alias("raw"), F.col("cell").alias("__own"))
    return reads.join(exact, "raw", "left").join(found, ["raw", "qual"], "left").withColumn("cell", F.coalesce("__own", "__near")).drop("__own", "__near")
