"""Lineage groups: cells that share barcodes, called one group a round, each round a few aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.sources.scratch import written


def fractions(molecules: DataFrame) -> DataFrame:
    """(cell, intbc, frac): a barcode's share of its cell's molecules."""
    counts = molecules.where("cell IS NOT NULL AND intbc IS NOT NULL").groupBy("cell", "intbc").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("cell").agg(F.sum("n").alias("total"))
    return counts.join(totals, "cell").select("cell", "intbc", (F.col("n") / F.col("total")).alias("frac"))


def top_group(frac: DataFrame, min_prop: float, kinship: float) -> tuple[DataFrame, DataFrame]:
    """The cells (cell) and barcodes (intbc) of the next group: around the barcode of largest total share, ties to the smaller name."""
    top = frac.groupBy("intbc").agg(F.round(F.sum("frac"), 9).alias("s")).agg(F.min_by("intbc", F.struct(-F.col("s"), "intbc"))).first()[0]
    having = frac.where(F.col("intbc") == F.lit(top)).select("cell")
    n = having.count()
    members = frac.join(having, "cell", "left_semi").groupBy("intbc").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_prop * n).select("intbc")
    cells = frac.join(members, "intbc", "left_semi").groupBy("cell").agg(F.round(F.sum("frac"), 9).alias("s")).where(F.col("s") >= kinship).select("cell")
    return cells, members


def assign_groups(frac: DataFrame, min_size: int, min_prop: float = 0.2, kinship: float = 0.2, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(cell, grp) and (grp, intbc): groups are taken off until one of at most ``min_size`` cells has been."""
    rest, cells, sets = written(frac, "fractions"), None, None
    for grp in range(rounds):
        if not rest.take(1):
            break
        own, barcodes = (written(x, "group") for x in top_group(rest, min_prop, kinship))
        cells = (lambda x: x if cells is None else written(cells.union(x), "groups"))(own.withColumn("grp", F.lit(grp)))
        sets = (lambda x: x if sets is None else written(sets.union(x), "group-sets"))(barcodes.select(F.lit(grp).alias("grp"), "intbc"))
        if own.count() <= min_size:
            break
        rest = written(rest.join(own, "cell", "left_anti"), "fractions")
    else:
        if rest.take(1):
            raise RuntimeError(f"groups are left after {rounds} rounds")
    if cells is None:
        empty = frac.sparkSession.createDataFrame
        return empty([], "cell " + frac.schema["cell"].dataType.simpleString() + ", grp int"), empty([], "grp int, intbc " + frac.schema["intbc"].dataType.simpleString())
    return cells, sets


def group_barcodes(frac: DataFrame, cells: DataFrame, min_share: float = 0.2) -> DataFrame:
    """(grp, intbc): barcodes that at least ``min_share`` as many of the group's cells hold as hold its commonest one."""
    held = frac.join(cells, "cell").groupBy("grp", "intbc").agg(F.count_distinct("cell").alias("n"))
    return held.join(held.groupBy("grp").agg(F.max("n").alias("most")), "grp").where(F.col("n") >= min_share * F.col("most")).select("grp", "intbc")


def kinship(frac: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, grp): the group whose barcodes make up most of the cell, ties to the smaller group."""
    score = frac.join(sets, "intbc").groupBy("cell", "grp").agg(F.round(F.sum("frac"), 9).alias("s"))
    return score.groupBy("cell").agg(F.max_by("grp", F.struct("s", -F.col("grp"))).alias("grp"))


def renamed(cells: DataFrame) -> DataFrame:
    """(cell, lineage): groups numbered from 1 by size, the larger old number first among equals."""
    sizes = written(cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    # one row a group: the numbering sorts groups, not cells
    order = sizes.select("grp", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("grp"))).alias("lineage"))
    return cells.join(order, "grp").select("cell", "lineage")


def call_lineage_groups(molecules: DataFrame, cluster_prop: float = 0.005, min_prop: float = 0.2, kinship_thresh: float = 0.2, min_share: float = 0.2) -> DataFrame:
    """(cell, lineage) of every cell that joined a group."""
    frac = written(fractions(molecules), "fractions")
    n = frac.select("cell").distinct().count()
    cells, _ = assign_groups(frac, int(cluster_prop * n), min_prop, kinship_thresh)
    sets = group_barcodes(frac, cells, min_share)
    return renamed(written(kinship(frac.join(cells.select("cell"), "cell", "left_semi"), sets), "kinships"))


def presence(molecules: DataFrame, lineages: DataFrame) -> DataFrame:
    """(lineage, intbc, dropout): one less the share of the lineage's cells that hold the barcode."""
    sizes = lineages.groupBy("lineage").agg(F.count_distinct("cell").alias("size"))
    held = molecules.join(lineages, "cell").groupBy("lineage", "intbc").agg(F.count_distinct("cell").alias("n"))
    return held.join(sizes, "lineage").select("lineage", "intbc", (1 - F.col("n") / F.col("size")).alias("dropout"))


def membership(molecules: DataFrame, present: DataFrame) -> DataFrame:
    """(cell, lineage, share): how well a cell's barcodes fit each lineage, corrected for dropout, as shares of the cell's total."""
    total = present.groupBy("lineage").agg((F.count(F.lit(1)) - F.sum("dropout")).alias("all"))
    cells = molecules.select("cell", "intbc").where("cell IS NOT NULL AND intbc IS NOT NULL").distinct()
    each = cells.join(present, "intbc").groupBy("cell", "lineage").agg((F.count(F.lit(1)) - F.sum("dropout")).alias("held")).join(total, "lineage")
    each = each.select("cell", "lineage", F.try_divide("held", "all").alias("raw"))
    return each.join(each.groupBy("cell").agg(F.sum("raw").alias("sum")), "cell").select("cell", "lineage", F.try_divide("raw", "sum").alias("share"))


def filter_inter_doublets(molecules: DataFrame, lineages: DataFrame, rule: float = 0.35) -> DataFrame:
    """Molecules of cells whose share in their own lineage reaches the rule."""
    own = membership(molecules, presence(molecules, lineages)).join(lineages, ["cell", "lineage"]).where(F.col("share") >= rule)
    return molecules.join(own.select("cell"), "cell", "left_semi")


def filter_final_barcodes(molecules: DataFrame, lineages: DataFrame, share: float = 0.05, control: str = "NC") -> DataFrame:
    """Molecules, with their lineage, whose barcode more than ``share`` of the lineage's cells hold and which is not the control."""
    own = molecules.join(lineages, "cell")
    sizes = own.groupBy("lineage").agg(F.count_distinct("cell").alias("size"))
    held = own.groupBy("lineage", "intbc").agg(F.count_distinct("cell").alias("n")).join(sizes, "lineage").where((F.col("n") > F.lit(float(share)) * F.col("size")) & (F.col("intbc") != control))
    return own.join(held.select("lineage", "intbc"), ["lineage", "intbc"], "left_semi")
