"""Cells in the plane: neighbour graphs and imputation from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.characters import MISSING
from cladeworks.sources.scratch import written


def radius_graph(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance), both directions, of points (cell, x, y) within ``radius``. Points meet in grid squares of that width, so only neighbours are compared."""
    at = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("gx", F.floor(F.col("x") / radius)).withColumn("gy", F.floor(F.col("y") / radius))
    near = F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy"))))))
    left = at.select(F.col("cell").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), near.alias("g")).select("a", "xa", "ya", "g.gx", "g.gy")
    right = at.select(F.col("cell").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "gx", "gy")
    square = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    return left.join(right, ["gx", "gy"]).where(F.col("a") != F.col("b")).withColumn("square", square).where(F.col("square") <= radius * radius).select("a", "b", F.sqrt("square").alias("distance"))


def within_hops(graph: DataFrame, hops: int) -> DataFrame:
    """(a, b): nodes up to ``hops`` edges apart, without the node itself."""
    edges = graph.select("a", "b").distinct()
    reach = edges
    for _ in range(hops - 1):
        reach = written(reach.union(reach.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))).where("a <> b").distinct(), "hops")
    return reach


def impute(cells: DataFrame, neighbours: DataFrame, concordance: float = 0.8, rounds: int = 2) -> DataFrame:
    """(cell, character, state): missing entries take the commonest state among neighbours, ties to the smaller, if its share reaches ``concordance`` and it is a cut.

    ``cells``: cell, states; ``neighbours``: a, b. All entries of a round are decided on the states of the round before.
    """
    known = written(cells.select("cell", F.posexplode("states").alias("character", "state")), "entries")
    for _ in range(rounds):
        gaps = known.where(F.col("state") == MISSING).select(F.col("cell").alias("a"), "character")
        votes = gaps.join(neighbours, "a").join(known.where(F.col("state") != MISSING).select(F.col("cell").alias("b"), "character", "state"), ["b", "character"]).groupBy("a", "character", "state").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a", "character").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("state")).alias("less"))).alias("m"))
        filled = best.where((F.col("m.n") >= concordance * F.col("all")) & (F.col("m.less") != 0)).select(F.col("a").alias("cell"), "character", (-F.col("m.less")).alias("new"))
        known = written(known.join(filled, ["cell", "character"], "left").select("cell", "character", F.coalesce("new", "state").alias("state")), "entries")
    return known
