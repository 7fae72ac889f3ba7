"""Triplets of leaves drawn by the depth of their common ancestor, as many trials as wanted in one job.

The leaves of every clade stand side by side in one numbering of all leaves. A triplet below a node, not all in one
child, has either two leaves in one child and one elsewhere, or its middle leaf in a child between the two others. So a
row a child and kind, with the number of its triplets, can be drawn by prefix sums, and leaves by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.order import prefix_sums
from cladeworks.operators.trees import layout, leaves, node_times, outgroups
from cladeworks.sources.scratch import written


def leaf_numbers(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, at): leaves numbered from 0 along the tree."""
    return layout(tree, paths).join(leaves(tree), "node", "left_semi").select("node", F.col("x").cast("long").alias("at"))


def triplet_kinds(tree: DataFrame, paths: DataFrame, numbers: DataFrame) -> DataFrame:
    """(depth, node, child, pair, n, lo, hi, first, last): the triplets below a node that have two leaves in the child (``pair``) or their middle leaf there; the child's leaves are lo to hi, the node's first to last."""
    spans = paths.join(numbers, "node").groupBy(F.col("ancestor").alias("node")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    depths = node_times(paths).select("node", "depth")
    over = spans.join(depths, "node").select(F.col("node").alias("parent"), F.col("lo").alias("first"), F.col("hi").alias("last"), "depth")
    child = tree.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent").join(spans.withColumnRenamed("node", "child"), "child").join(over, "parent")
    k = F.col("hi") - F.col("lo") + 1
    rest = F.col("last") - F.col("first") + 1 - k
    # the triplets of millions of leaves are more than a long counts
    whole = lambda c: c.cast("decimal(12,0)")
    two, one, below, above = F.expr("(hi - lo + 1) * (hi - lo) div 2").cast("decimal(19,0)"), whole(k), whole(F.col("lo") - F.col("first")), whole(F.col("last") - F.col("hi"))
    pairs = child.withColumn("pair", F.lit(1)).withColumn("n", (two * whole(rest)).cast("decimal(38,0)"))
    middles = child.withColumn("pair", F.lit(0)).withColumn("n", (one * below * above).cast("decimal(38,0)"))
    return pairs.union(middles).where("n > 0").select("depth", F.col("parent").alias("node"), "child", "pair", "n", "lo", "hi", "first", "last")


def sample_triplets(tree: DataFrame, paths: DataFrame, trials: int = 500, seed: int = 0) -> DataFrame:
    """(depth, trial, a, b, c, out): ``trials`` triplets for each depth at which triplets meet, each triplet of a depth as likely as any other.

    ``out`` is the leaf outside the pair, null where three children meet. Draws are hashes of seed, depth and trial, so
    repeated tasks draw the same. Draws are ``trials`` rows a depth; they meet the rows of their depth only.
    """
    numbers = written(leaf_numbers(tree, paths), "numbers")
    kinds = written(prefix_sums(triplet_kinds(tree, paths, numbers), ["depth", "node", "child", "pair"], "n", "before"), "kinds")
    sums = kinds.groupBy("depth").agg(F.min("before").alias("base"), F.sum("n").alias("total"))
    draw = lambda what, size: F.pmod(F.xxhash64(F.lit(seed), "depth", "trial", F.lit(what)), size)
    draws = sums.select("depth", "base", "total", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    # one hash is too short for a place among more triplets than a long counts
    digits = lambda what: draw(what, F.lit(10**18)).cast("decimal(19,0)")
    wide = F.pmod((digits("kind") * F.lit(10**18).cast("decimal(19,0)") + digits("more")).cast("decimal(38,0)"), F.col("total"))
    drawn = F.when(F.col("total") < F.lit(1 << 62), draw("kind", F.least("total", F.lit(1 << 62)).cast("long")).cast("decimal(38,0)")).otherwise(wide)
    draws = draws.select(F.col("depth").alias("d"), "trial", (F.col("base") + drawn).cast("decimal(38,0)").alias("place"))
    met = kinds.join(draws, (F.col("depth") == F.col("d")) & (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    k = F.col("hi") - F.col("lo") + 1
    one = F.col("lo") + draw("one", k)

    def beside(lo: Column, size: Column, taken: Column) -> Column:
        """One of ``size`` numbers from ``lo`` on, but for ``taken``."""
        at = lo + draw("two", size - 1)
        return at + (at >= taken).cast("long")

    outside = F.col("first") + draw("out", F.col("last") - F.col("first") + 1 - k)
    outside = outside + F.when(outside >= F.col("lo"), k).otherwise(0)
    low, high = F.col("first") + draw("low", F.greatest(F.col("lo") - F.col("first"), F.lit(1))), F.col("hi") + 1 + draw("high", F.greatest(F.col("last") - F.col("hi"), F.lit(1)))
    pair = F.col("pair") == 1
    found = written(met.select("depth", "trial", pair.alias("pair"), one.alias("a"), F.when(pair, beside(F.col("lo"), F.greatest(k, F.lit(2)), one)).otherwise(low).alias("b"), F.when(pair, outside).otherwise(high).alias("c")), "drawn")
    for n in "abc":
        found = found.join(numbers.select(F.col("at").alias(n), F.col("node").alias(f"_{n}")), n)
    return found.select("depth", "trial", F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c"), F.when(F.col("pair"), F.col("_c")).alias("out"))


def triplets_correct_by_depth(samples: DataFrame, paths2: DataFrame) -> DataFrame:
    """(depth, correct, resolvable_correct, unresolvable_correct, unresolvable): shares of the drawn triplets that have the same outgroup in a second tree: of all, of those that the first tree resolves, and of the others; a share of nothing is 1. The last column is the share of the others."""
    drawn = written(samples, "samples")
    other = outgroups(drawn.select("a", "b", "c").distinct(), paths2).withColumnRenamed("out", "other")
    met = drawn.join(other, ["a", "b", "c"]).withColumn("same", F.col("out").eqNullSafe(F.col("other")).cast("int"))
    share = lambda test: F.coalesce(F.avg(F.when(test, F.col("same"))), F.lit(1.0))
    known = F.col("out").isNotNull()
    return met.groupBy("depth").agg(F.avg("same").alias("correct"), share(known).alias("resolvable_correct"), share(~known).alias("unresolvable_correct"), F.avg((~known).cast("int")).alias("unresolvable"))
