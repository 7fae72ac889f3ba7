"""Statistics of evolution on a tree: coupling of cell categories, rates of editing, and likelihoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.operators import blocks
from cladeworks.operators import trees as T
from cladeworks.operators.characters import MISSING
from cladeworks.operators.order import prefix_sums
from cladeworks.sources.scratch import written


def shuffled_labels(groups: DataFrame, shuffles: int, seed: int = 1) -> DataFrame:
    """(cell, labels): labels[0] is the cell's own category, the others its categories in random permutations. ``groups``: cell, grp."""
    order = F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("s")
    n = groups.count()

    def ranked(salt: str) -> DataFrame:
        rows = groups.select("cell", "grp", order).withColumn("h", F.xxhash64(F.lit(seed), F.lit(salt), "s", "cell"))
        # all permutations are numbered in one order, and each has n rows
        return prefix_sums(rows, ["s", "h", "cell"]).withColumn("k", F.col("before") - (F.col("s") - 1) * F.lit(n))

    dealt = ranked("to").select("s", "k", "cell").join(ranked("from").select("s", "k", "grp"), ["s", "k"])
    rows = dealt.select("cell", "s", "grp").union(groups.select("cell", F.lit(0), "grp"))
    return rows.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "grp"))), lambda x: x["grp"]).alias("labels"))


def coupling(pairs: DataFrame, groups: DataFrame, shuffles: int = 500, seed: int = 1, min_share: float = 0.05) -> DataFrame:
    """(g1, g2, d, z): mean dissimilarity between categories, and how many standard deviations that is from random labels.

    Categories need more than ``min_share`` of the cells. ``pairs``: a, b, d once each, or cells (cell, states) whose weighted Hamming is taken in
    blocks. A pair sends its dissimilarity to each permutation's sums, which combine where the pair is read. z is null where permutations do not vary.
    """
    if "states" in pairs.columns:
        return coupling_of(pairs, groups, shuffles, seed, min_share)
    total = groups.count()
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > int(total * min_share))
    kept = groups.join(sizes.select("grp"), "grp", "left_semi")
    labels = written(shuffled_labels(kept, shuffles, seed), "labels")
    named = pairs.join(labels.select(F.col("cell").alias("a"), F.col("labels").alias("la")), "a").join(labels.select(F.col("cell").alias("b"), F.col("labels").alias("lb")), "b")
    each = named.select("d", F.posexplode(F.arrays_zip("la", "lb")).alias("s", "p")).select("s", "d", F.least("p.la", "p.lb").alias("g1"), F.greatest("p.la", "p.lb").alias("g2"))
    return deviations(each.groupBy("s", "g1", "g2").agg(F.sum("d").alias("t")), sizes)


def coupling_of(cells: DataFrame, groups: DataFrame, shuffles: int = 500, seed: int = 1, min_share: float = 0.05, measure: blocks.Measure = blocks.weighted_hamming, size: int = blocks.PACKED) -> DataFrame:
    """The same for ``cells`` (cell, states), whose pairs are summed in blocks and never rows: products of a block's dissimilarities with its cells' categories in all permutations."""
    total = groups.count()
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > int(total * min_share))
    labels = written(shuffled_labels(groups.join(sizes.select("grp"), "grp", "left_semi"), shuffles, seed), "labels")
    # the categories are at most 1 / min_share; the place among them stands for each
    names = F.broadcast(sizes.agg(F.array_sort(F.collect_set("grp")).alias("names")))
    placed = labels.crossJoin(names).select("cell", F.transform("labels", lambda g: (F.array_position("names", g) - 1).cast("int")).alias("labels"))

    def kernel(x: blocks.Block, y: blocks.Block, same: bool) -> dict[str, np.ndarray]:
        d = blocks.measured(x, y, measure, MISSING)[0]
        d = np.triu(d, 1) if same else d
        one, two = x["labels"], y["labels"]
        k = 1 + max(one.max(), two.max())
        rows = []
        for low in range(0, one.shape[1], 64):
            p, q = one[:, low : low + 64], two[:, low : low + 64]
            left = (p[:, :, None] == np.arange(k)).astype(float).reshape(len(p), -1)
            right = (q[:, :, None] == np.arange(k)).astype(float)
            part = (left.T @ d).reshape(p.shape[1], k, -1)
            t = part @ right.transpose(1, 0, 2)
            own, other = left.reshape(len(p), -1, k).sum(axis=0), right.sum(axis=0)
            met = own[:, :, None] * other[:, None, :]
            if same:  # each pair once: as many of (g, h) and (h, g) together as there are pairs of them
                met = (met - own[:, :, None] * np.eye(k)) / 2
            t, met = (np.triu(m) + np.tril(m, -1).transpose(0, 2, 1) for m in (t, met))
            s, g, h = np.nonzero(met)
            rows.append((s + low, g, h, t[s, g, h]))
        s, g, h, t = (np.concatenate(c) for c in zip(*rows))
        return {"s": s, "g": g, "h": h, "t": t}

    held = blocks.one_clade(cells.select("cell", "states").join(placed, "cell"))
    sums = blocks.meet(held, kernel, "s int, g int, h int, t double", size, ("labels",)).groupBy("s", "g", "h").agg(F.sum("t").alias("t"))
    at = lambda c: F.element_at("names", F.col(c) + 1)
    return deviations(sums.crossJoin(names).select("s", at("g").alias("g1"), at("h").alias("g2"), "t"), sizes)


def deviations(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g1, g2, d, z) from the sums of all permutations (s, g1, g2, t), the own categories at s = 0, and the categories' sizes (grp, n)."""
    # a pair within one category counts in both directions, as its matrix has it twice
    sized = sums.join(sizes.select(F.col("grp").alias("g1"), F.col("n").alias("n1")), "g1").join(sizes.select(F.col("grp").alias("g2"), F.col("n").alias("n2")), "g2")
    mean = sized.withColumn("m", F.col("t") * F.when(F.col("g1") == F.col("g2"), 2).otherwise(1) / (F.col("n1") * F.col("n2")))
    own = F.max(F.when(F.col("s") == 0, F.col("m")))
    others = F.when(F.col("s") > 0, F.col("m"))
    out = mean.groupBy("g1", "g2").agg(own.alias("d"), F.avg(others).alias("mu"), F.stddev_pop(others).alias("sd"))
    return out.select("g1", "g2", "d", F.when(F.col("sd") > 0, (F.col("d") - F.col("mu")) / F.col("sd")).alias("z"))


def mutation_rate(tree: DataFrame, paths: DataFrame, mutated: float, continuous: bool = True, root_branch: bool = True) -> float:
    """The rate a unit of time, or the probability a generation, that explains the share of mutated entries at the leaves.

    Without a single edge at the root an edge of mean length is thought above it, unless ``root_branch`` is off.
    """
    import math

    at = T.node_times(paths).join(T.leaves(tree), "node").agg(F.avg("depth").alias("depth"), F.avg("time").alias("time")).first()
    edges = tree.where("parent IS NOT NULL")
    single = edges.join(tree.where("parent IS NULL").select(F.col("node").alias("parent")), "parent", "left_semi").count() == 1
    more = root_branch and not single
    if continuous:
        return -math.log(1 - mutated) / (at.time + (edges.agg(F.avg("length")).first()[0] if more else 0))
    return 1 - (1 - mutated) ** (1 / (at.depth + (1 if more else 0)))


def log_likelihood(tree: DataFrame, paths: DataFrame, cells: DataFrame, priors: DataFrame, rate: float, stochastic: float = 0.0, missing: int = MISSING) -> DataFrame:
    """(character, loglik) of irreversible editing: an open site is cut at ``rate``, to a state drawn from ``priors`` (character, state, p); leaves lose entries with probability ``stochastic``.

    Below a node a site can only have been cut at or above it if all entries there are one state or missing. So two
    numbers a node and character suffice, the likelihood if the site is open and if it is cut to that state; they pass up
    the tree one level at a time. ``cells``: node, states.
    """
    depth = T.node_times(paths).select("node", "depth")
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    seen, lost = F.log(F.lit(1.0 - stochastic)), F.log(F.lit(float(stochastic))) if stochastic > 0 else F.lit(float("-inf"))
    entry = T.leaves(tree).join(cells, "node").select("node", F.posexplode("states").alias("character", "state"))
    none, low = F.col("state") == missing, F.lit(float("-inf"))
    # state: the one cut state below, 0 if entries are open or differ, missing if there are none
    known = entry.select("node", "character", "state", F.when(none, lost).when(F.col("state") == 0, seen).otherwise(low).alias("open"), F.when(none, lost).when(F.col("state") == 0, low).otherwise(seen).alias("cut"))
    known = written(known, "likelihoods")
    for level in range(deepest, 0, -1):
        at = tree.where("parent IS NOT NULL").join(depth.where(F.col("depth") == level).select("node"), "node", "left_semi").join(known, "node").join(priors, ["character", "state"], "left")
        stay = F.exp(-rate * F.col("length"))
        # an entry that is missing below may have been cut to any state, whose priors sum to 1
        drawn = F.when(F.col("state") == missing, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
        top = F.greatest("open", "cut")
        up = F.when(top == float("-inf"), top).otherwise(top + F.log(stay * F.exp(F.col("open") - top) + (1 - stay) * drawn * F.exp(F.col("cut") - top)))
        real = F.when(F.col("state") != missing, F.col("state"))
        passed = at.select("parent", "character", "state", up.alias("open"), "cut")
        now = passed.groupBy(F.col("parent").alias("node"), "character").agg(F.min(real).alias("s1"), F.max(real).alias("s2"), F.sum("open").alias("open"), F.sum("cut").alias("cut"))
        one = F.when(F.col("s1").isNull(), F.lit(missing)).when(F.col("s1") == F.col("s2"), F.col("s1")).otherwise(F.lit(0))
        known = written(known.union(now.select("node", "character", one.alias("state"), "open", F.when(one == 0, low).otherwise(F.col("cut")).alias("cut"))), "likelihoods")
    root = tree.where("parent IS NULL").select("node")
    return known.join(root, "node").select("character", F.col("open").alias("loglik"))


def log_likelihood_discrete(tree: DataFrame, paths: DataFrame, cells: DataFrame, priors: DataFrame, probability: float, stochastic: float = 0.0, missing: int = MISSING) -> DataFrame:
    """The same where an open site is cut with ``probability`` a generation and every edge is one."""
    import math

    return log_likelihood(tree.withColumn("length", F.lit(1.0)), paths, cells, priors, -math.log(1 - probability), stochastic, missing)


def tracing_parameters(tree: DataFrame, paths: DataFrame, mutated: float, missing_share: float, continuous: bool = True, rate: float | None = None, heritable: float | None = None, stochastic: float | None = None) -> tuple[float, float, float]:
    """(mutation rate, heritable missing rate, stochastic missing probability): those given, the others estimated from shares of entries at the leaves."""
    rate = mutation_rate(tree, paths, mutated, continuous) if rate is None else rate
    if not (rate >= 0 if continuous else 0 <= rate <= 1):
        raise T.TreeError("the mutation rate is out of its range")
    if heritable is None or stochastic is None:
        at = T.node_times(paths).join(T.leaves(tree), "node").agg(F.avg("time").alias("time"), F.avg("depth").alias("depth")).first()
        heritable, stochastic = T.missing_rates(missing_share, heritable, 0.0 if heritable is None and stochastic is None else stochastic, at.time if continuous else at.depth)
    return rate, heritable, stochastic


def edge_statistics(tree: DataFrame, states: DataFrame, missing: int = MISSING) -> DataFrame:
    """(parent, node, mutated, unmutated): of the characters uncut above an edge and not missing below it, those cut below and those not. ``states``: node, character, state."""
    above = states.where("state = 0").select(F.col("node").alias("parent"), "character")
    both = tree.where("parent IS NOT NULL").select("node", "parent").join(states.where(F.col("state") != missing), "node").join(above, ["parent", "character"])
    return both.groupBy("parent", "node").agg(F.count_if(F.col("state") != 0).alias("mutated"), F.count_if(F.col("state") == 0).alias("unmutated"))


def exponential_lengths(tree: DataFrame, states: DataFrame, least: float = 0.01, missing: int = MISSING) -> DataFrame:
    """The tree with the length of each edge that makes its own counts most likely, if sites are cut at rate 1: -ln(unmutated / all), half a site being thought uncut where none is; at least ``least``.

    Every edge is estimated by itself: leaves need not end at one time. An edge without open sites above it gets ``least``.
    """
    told = edge_statistics(tree, states, missing).select("node", F.greatest(F.lit(least), -F.log(F.greatest(F.col("unmutated"), F.lit(0.5)) / (F.col("mutated") + F.col("unmutated")))).alias("__length"))
    return tree.join(told, "node", "left").select("node", "parent", F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("__length", F.lit(least))).alias("length"))
