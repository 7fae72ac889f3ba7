"""Node times under a clock: cells divide at a birth rate, characters are cut at a mutation rate, and leaves are sampled at the end.

Time runs from 0 at the root to 1 at the leaves in ``steps`` equal steps; in each a lineage is cut once, divides, divides
with one side unsampled, or stays. For every node the likelihood below it goes up the tree and the likelihood of all else
goes down it, level by level: a level is one join by parent and one vectorised pass over its nodes. Between nodes only an
array of time steps travels, since a node divides with exactly the cuts it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.characters import MISSING
from cladeworks.sources.scratch import written


def cut_counts(tree: DataFrame, states: DataFrame, missing: int = MISSING) -> DataFrame:
    """(node, parent, cuts, present): each node's numbers of cut and of known characters. ``states``: node, states, with deducible missing states filled in."""
    count = lambda test: F.size(F.filter("states", test))
    here = states.select("node", count(lambda s: (s != 0) & (s != missing)).alias("cuts"), count(lambda s: s != missing).alias("present"))
    return tree.select("node", "parent").join(here, "node")


def unsampled(steps: int, birth_rate: float, sampling: float) -> np.ndarray:
    """The probability that a lineage at each step leaves no sampled cell."""
    p, b = np.zeros(steps + 1), birth_rate / steps
    p[steps] = 1 - sampling
    for t in range(steps - 1, -1, -1):
        p[t] = (1 - b) * p[t + 1] + b * p[t + 1] ** 2
    return p


def log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


class Clock:
    """The steps of one lineage, for many nodes at once. Columns of a node's table are its numbers of cuts from its parent's to its own."""

    def __init__(self, mutation_rate: float, birth_rate: float, sampling: float, steps: int):
        self.r, self.b, self.steps, self.sampling = mutation_rate / steps, birth_rate / steps, steps, sampling
        self.lost = unsampled(steps, birth_rate, sampling)

    def table(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own column, possible columns, and logs of the chance of a cut and of the chance of nothing, at each column."""
        own = (pdf["cuts"] - pdf["above"]).to_numpy()
        columns = np.arange(own.max(initial=0) + 1)[None, :]
        open_ = np.maximum(pdf["present"].to_numpy()[:, None] - pdf["above"].to_numpy()[:, None] - columns, 0) * self.r
        return own, columns <= own[:, None], log(open_), 1 - self.b - open_

    def below(self, pdf: pd.DataFrame) -> np.ndarray:
        """log P(all at and below the node | its lineage has the parent's cuts at step t), for every step. ``kids``: the sum of the children's, null for leaves."""
        own, possible, cut, stay = self.table(pdf)
        at = np.arange(len(own)), own
        leaf = pdf["kids"].isna().to_numpy()
        kids = np.full((len(own), self.steps + 1), -np.inf)
        if not leaf.all():
            kids[~leaf] = np.stack(pdf["kids"][~leaf].to_numpy())
        now = np.full(possible.shape, -np.inf)
        now[at] = np.where(leaf, np.log(self.sampling), -np.inf)
        out = np.empty((len(own), self.steps + 1))
        out[:, self.steps] = now[:, 0]
        for t in range(self.steps - 1, -1, -1):
            after = np.full_like(now, -np.inf)
            after[:, :-1] = now[:, 1:] + cut[:, :-1]
            after = np.logaddexp(after, now + log(stay + 2 * self.b * self.lost[t + 1]))
            after[at] = np.logaddexp(after[at], log(np.float64(self.b)) + kids[:, t + 1])
            now = np.where(possible, after, -np.inf)
            out[:, t] = now[:, 0]
        return out

    def above(self, pdf: pd.DataFrame) -> np.ndarray:
        """log P(all that is not below the node, and it divides at step t with its cuts). ``up``: the parent's, ``beside``: the sibling's ``below``."""
        own, possible, cut, stay = self.table(pdf)
        at = np.arange(len(own)), own
        up, beside = np.stack(pdf["up"].to_numpy()), np.stack(pdf["beside"].to_numpy())
        now = np.full(possible.shape, -np.inf)
        out = np.full((len(own), self.steps + 1), -np.inf)
        for t in range(1, self.steps + 1):
            after = np.full_like(now, -np.inf)
            after[:, 1:] = now[:, :-1] + cut[:, :-1]
            after = np.logaddexp(after, now + log(stay + 2 * self.b * self.lost[t - 1]))
            after[:, 0] = np.logaddexp(after[:, 0], log(np.float64(self.b)) + up[:, t - 1] + beside[:, t])
            now = np.where(possible, after, -np.inf)
            out[:, t] = now[at]
        return out


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def posterior_times(nodes: DataFrame, mutation_rate: float, birth_rate: float, sampling: float, steps: int = 600) -> DataFrame:
    """(node, mean, log_joint, posterior) for every inner node but the root: its time given the tree and the cuts, on steps 0 to ``steps``.

    ``nodes``: node, parent, cuts, present (see ``cut_counts``). The root must have one child without lost characters
    and every other inner node two; cuts must not fall and known characters not rise from a parent to a child. Rounds are
    as many as the tree has levels; each writes its own level only.
    """
    if not 0 < sampling <= 1:
        raise ValueError("sampling must lie in (0, 1]")
    nodes = written(nodes.select("node", "parent", "cuts", "present"), "nodes")
    most = nodes.agg(F.max("present")).first()[0] or 0
    if 1 - (birth_rate + most * mutation_rate) / steps <= 0:
        raise ValueError("more steps are needed for these rates")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    degrees = nodes.join(kids, "node", "left").select((F.col("parent").isNull()).alias("top"), F.coalesce("n", F.lit(0)).alias("n")).groupBy("top", "n").count().collect()
    if [r["count"] for r in degrees if r.top] != [1] or any(r.n != 1 if r.top else r.n not in (0, 2) for r in degrees):
        raise ValueError("the root must have one child, and every other inner node two")
    over = nodes.select(F.col("node").alias("parent"), F.col("cuts").alias("above"), F.col("present").alias("had"))
    edges = nodes.join(over, "parent")
    if edges.where("cuts < above OR present > had OR cuts > present").take(1):
        raise ValueError("cuts fall, or known characters rise, along an edge")
    clock, line = Clock(mutation_rate, birth_rate, sampling, steps), "array<double>"
    levels = [written(nodes.where("parent IS NULL").withColumn("above", F.lit(0)), "level")]
    edges = written(edges.select("node", "parent", "cuts", "present", "above"), "edges")
    while levels[-1].take(1):
        levels.append(written(edges.join(levels[-1].select(F.col("node").alias("parent")), "parent", "left_semi"), "level"))
    levels.pop()

    def kernel(f: str, name: str, keep: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 512):
                    part = pdf.iloc[at : at + 512]
                    yield part[keep].assign(**{name: list(getattr(clock, f)(part))})

        return run

    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("node", "parent")}
    below: list[DataFrame] = []  # from the deepest level up
    for level in reversed(levels[1:]):
        if below:
            two = below[-1].groupBy(F.col("parent").alias("node")).agg(F.collect_list("down").alias("l"))  # two children a node
            level = level.join(two.select("node", added(F.col("l")[0], F.col("l")[1]).alias("kids")), "node", "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast(line))
        below.append(written(level.select("node", "parent", "cuts", "present", "above", "kids").mapInPandas(kernel("below", "down", ["node", "parent", "cuts", "present", "above", "kids"]), f"node {kind['node']}, parent {kind['parent']}, cuts int, present int, above int, kids {line}, down {line}"), "below"))
    below.reverse()
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(float("-inf")), steps))
    ups, found = levels[0].select("node", start.alias("up")), []
    for level in below:
        other = level.select("parent", F.col("node").alias("sibling"), F.col("down").alias("beside"))
        inner = level.where("kids IS NOT NULL").join(ups.select(F.col("node").alias("parent"), "up"), "parent")
        beside = inner.join(other, "parent", "left").where("sibling <> node").select("node", "beside")
        inner = inner.join(beside, "node", "left").withColumn("beside", F.coalesce("beside", F.array_repeat(F.lit(0.0), steps + 1)))
        done = written(inner.select("node", "cuts", "present", "above", "kids", "up", "beside").mapInPandas(kernel("above", "up", ["node", "kids"]), f"node {kind['node']}, kids {line}, up {line}"), "above")
        ups = done.select("node", "up")
        found.append(done.select("node", added(F.col("up"), F.col("kids")).alias("log_joint")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    scaled = F.transform("log_joint", lambda x: F.exp(x - F.array_max("log_joint")))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("e", scaled).withColumn("posterior", F.transform("e", lambda x: x / total))
    mean = F.aggregate(F.transform("posterior", lambda p, t: p * t), F.lit(0.0), lambda s, x: s + x) / steps
    return rows.select("node", mean.alias("mean"), "log_joint", "posterior")


def log_likelihood(posteriors: DataFrame, root_child: object) -> DataFrame:
    """(loglik): of all data, from the table of posteriors: the child of the root divides at some step. Right up to the length of a step."""
    top = posteriors.where(F.col("node") == F.lit(root_child))
    best = F.array_max("log_joint")
    return top.select((best + F.log(F.aggregate(F.transform("log_joint", lambda x: F.exp(x - best)), F.lit(0.0), lambda s, x: s + x))).alias("loglik"))


def clock_lengths(nodes: DataFrame, posteriors: DataFrame) -> DataFrame:
    """(node, parent, time, length): the root at time 0, leaves at 1, all others at the mean of their posterior."""
    inner = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    timed = nodes.select("node", "parent").join(inner, "node", "left").join(posteriors.select("node", "mean"), "node", "left")
    times = written(timed.select("node", "parent", F.when(F.col("parent").isNull(), 0.0).when(F.col("inner"), F.col("mean")).otherwise(1.0).alias("time")), "times")
    up = times.select(F.col("node").alias("parent"), F.col("time").alias("before"))
    return times.join(up, "parent", "left").select("node", "parent", "time", F.coalesce(F.col("time") - F.col("before"), F.lit(0.0)).alias("length"))
