"""Fitness of the nodes of a tree from its shape alone: lineages whose fitness drifts, divide by it and are rarely sampled.

Fitness stands on a grid, in standard deviations of the population. A branch carries a distribution from one end to the
other by a propagator, which accounts for all side branches having been missed. Messages go up the tree and down again,
level by level: a level is one join by parent and one vectorised pass over its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.sources.scratch import written

#: Fixed values of the published method: the grid, its edge that no offspring reaches, and what counts as nothing.
LOW, HIGH, POINTS, EDGE, NOTHING = -4.0, 8.0, 49, 4, 1e-20
#: Nodes whose branches are integrated together, and nodes a task takes.
TOGETHER, A_TASK = 64, 2000


class Wave:
    """Diffusing fitness under selection. ``reach`` is the longest time asked for."""

    def __init__(self, diffusion: float, sampling: float, dt: float, reach: float):
        self.diffusion, self.sampling, self.dt, self.reach = diffusion, sampling, dt, reach
        self.grid = np.linspace(LOW, HIGH, POINTS)
        self.dx = self.grid[1] - self.grid[0]

    def drift(self, p: np.ndarray) -> np.ndarray:
        """Diffusion and the mean's advance along axis 1; at both ends the advance alone, one-sided."""
        out = np.empty_like(p)
        out[:, 1:-1] = self.diffusion / self.dx**2 * (p[:, :-2] + p[:, 2:] - 2 * p[:, 1:-1]) - (p[:, 2:] - p[:, :-2]) / (2 * self.dx)
        out[:, 0] = (p[:, 0] - p[:, 1]) / self.dx
        out[:, -1] = (p[:, -2] - p[:, -1]) / self.dx
        return out

    @staticmethod
    def step(slope, y: np.ndarray, t, h) -> np.ndarray:
        """One step of the fourth-order method of Runge and Kutta; values stay above nothing."""
        a = slope(y, t)
        b = slope(y + 0.5 * h * a, t + 0.5 * h)
        c = slope(y + 0.5 * h * b, t + 0.5 * h)
        d = slope(y + h * c, t + h)
        return np.maximum(y + h / 6 * (a + 2 * b + 2 * c + d), NOTHING)

    @cached_property
    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Times and, for each, by fitness the chance that a lineage that long ago leaves a sampled one: every 0.05 up to 10, every 10 beyond."""
        times = np.concatenate([np.linspace(0, 10, 201), np.arange(20, 201, 10)])
        times = times[: max(2, int(np.searchsorted(times, self.reach)) + 2)]
        slope = lambda y, t: self.drift(y) + self.grid * y - y**2
        rows = [np.full((1, POINTS), self.sampling)]
        for begin, end in zip(times, times[1:]):
            y, steps = rows[-1], int(np.ceil((end - begin) / min(0.01, 0.001 / self.diffusion)))
            for i in range(steps):
                y = self.step(slope, y, begin, (end - begin) / steps)
            rows.append(y)
        return times, np.concatenate(rows)

    def sampled_at(self, t: np.ndarray) -> np.ndarray:
        times, values = self.sampled
        t = np.clip(t, 0, times[-1])
        at = np.clip(np.searchsorted(times, t, side="right") - 1, 0, len(times) - 2)
        part = ((t - times[at]) / (times[at + 1] - times[at]))[:, None]
        return values[at] * (1 - part) + values[at + 1] * part

    def propagators(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """(branches, fitness of the ancestor, fitness of the offspring) from time ``near`` before the present to ``far``; equal branches are integrated once."""
        spans, of = np.unique(np.stack([near, far], axis=1), axis=0, return_inverse=True)
        near, far = spans.T
        steps = max(1, int(np.ceil((far - near).max() / self.dt)))
        h = ((far - near) / steps)[:, None, None]
        y = np.zeros((len(spans), POINTS, POINTS - 2 * EDGE))
        y[:, np.arange(EDGE, POINTS - EDGE), np.arange(POINTS - 2 * EDGE)] = 1 / self.dx
        slope = lambda p, t: self.drift(p) + (self.grid - 2 * self.sampled_at(t[:, 0, 0]))[:, :, None] * p
        for i in range(steps):
            y = self.step(slope, y, near[:, None, None] + i * h, h)
        return y[of.ravel()]

    @staticmethod
    def distribution(logs: np.ndarray) -> np.ndarray:
        e = np.exp(logs - logs.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def up(self, pdf: pd.DataFrame) -> dict[str, list]:
        """log of the message to the parent."""
        here = self.distribution(np.stack(pdf["kids"].to_numpy()))[:, EDGE:-EDGE]
        message = np.einsum("nyx,nx->ny", self.propagators(pdf["near"].to_numpy(), pdf["far"].to_numpy()), here)
        return {"up": list(np.log(np.maximum(message, NOTHING)))}

    def down(self, pdf: pd.DataFrame) -> dict[str, list]:
        """log of the message from the parent, and mean and variance of the node's own distribution. ``beside``: the parent's own message and all siblings'."""
        above = self.distribution(np.stack(pdf["beside"].to_numpy()))
        message = np.full(above.shape, NOTHING)
        message[:, EDGE:-EDGE] = np.einsum("nyx,ny->nx", self.propagators(pdf["near"].to_numpy(), pdf["far"].to_numpy()), above)
        down = np.log(np.maximum(message, NOTHING))
        return {"down": list(down), **self.moments(down + np.stack(pdf["kids"].to_numpy()))}

    def moments(self, logs: np.ndarray) -> dict[str, list]:
        p = self.distribution(logs)
        mean = p @ self.grid
        return {"fitness": list(mean), "variance": list(p @ self.grid**2 - mean**2)}


def levels_of(tree: DataFrame) -> list[DataFrame]:
    """(node, parent, length, time) by level from the root; a null length is 0."""
    edges = written(tree.select("node", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length")), "edges")
    top = edges.where("parent IS NULL")
    if top.count() != 1:
        raise ValueError("the tree must have one root")
    levels = [written(top.withColumn("time", F.lit(0.0)), "level")]
    while levels[-1].take(1):
        above = levels[-1].select(F.col("node").alias("parent"), F.col("time").alias("before"))
        levels.append(written(edges.join(above, "parent").select("node", "parent", "length", (F.col("before") + F.col("length")).alias("time")), "level"))
    return levels[:-1]


def shapes_of(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level's nodes with the number of leaves below, how long before the present a node is, and its time in pairs of leaves.

    The present is the mean time of the leaves below. Pairs are ordered pairs of leaves that meet in the node; a leaf meets itself at its parent.
    """
    out: list[DataFrame] = []
    for level in reversed(levels):
        if out:
            below = out[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("ends").alias("ends"), F.sum(F.col("leaves") * F.col("leaves")).alias("squares"))
            level = level.join(below, "node", "left")
        else:
            level = level.select("*", F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("double").alias("ends"), F.lit(None).cast("long").alias("squares"))
        leaf = F.col("leaves").isNull()
        near = F.when(leaf, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("ends") / F.col("leaves") - F.col("time")))
        met = F.when(leaf, F.col("length")).otherwise(near * (F.col("leaves") * F.col("leaves") - F.col("squares")))
        out.append(written(level.select("node", "parent", "length", "time", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), F.coalesce("ends", "time").alias("ends"), near.alias("near"), met.alias("met"), leaf.alias("leaf")), "shape"))
    out.reverse()
    return out


def inferred_fitness(tree: DataFrame, diffusion: float = 0.2, sampling: float = 0.01, time_scale: float | None = None, dt: float = 0.05, least: float = 1e-7) -> DataFrame:
    """(node, fitness, variance): mean and variance of every node's fitness, in standard deviations of the population.

    ``tree``: node, parent, length, one root. The unit of time is the mean time in which two leaves meet, times ``diffusion``, unless ``time_scale``
    gives it; it is computed from all pairs of leaves by their numbers below each node. ``least`` is added to each branch. Rounds are four for each
    level of the tree, and each writes its own level only.
    """
    shapes = shapes_of(levels_of(tree))
    every = shapes[0]
    for more in shapes[1:]:
        every = every.union(more)
    met, longest = every.agg(F.sum("met"), F.max(F.col("near") + F.col("length"))).first()
    leaves = shapes[0].first().leaves
    unit = time_scale if time_scale is not None else met / leaves**2 * diffusion
    if not unit > 0:
        raise ValueError("the branches have no length")
    wave, line = Wave(diffusion, sampling, dt, longest / unit + least), "array<double>"
    spans = {"near": F.col("near") / unit, "far": (F.col("near") + F.col("length") + least) / unit}

    def passed(rows: DataFrame, f: str, keep: list[str], more: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), TOGETHER):
                    part = pdf.iloc[at : at + TOGETHER]
                    yield part[keep].assign(**getattr(wave, f)(part))

        kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.mapInPandas(run, f"{kept}, {more}")

    def dealt(shape: DataFrame) -> DataFrame:
        return shape.repartition(max(1, -(-shape.count() // A_TASK)), "node")

    none, ups = F.array_repeat(F.lit(0.0), POINTS), []
    for shape in reversed(shapes):
        if ups:
            below = ups[-1].groupBy(F.col("parent").alias("node")).agg(F.array(*(F.sum(F.get("up", F.lit(i))) for i in range(POINTS))).alias("kids"))
            shape = written(shape.join(below, "node", "left").withColumn("kids", F.coalesce("kids", none)), "kids")
        else:
            shape = shape.withColumn("kids", none)
        rows = dealt(shape.withColumns(spans)).select("node", "parent", "near", "far", "kids")
        ups.append(written(passed(rows, "up", ["node", "parent", "near", "far", "kids"], f"up {line}"), "up"))
    ups.reverse()
    start = F.array(*(F.lit(float(-0.5 * x * x)) for x in wave.grid))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    above = ups[0].select("node", start.alias("down"), "kids")
    first = wave.moments(np.array([above.first().down]) + np.array([above.first().kids]))
    out = above.select("node", F.lit(float(first["fitness"][0])).alias("fitness"), F.lit(float(first["variance"][0])).alias("variance"))
    for level in ups[1:]:
        over = above.select(F.col("node").alias("parent"), added(F.col("down"), F.col("kids")).alias("all"))
        beside = level.join(over, "parent").withColumn("beside", F.zip_with("all", "up", lambda x, y: x - y))
        rows = dealt(written(beside.select("node", "near", "far", "kids", "beside"), "beside"))
        above = written(passed(rows, "down", ["node", "kids"], f"down {line}, fitness double, variance double"), "down")
        out = out.union(above.select("node", "fitness", "variance"))
    return out
