"""Connected components of a link table: every round, each node hangs below its smallest neighbour, the trees that arise are flattened, and links are renamed to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import delete, scratch


class _Tables:
    """Tables written to the shared folder, deleted once they are no longer read."""

    def __init__(self, like: DataFrame):
        self.spark, self.paths = like.sparkSession, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, "links")
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None:
                delete(self.spark, self.paths.pop(id(table))[0])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node that can be reached.

    A round joins the links twice with one row a node, so its work follows the number of links; links inside a tree
    vanish, and links between two trees become one. Every round is written to the shared folder, so lineage stays short, and only
    the emptiness of a table reaches the driver. Hubs are safe: minima are combined on the map side and the
    joins are ones that adaptive execution splits. Links with a null end and links of a node with itself say nothing and go.
    """
    held = _Tables(links)
    edges = held.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    found: DataFrame | None = None  # (node, root) so far, roots themselves left out
    for _ in range(rounds):
        if edges.isEmpty():
            break
        roots = _flattened(held, held.write(edges.groupBy("u").agg(F.min("v").alias("root"))))
        up, down = roots.select("u", F.col("root").alias("ru")), roots.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        renamed = edges.join(up, "u").select("ru", "v").distinct().join(down, "v", "left").select("ru", F.coalesce("rv", "v").alias("rv")).where("ru <> rv")
        fewer = held.write(renamed.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        own = roots.select(F.col("u").alias("node"), "root")
        if found is None:
            now = held.write(own)
        else:
            moved = found.join(own.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            now = held.write(moved.union(own))
        held.drop(edges, roots, found)
        edges, found = fewer, now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select("root", "root").distinct())


def _flattened(held: _Tables, trees: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) with every root a node that hangs below none: each pointer jumps to what it points at, until none can."""
    for _ in range(rounds):
        above = trees.select(F.col("u").alias("root"), F.col("root").alias("higher"))
        jumped = held.write(trees.join(above, "root", "left").select("u", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        held.drop(trees)
        if not jumped.where("moved").take(1):
            return jumped
        trees = held.write(jumped.drop("moved"))
        held.drop(jumped)
    raise RuntimeError(f"pointers did not settle in {rounds} rounds")
