"""Bindings of tree editing, walks and scores to a ragged tree of orders, a dozen levels deep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import editing as E
from cladeworks.operators import trees as T
from cladeworks.plans.bindings import query, read
from cladeworks.sources.scratch import written


def orders_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order hangs below one of about half or a third of its number."""
    k = F.col("o_orderkey")
    parent = F.when(k % 3 == 0, F.floor((k - 1) / 3)).otherwise(F.floor((k - 1) / 2)).cast("long")
    name = lambda c: F.concat(F.lit("O"), c.cast("string"))
    return read(spark, sf_dir, "orders").select(name(k).alias("node"), F.when(k > 0, name(parent)).alias("parent"), F.when(k > 0, (k % 7 + 1).cast("double") / 8).otherwise(0.0).alias("length"))


TREE = """
t(node, parent, length) AS (SELECT 'O' || o_orderkey, CASE WHEN o_orderkey > 0 THEN 'O' || (CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey - 1) // 3 ELSE (o_orderkey - 1) // 2 END) END,
    CASE WHEN o_orderkey > 0 THEN (o_orderkey % 7 + 1)::DOUBLE / 8 ELSE 0.0 END FROM orders),
path AS (SELECT node, node AS ancestor, 0 AS hops, 0.0::DOUBLE AS distance, parent AS above, length AS step FROM t
    UNION ALL SELECT path.node, t.node, hops + 1, distance + path.step, t.parent, t.length FROM path JOIN t ON t.node = path.above),
leaf AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
ats AS (SELECT node, max(hops) AS depth, max(distance) AS time FROM path GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM t WHERE parent IS NOT NULL GROUP BY parent),
spine AS (SELECT node, string_agg(ancestor, chr(1) ORDER BY hops DESC) AS spine FROM path GROUP BY node)"""
WITH = f"WITH RECURSIVE {TREE}"


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = orders_tree(spark, sf_dir)
    return t, T.closure(t)


@query(f"{WITH} SELECT node, t.parent, length, depth::INT AS depth, time, coalesce(k, 0) AS n_children, t.parent IS NULL AS is_root, k IS NULL AS is_leaf, k IS NOT NULL AS is_internal FROM t JOIN ats USING (node) LEFT JOIN kids USING (node)")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.described(*both(spark, sf_dir))


@query(f"{WITH} SELECT node FROM t JOIN ats USING (node) JOIN kids USING (node) WHERE depth >= 3 AND k = 2")
def tree_filter_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.filter_nodes(E.described(*both(spark, sf_dir)), (F.col("depth") >= 3) & (F.col("n_children") == 2))


@query(f"{WITH} SELECT parent AS node, array_to_string(list(node ORDER BY length DESC, node), ',') AS children FROM t WHERE parent IS NOT NULL GROUP BY parent")
def tree_children_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    return E.children(t, t.select("node", (-F.col("length")).alias("place"))).select("node", F.concat_ws(",", "children").alias("children"))


@query(f"{WITH} SELECT node, row_number() OVER (ORDER BY spine) - 1 AS \"at\" FROM spine")
def tree_walk_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.walk(*both(spark, sf_dir), "pre")


@query(f"{WITH} SELECT node, row_number() OVER (ORDER BY spine || chr(2)) - 1 AS \"at\" FROM spine")
def tree_walk_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.walk(*both(spark, sf_dir), "post")


@query(f"{WITH}, w AS (SELECT node, row_number() OVER (ORDER BY depth, spine) - 2 AS \"at\" FROM spine JOIN ats USING (node)) SELECT parent, node, \"at\" FROM t JOIN w USING (node) WHERE parent IS NOT NULL")
def tree_walk_breadth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.walk_edges(*both(spark, sf_dir), "breadth")


@query(f"{WITH}, w AS (SELECT node, row_number() OVER (ORDER BY spine) - 2 AS \"at\" FROM spine) SELECT parent, node, \"at\" FROM t JOIN w USING (node) WHERE parent IS NOT NULL")
def tree_walk_depth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.walk_edges(*both(spark, sf_dir), "pre")


@query(f"{WITH} SELECT parent, node FROM t WHERE parent IS NOT NULL")
def tree_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.topology(orders_tree(spark, sf_dir))


@query(f"{WITH} SELECT t.node, CASE WHEN t.node <> 'O2' THEN t.parent END AS parent, CASE WHEN t.node <> 'O2' THEN t.length ELSE 0.0 END AS length FROM t JOIN path ON path.node = t.node AND path.ancestor = 'O2'")
def tree_subset_clade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.subset_clade(*both(spark, sf_dir), "O2")


@query(f"{WITH}, n AS (SELECT node, 'leaf-' || node AS name FROM leaf) SELECT coalesce(a.name, t.node) AS node, coalesce(b.name, t.parent) AS parent, length FROM t LEFT JOIN n a ON a.node = t.node LEFT JOIN n b ON b.node = t.parent")
def tree_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    return E.relabel_nodes(t, T.leaves(t).withColumn("name", F.concat(F.lit("leaf-"), "node")))


@query(f"{WITH} SELECT node, parent, length FROM t UNION ALL SELECT 'new-' || node, node, CASE WHEN k = 2 THEN 0.5 ELSE 0.0 END FROM kids")
def tree_add_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    new = t.where("parent IS NOT NULL").groupBy("parent").count().select(F.concat(F.lit("new-"), "parent").alias("node"), "parent", F.when(F.col("count") == 2, 0.5).alias("length"))
    return E.add_leaves(t, new)


@query(f"{WITH}, n AS (SELECT node, parent, CASE WHEN node IN (SELECT node FROM leaf) AND parent IS NOT NULL THEN 2.25 ELSE length END AS length FROM t) SELECT * FROM n")
def tree_set_branch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    return E.set_branch_lengths(t, E.topology(t).join(T.leaves(t), "node").select("parent", "node", F.lit(2.25).alias("length")))


@query(f"{WITH}, n AS (SELECT node, CASE WHEN node IN (SELECT node FROM leaf) THEN 64.0 ELSE time END AS time FROM ats) SELECT t.node, t.parent, CASE WHEN t.parent IS NULL THEN 0.0 ELSE n.time - m.time END AS length FROM t JOIN n USING (node) LEFT JOIN n m ON m.node = t.parent")
def tree_set_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, paths = both(spark, sf_dir)
    return E.set_times(t, paths, T.leaves(t).withColumn("time", F.lit(64.0)))


@query(f"{WITH} SELECT node, parent, round(length / (SELECT max(time) FROM ats), 9) AS length FROM t")
def tree_unit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scaled_to_unit(*both(spark, sf_dir)).withColumn("length", F.round("length", 9))


@query(f"{WITH} SELECT sum(length) AS total FROM t")
def tree_total_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.total_branch_length(orders_tree(spark, sf_dir))


@query(f"{WITH} SELECT node, parent, round(length * (100 / (SELECT sum(length) FROM t)), 9) AS length FROM t")
def tree_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rescaled(orders_tree(spark, sf_dir), 100).withColumn("length", F.round("length", 9))


WIDE = "SELECT 'root' AS node, NULL::VARCHAR AS parent, 0.0::DOUBLE AS length UNION ALL SELECT 'N' || n_nationkey, 'root', 1.0 FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 0.5 FROM supplier"


def wide_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root -> nation -> supplier."""
    one = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.lit("root"), F.lit(1.0))
    return one.union(nation).union(read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.lit(0.5)))


@query(f"""WITH w AS ({WIDE}), p AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY parent) AS k FROM w WHERE parent IS NOT NULL)
SELECT node, CASE WHEN k <= 2 OR least(i, k - 2) = 0 THEN parent ELSE parent || '~' || least(i, k - 2) END AS parent, length FROM p
UNION ALL SELECT parent || '~' || i, CASE WHEN i = 1 THEN parent ELSE parent || '~' || (i - 1) END, 0.0 FROM p WHERE i BETWEEN 1 AND k - 2 UNION ALL SELECT * FROM w WHERE parent IS NULL""")
def tree_resolve_polytomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resolve_polytomies(wide_tree(spark, sf_dir))


CELLS = "cs AS (SELECT node, [(substr(node, 2)::BIGINT % 3)::INT, (substr(node, 2)::BIGINT // 2 % 2)::INT] AS states FROM t)"


def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring("node", 2, 20).cast("long")
    return orders_tree(spark, sf_dir).select("node", F.array((key % 3).cast("int"), (F.floor(key / 2) % 2).cast("int")).alias("states"))


@query(f"{WITH}, {CELLS} SELECT node, array_to_string(CASE WHEN node IN (SELECT node FROM leaf) THEN [7, states[2]] ELSE states END, ',') AS states FROM cs")
def tree_set_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = node_states(spark, sf_dir)
    new = s.join(T.leaves(orders_tree(spark, sf_dir)), "node").select("node", F.array(F.lit(7), F.get("states", F.lit(1))).alias("states"))
    return E.set_states(s, new).select("node", F.concat_ws(",", F.col("states").cast("array<string>")).alias("states"))


@query(f"{WITH}, {CELLS} SELECT max(len(states))::INT AS n FROM cs")
def tree_n_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.n_characters(E.leaf_states(orders_tree(spark, sf_dir), node_states(spark, sf_dir).join(T.leaves(orders_tree(spark, sf_dir)), "node")))


@query(f"{WITH}, a AS (SELECT 'O' || o_orderkey AS node, o_orderstatus AS value FROM orders) SELECT node, CASE WHEN node IN (SELECT node FROM leaf) THEN 'tip' ELSE value END AS value FROM a")
def tree_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    held = read(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("value"))
    return E.get_attribute(E.set_attributes(held, "status", T.leaves(t).withColumn("value", F.lit("tip"))), t, "status")


@query(f"{WITH}, {CELLS}, l AS (SELECT node, unnest(states) AS state, unnest([0, 1]) AS character FROM cs) SELECT t.parent, t.node, x.character::INT AS character FROM t JOIN l x USING (node) JOIN l y ON y.node = t.parent AND y.character = x.character WHERE x.state = 0 AND y.state = 0")
def unmutated_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unmutated(orders_tree(spark, sf_dir), node_states(spark, sf_dir).select("node", F.posexplode("states").alias("character", "state")))


WPATH = f"w(node, parent, length) AS ({WIDE}), up AS (SELECT node, node AS ancestor, 0 AS hops, 0.0::DOUBLE AS distance FROM w UNION ALL SELECT up.node, w.parent, hops + 1, distance + w.length FROM up JOIN w ON w.node = up.ancestor WHERE w.parent IS NOT NULL), tip AS (SELECT node FROM w WHERE node NOT IN (SELECT parent FROM w WHERE parent IS NOT NULL)), tu AS (SELECT up.* FROM up JOIN tip USING (node))"


@query(f"WITH RECURSIVE {WPATH} SELECT x.node AS a, y.node AS b, 1 / min_by(x.distance + y.distance, x.hops) AS w FROM tu x JOIN tu y ON x.ancestor = y.ancestor AND x.node <> y.node GROUP BY ALL")
def phylogenetic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wide_tree(spark, sf_dir)
    return E.phylogenetic_weights(T.closure(t), t, inverse=True)


def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("g"), (F.col("s_suppkey") % 4).cast("string")).alias("label"))


@query(f"""WITH w AS ({WIDE}), v0 AS (SELECT 'S' || s_suppkey AS node, ['g' || (s_suppkey % 4)] AS labels FROM supplier),
v1 AS (SELECT parent AS node, unnest(labels) AS label FROM v0 JOIN w USING (node)), c1 AS (SELECT node, label, count(*) AS n FROM v1 GROUP BY ALL),
s1 AS (SELECT node, list(label ORDER BY label) AS labels FROM (SELECT *, max(n) OVER (PARTITION BY node) AS most FROM c1) WHERE n = most GROUP BY node),
c2 AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM s1) GROUP BY label), top AS (SELECT min(label) AS label FROM c2 WHERE n = (SELECT max(n) FROM c2)),
l1 AS (SELECT node, CASE WHEN list_contains(labels, (SELECT label FROM top)) THEN (SELECT label FROM top) ELSE labels[1] END AS label FROM s1)
SELECT 'root' AS node, label FROM top UNION ALL SELECT * FROM l1 UNION ALL SELECT node, labels[1] FROM v0""")
def fitch_top_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wide_tree(spark, sf_dir)
    # nations without suppliers carry no label and no vote
    labels = status_labels(spark, sf_dir)
    held = t.join(labels, "node", "left").where("label IS NOT NULL OR NOT node LIKE 'S%'").drop("label")
    used = held.where("node LIKE 'S%'").select("parent").distinct().withColumnRenamed("parent", "node")
    t = written(held.join(used.union(held.where("node = 'root' OR node LIKE 'S%'").select("node")), "node", "left_semi"), "labelled")
    paths = T.closure(t)
    return E.fitch_top_down(t, paths, T.fitch_hartigan(t, paths, labels))


@query(f"{WITH}, below AS (SELECT ancestor AS node, count(*) AS n, count(leaf.node) AS m FROM path LEFT JOIN leaf USING (node) WHERE hops > 0 GROUP BY ancestor) SELECT ats.node, depth::INT AS depth, coalesce(k, 0) AS n_children, coalesce(n, 0) AS n_descendants, coalesce(m, 0) AS n_leaf_descendants, round(time / (SELECT max(time) FROM ats), 9) AS depth_share FROM ats LEFT JOIN kids USING (node) LEFT JOIN below USING (node)")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.node_features(*both(spark, sf_dir)).withColumn("depth_share", F.round("depth_share", 9))


@query(f"""WITH RECURSIVE {WPATH}, e AS (SELECT w.node AS low, w.parent AS high, length FROM w WHERE parent IS NOT NULL),
far AS (SELECT x.node AS node, e.low, least(d1.distance, d2.distance) AS near, e.length FROM w x CROSS JOIN e
    JOIN (SELECT a.node AS a, b.node AS b, min_by(a.distance + b.distance, a.hops) AS distance FROM up a JOIN up b ON a.ancestor = b.ancestor GROUP BY ALL) d1 ON d1.a = x.node AND d1.b = e.low
    JOIN (SELECT a.node AS a, b.node AS b, min_by(a.distance + b.distance, a.hops) AS distance FROM up a JOIN up b ON a.ancestor = b.ancestor GROUP BY ALL) d2 ON d2.a = x.node AND d2.b = e.high)
SELECT node, round(sum(0.4::DOUBLE * exp(-near / 0.4::DOUBLE) * (1 - exp(-length / 0.4::DOUBLE))), 6) AS lbi FROM far GROUP BY node""")
def local_branching_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wide_tree(spark, sf_dir)
    return E.local_branching(t, T.closure(t), 0.4).withColumn("lbi", F.round("lbi", 6))
