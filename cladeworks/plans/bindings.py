"""Bindings of the operators to tables of star-schema data, each with the SQL that must give the same rows.

The domain's own tables are bound so: ``lineitem`` is a molecule table (a part is a cell, an order a UMI, return flag and
line status a barcode, the line number an allele), ``embeddings`` a character matrix, region / nation / customer a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import blocks
from cladeworks.operators import characters as C
from cladeworks.operators import clones, evolution, spatial
from cladeworks.operators import molecules as M
from cladeworks.operators import pairs as P
from cladeworks.operators import trees as T
from cladeworks.solve import greedy, joining
from cladeworks.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("cell"), F.col("l_orderkey").cast("long").alias("umi"), F.concat("l_returnflag", "l_linestatus").alias("intbc"), F.col("l_linenumber").cast("string").alias("allele"), F.col("l_quantity").cast("long").alias("reads"))


MOL = "mol AS (SELECT l_partkey::BIGINT AS cell, l_orderkey::BIGINT AS umi, l_returnflag || l_linestatus AS intbc, l_linenumber::VARCHAR AS allele, l_quantity::BIGINT AS reads FROM lineitem)"
ALL = "SELECT cell, umi, intbc, allele, reads FROM "


@query(f"WITH {MOL} {ALL} mol WHERE reads >= 25")
def filter_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filter_umis(mol(spark, sf_dir), 25)


@query(f"WITH {MOL} {ALL} mol WHERE reads >= (SELECT floor(quantile_cont(reads, 0.99) / 10) FROM mol)")
def filter_umis_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mol(spark, sf_dir)
    return M.filter_umis(m, M.dynamic_min_reads(m))


@query(f"WITH {MOL} {ALL} mol WHERE cell IN (SELECT cell FROM mol GROUP BY cell HAVING count(*) >= 30 AND sum(reads) >= 25 * count(*))")
def filter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filter_cells(mol(spark, sf_dir), 30, 25)


@query(f"WITH {MOL} SELECT cell, count(*) AS n_umi, sum(reads)::BIGINT AS n_reads FROM mol GROUP BY cell")
def filter_cells_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_counts(mol(spark, sf_dir))


@query("SELECT p_partkey, p_brand FROM part WHERE len(list_filter(string_split(p_brand, ''), lambda c: ascii(c) - 33 < 2)) = 0")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality_filter(read(spark, sf_dir, "part"), ["p_brand"], 2).select("p_partkey", "p_brand")


@query("""
WITH s AS (SELECT l_partkey::BIGINT AS cell, l_suppkey::BIGINT AS umi, l_linenumber::VARCHAR AS seq, l_quantity::BIGINT AS reads FROM lineitem),
b AS (SELECT cell, umi, seq, reads FROM (SELECT *, row_number() OVER (PARTITION BY cell, umi ORDER BY reads DESC, seq) AS r FROM s) WHERE r = 1)
SELECT * FROM b WHERE cell IN (SELECT cell FROM b GROUP BY cell HAVING count(*) >= 4 AND sum(reads) >= 30 * count(*))
""")
def resolve_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("cell"), F.col("l_suppkey").cast("long").alias("umi"), F.col("l_linenumber").cast("string").alias("seq"), F.col("l_quantity").cast("long").alias("reads"))
    return M.resolve_umi_sequence(s, 4, 30)


WHITELIST = ["Brand#1", "Brand#22", "Brand#25"]


@query("""
WITH w AS (SELECT unnest(['Brand#1', 'Brand#22', 'Brand#25']) AS entry),
d AS (SELECT b.p_brand, w.entry, levenshtein(b.p_brand, w.entry) AS d FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL) b, w WHERE levenshtein(b.p_brand, w.entry) <= 1),
n AS (SELECT p_brand, min(d) AS d FROM d GROUP BY p_brand),
one AS (SELECT d.p_brand, min(entry) AS entry FROM d JOIN n ON n.p_brand = d.p_brand AND n.d = d.d GROUP BY d.p_brand, d.d HAVING count(*) = 1 OR d.d = 0)
SELECT p_partkey, entry AS intbc FROM part JOIN one USING (p_brand)
""")
def intbc_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("intbc"))
    return M.correct_to_whitelist(parts, spark.createDataFrame([(w,) for w in WHITELIST], "intbc string"), 1)


NUMBERED = "mol AS (SELECT l_suppkey::BIGINT AS cell, l_orderkey::BIGINT AS umi, lpad(l_linenumber::VARCHAR, 2, '0') AS intbc, l_returnflag AS allele, l_quantity::BIGINT AS reads FROM lineitem)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("cell"), F.col("l_orderkey").cast("long").alias("umi"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("intbc"), F.col("l_returnflag").alias("allele"), F.col("l_quantity").cast("long").alias("reads"))


@query(f"""
WITH {NUMBERED},
k AS (SELECT cell, allele, intbc, count(*) AS n FROM mol GROUP BY ALL),
p AS (SELECT s.cell, s.allele, s.intbc, l.intbc AS partner, row_number() OVER (PARTITION BY s.cell, s.allele, s.intbc ORDER BY l.n, l.intbc DESC) AS r
    FROM k s JOIN k l ON s.cell = l.cell AND s.allele = l.allele AND s.intbc <> l.intbc AND levenshtein(s.intbc, l.intbc) <= 1
    WHERE s.n <= 10 AND s.n < 0.5 * (s.n + l.n))
SELECT m.cell, m.umi, coalesce(p.partner, m.intbc) AS intbc, m.allele, m.reads
FROM mol m LEFT JOIN p ON p.r = 1 AND p.cell = m.cell AND p.allele = m.allele AND p.intbc = m.intbc
""")
def intbc_error_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.correct_intbcs(numbered(spark, sf_dir))


UMIS = "u AS (SELECT l_suppkey::BIGINT AS cell, l_returnflag AS intbc, lpad(l_orderkey::VARCHAR, 8, '0') AS umi, sum(l_quantity)::BIGINT AS reads FROM lineitem GROUP BY ALL)"


@query(f"""
WITH RECURSIVE {UMIS},
t AS (SELECT a.cell, a.intbc, a.umi, arg_max(b.umi, (b.reads, b.umi)) AS target FROM u a JOIN u b ON a.cell = b.cell AND a.intbc = b.intbc AND (b.reads, b.umi) > (a.reads, a.umi) AND hamming(a.umi, b.umi) <= 1 GROUP BY ALL),
c AS (SELECT cell, intbc, umi, umi AS root, 0 AS step FROM u UNION ALL SELECT c.cell, c.intbc, c.umi, t.target, c.step + 1 FROM c JOIN t ON t.cell = c.cell AND t.intbc = c.intbc AND t.umi = c.root),
e AS (SELECT cell, intbc, umi, arg_max(root, step) AS root FROM c GROUP BY cell, intbc, umi)
SELECT e.cell, e.intbc, e.root AS umi, sum(u.reads)::BIGINT AS reads FROM e JOIN u ON u.cell = e.cell AND u.intbc = e.intbc AND u.umi = e.umi GROUP BY e.cell, e.intbc, e.root
""")
def umi_error_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    u = lines.groupBy(F.col("l_suppkey").cast("long").alias("cell"), F.col("l_returnflag").alias("intbc"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0").alias("umi")).agg(F.sum(F.col("l_quantity").cast("long")).alias("reads"))
    return M.correct_umis(u, 1)


COUNTS = "k AS (SELECT cell, intbc, allele, count(*) AS n_umi, sum(reads) AS n_reads FROM mol GROUP BY ALL)"


@query(f"""
WITH {MOL}, {COUNTS}, i AS (SELECT cell, intbc, sum(n_umi) AS total, max(n_umi) AS most FROM k GROUP BY ALL)
{ALL} mol WHERE cell IN (SELECT cell FROM i GROUP BY cell HAVING (sum(total) - sum(most)) / sum(total)::DOUBLE <= 0.55)
""")
def intra_doublets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filter_intra_doublets(mol(spark, sf_dir), 0.55)


@query(f"""
WITH {MOL}, {COUNTS}, b AS (SELECT cell, intbc, allele FROM (SELECT *, row_number() OVER (PARTITION BY cell, intbc ORDER BY n_umi DESC, n_reads DESC, allele) AS r FROM k) WHERE r = 1)
{ALL} mol SEMI JOIN b USING (cell, intbc, allele)
""")
def map_intbcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_intbcs(mol(spark, sf_dir)).select("cell", "umi", "intbc", "allele", "reads")


@query(f"""
WITH {NUMBERED}, a AS (SELECT * FROM mol WHERE reads >= (SELECT floor(quantile_cont(reads, 0.99) / 10) FROM mol)),
b AS (SELECT * FROM a WHERE cell IN (SELECT cell FROM a GROUP BY cell HAVING count(*) >= 10 AND sum(reads) >= 2 * count(*))),
k AS (SELECT cell, allele, intbc, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT s.cell, s.allele, s.intbc, l.intbc AS partner, row_number() OVER (PARTITION BY s.cell, s.allele, s.intbc ORDER BY l.n, l.intbc DESC) AS r
    FROM k s JOIN k l ON s.cell = l.cell AND s.allele = l.allele AND s.intbc <> l.intbc AND levenshtein(s.intbc, l.intbc) <= 1
    WHERE s.n <= 10 AND s.n < 0.5 * (s.n + l.n)),
c AS (SELECT m.cell, m.umi, coalesce(p.partner, m.intbc) AS intbc, m.allele, m.reads FROM b m LEFT JOIN p ON p.r = 1 AND p.cell = m.cell AND p.allele = m.allele AND p.intbc = m.intbc),
q AS (SELECT cell, intbc, allele, count(*) AS n_umi, sum(reads) AS n_reads FROM c GROUP BY ALL),
i AS (SELECT cell, intbc, sum(n_umi) AS total, max(n_umi) AS most FROM q GROUP BY ALL),
d AS (SELECT * FROM c WHERE cell IN (SELECT cell FROM i GROUP BY cell HAVING (sum(total) - sum(most)) / sum(total)::DOUBLE <= 0.61)),
y AS (SELECT cell, intbc, allele, count(*) AS n_umi, sum(reads) AS n_reads FROM d GROUP BY ALL),
z AS (SELECT cell, intbc, allele FROM (SELECT *, row_number() OVER (PARTITION BY cell, intbc ORDER BY n_umi DESC, n_reads DESC, allele) AS r FROM y) WHERE r = 1)
SELECT cell, umi, intbc, allele, reads, 'good' AS status FROM d SEMI JOIN z USING (cell, intbc, allele)
""")
def filter_molecule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filter_molecule_table(numbered(spark, sf_dir), doublet_threshold=0.61).select("cell", "umi", "intbc", "allele", "reads", "status")


@query(f"WITH {MOL} SELECT cell, count(*) AS n FROM mol GROUP BY cell")
def record_stats_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.umis_per_cell(mol(spark, sf_dir))


@query(f"WITH {MOL} SELECT cell, intbc, count(*) AS n FROM mol GROUP BY cell, intbc")
def record_stats_intbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.umis_per_intbc(mol(spark, sf_dir))


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("cell"), F.concat("l_returnflag", "l_linestatus").alias("intbc"), F.when(F.col("l_linenumber") == 3, "None").otherwise(F.concat(F.lit("I"), F.col("l_linenumber").cast("string"))).alias("r1"), F.when(F.col("l_quantity") > 40, None).otherwise(F.concat(F.lit("D"), (F.col("l_partkey") % 6).cast("string"))).alias("r2"))


ALLELES = "a AS (SELECT l_suppkey::BIGINT AS cell, l_returnflag || l_linestatus AS intbc, CASE WHEN l_linenumber = 3 THEN 'None' ELSE 'I' || l_linenumber END AS r1, CASE WHEN l_quantity > 40 THEN NULL ELSE 'D' || (l_partkey % 6) END AS r2 FROM lineitem)"
LONG = f"{ALLELES}, m AS (SELECT cell, intbc || 'r1' AS character, r1 AS indel FROM a UNION SELECT cell, intbc || 'r2', r2 FROM a WHERE r2 IS NOT NULL)"
NUMBERS = "s AS (SELECT character, indel, CASE WHEN upper(indel) LIKE '%NONE%' THEN 0 ELSE row_number() OVER (PARTITION BY character, upper(indel) LIKE '%NONE%' ORDER BY first, indel) END::INT AS state FROM (SELECT character, indel, min(cell) AS first FROM m GROUP BY ALL))"
SITES = ["r1", "r2"]
PRIORS = f"WITH {ALLELES}, g AS (SELECT DISTINCT cell, intbc, unnest([r1, r2]) AS indel FROM a), p AS (SELECT indel, count(*) AS n, count(*) / (SELECT count(*) FROM (SELECT DISTINCT cell, intbc FROM a))::DOUBLE AS freq FROM g WHERE indel IS NOT NULL AND upper(indel) NOT LIKE '%NONE%' GROUP BY indel)"


@query(f"{PRIORS} SELECT indel, n, round(freq, 9) AS freq FROM p")
def indel_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indel_priors(alleles(spark, sf_dir), SITES, ["cell", "intbc"]).withColumn("freq", F.round("freq", 9))


@query(f"{PRIORS} SELECT indel, round(-ln(freq), 6) + 0.0 AS weight FROM p")
def prior_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prior_weights(C.indel_priors(alleles(spark, sf_dir), SITES, ["cell", "intbc"])).select("indel", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"WITH {LONG}, {NUMBERS} SELECT cell, m.character, array_to_string(list(DISTINCT state ORDER BY state), ',') AS states FROM m JOIN s ON s.character = m.character AND s.indel = m.indel GROUP BY cell, m.character")
def char_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.character_matrix(alleles(spark, sf_dir), SITES).select("cell", "character", F.concat_ws(",", F.col("states").cast("array<string>")).alias("states"))


@query(f"WITH {LONG}, {NUMBERS} SELECT character, indel, state FROM s")
def state_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state_numbers(C.character_table(alleles(spark, sf_dir), SITES))


def cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lambda v: F.when(v <= -0.2, -1).when(F.abs(v) < 0.05, 0).when(v < 0, 1).when(v < 0.12, 2).otherwise(3)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.transform(F.col("embedding").cast("array<double>"), state).alias("states"))


STATE = "CASE WHEN v::DOUBLE <= -0.2 THEN -1 WHEN abs(v::DOUBLE) < 0.05 THEN 0 WHEN v < 0 THEN 1 WHEN v::DOUBLE < 0.12 THEN 2 ELSE 3 END"
CML = f"cml AS (SELECT vec_id AS cell, p AS character, {STATE} AS state FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))"


@query(f"WITH {CML} SELECT round(avg(CASE WHEN state = -1 THEN 1.0 ELSE 0 END), 9) AS missing, round(sum(CASE WHEN state > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN state >= 0 THEN 1 ELSE 0 END)::DOUBLE, 9) AS mutated FROM cml")
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.proportions(cm(spark, sf_dir)).select(F.round("missing", 9).alias("missing"), F.round("mutated", 9).alias("mutated"))


@query(f"WITH {CML} SELECT character::INT AS character, state::INT AS state, count(*) AS n FROM cml GROUP BY ALL")
def mutation_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.array_frequencies(cm(spark, sf_dir))


@query("SELECT min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, year(o_orderdate), month(o_orderdate) HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.array("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")).alias("states"))
    return C.duplicate_groups(cells)


@query()
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bootstrap(cm(spark, sf_dir), 64, 10)


PAIR = f"""WITH {CML}, p AS (
SELECT a.cell AS a, b.cell AS b, a.state AS x, b.state AS y FROM cml a JOIN cml b ON a.character = b.character AND a.cell < b.cell)
SELECT a, b, %s AS d FROM p GROUP BY a, b"""
PRESENT = "sum(CASE WHEN x <> -1 AND y <> -1 THEN 1 ELSE 0 END)"
HELD = "x <> -1 AND y <> -1"


def over(total: str) -> str:
    return PAIR % f"round(CASE WHEN {PRESENT} > 0 THEN ({total}) / {PRESENT}::DOUBLE ELSE 0 END, 6)"


def pair_query(measure: blocks.Measure, digits: int | None = 6) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return blocks.pair_map(cm(spark, sf_dir), measure).withColumn("d", F.round("d", digits) if digits is not None else F.col("d").cast("long"))

    return run


WH = f"sum(CASE WHEN NOT ({HELD}) OR x = y THEN 0 WHEN x = 0 OR y = 0 THEN 1 ELSE 2 END)"
SHARED = "sum(CASE WHEN x = y AND x > 0 THEN 1 ELSE 0 END)"
for _name, _measure, _digits, _sql in (
    ("weighted_hamming", blocks.weighted_hamming, 6, over(WH)),
    ("hamming", blocks.hamming, None, PAIR % "sum(CASE WHEN x <> y THEN 1 ELSE 0 END)::BIGINT"),
    ("shared_similarity", blocks.shared_cuts, None, PAIR % f"{SHARED}::BIGINT"),
    ("shared_similarity_norm", blocks.shared_share, 6, over(SHARED)),
    ("weighted_similarity", blocks.weighted_similarity, 6, over(f"sum(CASE WHEN NOT ({HELD}) THEN 0 WHEN x = y AND x > 0 THEN 2 WHEN x = y THEN 1 ELSE 0 END)")),
    ("exp_neg_hamming", blocks.exponential_similarity, 6, PAIR % f"round(CASE WHEN {PRESENT} > 0 THEN exp(-({WH}) / {PRESENT}::DOUBLE) ELSE 0 END, 6)"),
):
    QUERIES[_name], SQL[_name] = pair_query(_measure, _digits), _sql

DISTANCES = PAIR.replace("SELECT a, b, %s AS d FROM p GROUP BY a, b", f", d AS (SELECT a, b, CASE WHEN {PRESENT} > 0 THEN {WH} / {PRESENT}::DOUBLE ELSE 0 END AS d FROM p GROUP BY a, b)")
MIRROR = "mirror AS (SELECT a AS cell, b AS other, d FROM d UNION ALL SELECT b, a, d FROM d)"


@query(f"{DISTANCES}, {MIRROR} SELECT cell, arg_min(other, (round(d, 9), other)) AS other, round(min(d), 6) AS d FROM mirror GROUP BY cell")
def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distances are fractions of small numbers, so that different ones differ before the ninth digit
    return blocks.nearest(cm(spark, sf_dir), blocks.weighted_hamming).withColumn("d", F.round("d", 6))


@query(f"{DISTANCES}, {MIRROR}, r AS (SELECT cell, sum(d) AS r, count(*) + 1 AS n FROM mirror GROUP BY cell) SELECT d.a, d.b, round((ra.n - 2) * d - ra.r - rb.r, 4) + 0.0 AS q FROM d JOIN r ra ON ra.cell = d.a JOIN r rb ON rb.cell = d.b")
def nj_q_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cm(spark, sf_dir)
    sums = written(blocks.sums_of_rows(cells, blocks.weighted_hamming), "sums")
    return blocks.joining_criterion(cells, sums, blocks.weighted_hamming).select("a", "b", (F.round("q", 4) + 0.0).alias("q"))


@query(f"{DISTANCES}, {MIRROR}, g AS (SELECT vec_id AS cell, label AS grp FROM embeddings), z AS (SELECT grp, count(*) AS n FROM g GROUP BY grp) SELECT g1.grp AS g1, g2.grp AS g2, round(sum(d) / (z1.n * z2.n), 6) AS d FROM mirror JOIN g g1 ON g1.cell = mirror.cell JOIN g g2 ON g2.cell = mirror.other JOIN z z1 ON z1.grp = g1.grp JOIN z z2 ON z2.grp = g2.grp GROUP BY g1.grp, g2.grp, z1.n, z2.n")
def nri_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("grp"))
    return P.over_sizes(blocks.sums_of_groups(cm(spark, sf_dir), groups, blocks.weighted_hamming), groups).withColumn("d", F.round("d", 6))


@query(f"WITH {CML} SELECT a.cell AS a, b.cell AS b, count(*) AS n FROM cml a JOIN cml b ON a.character = b.character AND a.state = b.state AND a.state > 0 AND a.cell < b.cell GROUP BY a.cell, b.cell")
def shared_mutation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.similarity_edges(blocks.one_clade(cm(spark, sf_dir))).select("a", "b", F.col("w").cast("long").alias("n"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root -> region -> nation -> customer."""
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    step = lambda column: (F.col(column) % 5 + 1).cast("double") / 10
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"))
    return root.union(region.select(key("R", "r_regionkey"), F.lit("root"), step("r_regionkey"))).union(nation.select(key("N", "n_nationkey"), key("R", "n_regionkey"), step("n_nationkey"))).union(customer.select(key("C", "c_custkey"), key("N", "c_nationkey"), step("c_custkey")))


TREE = """
t(node, parent, length) AS (SELECT 'root', NULL::VARCHAR, 0.0::DOUBLE UNION ALL SELECT 'R' || r_regionkey, 'root', (r_regionkey % 5 + 1)::DOUBLE / 10 FROM region
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, (n_nationkey % 5 + 1)::DOUBLE / 10 FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, (c_custkey % 5 + 1)::DOUBLE / 10 FROM customer),
path AS (SELECT node, node AS ancestor, 0 AS hops, 0.0::DOUBLE AS distance FROM t UNION ALL SELECT path.node, t.parent, hops + 1, distance + t.length FROM path JOIN t ON t.node = path.ancestor WHERE t.parent IS NOT NULL),
leaf AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
size AS (SELECT ancestor AS node, count(*) AS n FROM path JOIN leaf USING (node) GROUP BY ancestor)"""
WITH_TREE = f"WITH RECURSIVE {TREE}"


@query(f"{WITH_TREE} SELECT node, max(hops) AS depth, round(max(distance), 6) AS time FROM path GROUP BY node")
def tree_depth_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.node_times(T.closure(tree(spark, sf_dir))).withColumn("time", F.round("time", 6))


@query(f"{WITH_TREE} SELECT node, n AS n_leaves FROM size")
def tree_leaves_per_clade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.clade_sizes(t, T.closure(t))


@query(f"""{WITH_TREE}, pair AS (SELECT 'C' || c_custkey AS a, 'N' || (c_custkey % 25) AS b FROM customer)
SELECT a, b, arg_min(x.ancestor, x.hops) AS lca, round(min_by(x.distance + y.distance, x.hops), 6) AS distance FROM pair JOIN path x ON x.node = a JOIN path y ON y.node = b AND y.ancestor = x.ancestor GROUP BY a, b""")
def tree_lca_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("N"), (F.col("c_custkey") % 25).cast("string")).alias("b"))
    return T.lowest_common_ancestors(pairs, T.closure(tree(spark, sf_dir))).withColumn("distance", F.round("distance", 6))


GONE = "gone AS (SELECT 'C' || c_custkey AS node FROM customer WHERE c_acctbal < 5000 OR c_nationkey < 3)"


def losing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_acctbal < 5000 OR c_nationkey < 3").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"))


@query(f"{WITH_TREE}, {GONE}, kept AS (SELECT DISTINCT ancestor AS node FROM path JOIN leaf USING (node) WHERE node NOT IN (SELECT node FROM gone) UNION SELECT 'root') SELECT t.node, t.parent, t.length FROM t JOIN kept USING (node)")
def tree_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.prune(t, T.closure(t), losing(spark, sf_dir))


@query(f"""{WITH_TREE}, one AS (SELECT node FROM t WHERE node = 'root' OR left(node, 1) = 'C' OR left(node, 1) = 'N'),
near AS (SELECT p.node, arg_min(p.ancestor, p.hops) AS parent, min_by(p.distance, p.hops) AS length FROM path p JOIN one USING (node) JOIN one k ON k.node = p.ancestor WHERE hops > 0 GROUP BY p.node)
SELECT node, parent, round(length, 6) AS length FROM near UNION ALL SELECT 'root', NULL, 0.0""")
def tree_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.contract(t, T.closure(t), t.where("node = 'root' OR node LIKE 'C%' OR node LIKE 'N%'").select("node")).withColumn("length", F.round("length", 6))


LEAF_STATES = "cs AS (SELECT 'C' || c_custkey AS node, [(c_custkey % 3)::INT, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey % 2 END, CASE WHEN c_nationkey % 5 = 0 THEN 2 ELSE c_custkey % 2 END] AS states FROM customer), lc AS (SELECT node, unnest(states) AS state, unnest([0, 1, 2]) AS character FROM cs)"
STATES = f"{LEAF_STATES}, anc AS (SELECT p.ancestor AS node, lc.character, CASE WHEN min(CASE WHEN state <> -1 THEN state END) IS NULL THEN -1 WHEN min(CASE WHEN state <> -1 THEN state END) = max(CASE WHEN state <> -1 THEN state END) THEN max(CASE WHEN state <> -1 THEN state END) ELSE 0 END::INT AS state FROM path p JOIN lc USING (node) GROUP BY ALL)"


def leaf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"), F.array((F.col("c_custkey") % 3).cast("int"), F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey") % 2).cast("int"), F.when(F.col("c_nationkey") % 5 == 0, 2).otherwise(F.col("c_custkey") % 2).cast("int")).alias("states"))


@query(f"{WITH_TREE}, {STATES} SELECT node, character::INT AS character, state FROM anc")
def ancestral_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.ancestral_states(t, T.closure(t), leaf_states(spark, sf_dir))


@query(f"{WITH_TREE}, {STATES} SELECT t.parent, t.node, x.character::INT AS character, x.state FROM t JOIN anc x USING (node) JOIN anc y ON y.node = t.parent AND y.character = x.character WHERE x.state <> y.state AND x.state <> -1 AND y.state <> -1")
def mutations_per_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.mutations(t, T.ancestral_states(t, T.closure(t), leaf_states(spark, sf_dir)))


@query(f"{WITH_TREE}, {STATES} SELECT count(*) AS parsimony FROM t JOIN anc x USING (node) JOIN anc y ON y.node = t.parent AND y.character = x.character WHERE x.state <> y.state")
def parsimony(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.mutations(t, T.ancestral_states(t, T.closure(t), leaf_states(spark, sf_dir)), count_missing=True).agg(F.count(F.lit(1)).alias("parsimony"))


FITCH = """
v1 AS (SELECT t.parent AS node, c_mktsegment AS label, count(*) AS n FROM customer JOIN t ON t.node = 'C' || c_custkey GROUP BY ALL),
s1 AS (SELECT node, label, n FROM (SELECT *, max(n) OVER (PARTITION BY node) AS most FROM v1) WHERE n = most),
v2 AS (SELECT t.parent AS node, label, count(*) AS n FROM s1 JOIN t USING (node) GROUP BY ALL),
s2 AS (SELECT node, label, n FROM (SELECT *, max(n) OVER (PARTITION BY node) AS most FROM v2) WHERE n = most),
v3 AS (SELECT t.parent AS node, label, count(*) AS n FROM s2 JOIN t USING (node) GROUP BY ALL),
s3 AS (SELECT node, label, n FROM (SELECT *, max(n) OVER (PARTITION BY node) AS most FROM v3) WHERE n = most),
sets AS (SELECT 'C' || c_custkey AS node, c_mktsegment AS label, NULL::BIGINT AS n FROM customer UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
kids AS (SELECT t.parent AS node, count(*) AS k FROM t JOIN (SELECT DISTINCT node FROM sets) USING (node) GROUP BY t.parent)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("label"))


@query(f"{WITH_TREE}, {FITCH} SELECT s.node, array_to_string(list(label ORDER BY label), ',') AS labels, coalesce(max(k.k) - max(s.n), 0) AS cost FROM sets s LEFT JOIN kids k USING (node) GROUP BY s.node")
def fitch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.fitch_hartigan(t, T.closure(t), segments(spark, sf_dir)).select("node", F.concat_ws(",", "labels").alias("labels"), "cost")


@query(f"{WITH_TREE}, {FITCH} SELECT sum(cost)::BIGINT AS score FROM (SELECT max(k.k) - max(s.n) AS cost FROM sets s JOIN kids k USING (node) GROUP BY s.node)")
def fitch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.small_parsimony(t, T.closure(t), segments(spark, sf_dir))


@query(f"""{WITH_TREE}, kids AS (SELECT parent, count(*) AS k FROM t WHERE parent IS NOT NULL GROUP BY parent), depth AS (SELECT node, max(hops) AS depth FROM path GROUP BY node)
SELECT t.node, round(CASE WHEN t.parent IS NULL OR s.n < 10 OR depth < 1 OR k.k < 2 THEN 1.0::DOUBLE ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(k.k - 1), lambda i: greatest(u.n - s.n - i, 0) / (u.n - 1 - i)::DOUBLE)), lambda x, y: x * y) END, 9) AS pvalue
FROM t JOIN size s USING (node) JOIN depth USING (node) LEFT JOIN kids k ON k.parent = t.parent LEFT JOIN size u ON u.node = t.parent""")
def expansion_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.expansion_pvalues(t, T.closure(t)).withColumn("pvalue", F.round("pvalue", 9))


@query(f"""{WITH_TREE}, kid AS (SELECT t.parent AS node, sum(n * (n - 1) * (n - 2) / 6.0::DOUBLE) AS inside FROM t JOIN size USING (node) WHERE t.parent IS NOT NULL GROUP BY t.parent)
SELECT node, (SELECT max(hops) FROM path WHERE path.node = kid.node) AS depth, round(n * (n - 1) * (n - 2) / 6.0::DOUBLE - inside)::BIGINT AS triplets FROM kid JOIN size USING (node)""")
def triplet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.triplet_counts(t, T.closure(t))


@query(f"{WITH_TREE} SELECT n AS n_leaves, round(sum(length), 6) AS length FROM t JOIN size USING (node) WHERE parent IS NOT NULL GROUP BY n")
def site_frequency_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.site_frequency_spectrum(t, T.closure(t)).withColumn("length", F.round("length", 6))


@query("WITH r AS (SELECT c_acctbal::DOUBLE + 1000 AS x, row_number() OVER (ORDER BY c_acctbal) AS i FROM customer) SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gini(read(spark, sf_dir, "customer").select((F.col("c_acctbal").cast("double") + 1000).alias("x")), "x").select(F.round("gini", 6).alias("gini"))


@query(f"{WITH_TREE}, d AS (SELECT t.parent AS node, max(n) - min(n) AS d FROM t JOIN size USING (node) WHERE t.parent IS NOT NULL GROUP BY t.parent) SELECT ancestor AS node, sum(d)::BIGINT AS colless FROM path JOIN d USING (node) GROUP BY ancestor")
def colless(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.colless(t, T.closure(t))


@query(f"{WITH_TREE} SELECT t.parent AS node, round(max(n) / sum(n), 9) AS imbalance FROM t JOIN size USING (node) WHERE t.parent IS NOT NULL GROUP BY t.parent")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.imbalance(t, T.closure(t)).withColumn("imbalance", F.round("imbalance", 9))


def resettled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree with every seventh customer in the next nation."""
    t = tree(spark, sf_dir)
    key = F.substring("node", 2, 20).cast("long")
    return t.withColumn("parent", F.when(F.col("node").startswith("C") & (key % 7 == 0), F.concat(F.lit("N"), ((F.substring("parent", 2, 20).cast("long") + 1) % 25).cast("string"))).otherwise(F.col("parent")))


RF = """
m(leaf, nation, region) AS (SELECT c_custkey, 'N' || c_nationkey, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
k(leaf, nation, region) AS (SELECT c_custkey, 'N' || n_nationkey, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END),
first AS (SELECT c_custkey AS leaf FROM customer ORDER BY 'C' || c_custkey LIMIT 1),
c1 AS (SELECT nation AS node, list(leaf ORDER BY leaf) AS s FROM m GROUP BY nation UNION ALL SELECT region, list(leaf ORDER BY leaf) FROM m GROUP BY region),
c2 AS (SELECT nation AS node, list(leaf ORDER BY leaf) AS s FROM k GROUP BY nation UNION ALL SELECT region, list(leaf ORDER BY leaf) FROM k GROUP BY region),
every AS (SELECT list(c_custkey ORDER BY c_custkey) AS s FROM customer),
b1 AS (SELECT DISTINCT CASE WHEN list_contains(s, (SELECT leaf FROM first)) THEN list_filter((SELECT s FROM every), lambda x: NOT list_contains(s, x)) ELSE s END AS s FROM c1),
b2 AS (SELECT DISTINCT CASE WHEN list_contains(s, (SELECT leaf FROM first)) THEN list_filter((SELECT s FROM every), lambda x: NOT list_contains(s, x)) ELSE s END AS s FROM c2),
g1 AS (SELECT s FROM b1 WHERE len(s) BETWEEN 2 AND (SELECT count(*) - 2 FROM customer)), g2 AS (SELECT s FROM b2 WHERE len(s) BETWEEN 2 AND (SELECT count(*) - 2 FROM customer))
SELECT ((SELECT count(*) FROM g1) + (SELECT count(*) FROM g2) - 2 * (SELECT count(*) FROM g1 SEMI JOIN g2 USING (s)))::BIGINT AS distance, ((SELECT count(*) FROM g1) + (SELECT count(*) FROM g2))::BIGINT AS most"""


@query(f"WITH {RF}")
def rf_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.robinson_foulds(tree(spark, sf_dir), resettled(spark, sf_dir))


def leaf_pairs(spark: SparkSession, sf_dir: str, paths: DataFrame) -> DataFrame:
    """Pairs of customers of one nation whose keys are next to each other there, with their distance."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("a"), F.col("c_custkey"))
    from pyspark.sql import Window

    pairs = c.withColumn("b", F.lead("a").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("b IS NOT NULL")
    return T.lowest_common_ancestors(pairs, paths)


PAIRS = "w AS (SELECT 'S' || x.s_suppkey AS a, 'S' || y.s_suppkey AS b, CASE WHEN x.s_nationkey = y.s_nationkey THEN 1.0::DOUBLE ELSE 3.0 END AS d, x.s_acctbal::DOUBLE AS p, y.s_acctbal::DOUBLE AS q FROM supplier x JOIN supplier y ON 'S' || x.s_suppkey < 'S' || y.s_suppkey)"


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, distance): all pairs of leaves of the tree root -> nation -> supplier."""
    from cladeworks.plans.tree_bindings import wide_tree

    t = wide_tree(spark, sf_dir)
    tips = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("cell"), F.array().cast("array<int>").alias("states"))
    return T.lowest_common_ancestors(P.all_pairs(tips).select("a", "b"), T.closure(t))


def balances(spark: SparkSession, sf_dir: str, name: str, value: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias(name), F.col("s_acctbal").cast("double").alias(value))


@query(f"""WITH {PAIRS}, z AS (SELECT avg(s_acctbal::DOUBLE) AS m, stddev_pop(s_acctbal::DOUBLE) AS s FROM supplier)
SELECT round(sum((p - m) / s * (q - m) / s / d) / sum(1 / d), 6) AS morans_i FROM w, z""")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeworks.plans.tree_bindings import wide_tree

    t = wide_tree(spark, sf_dir)
    return T.morans_i_of_tree(t, T.closure(t), balances(spark, sf_dir, "node", "x")).select(F.round("morans_i", 6).alias("morans_i"))


@query(f"WITH {PAIRS} SELECT CASE WHEN stddev_pop(d) > 0 AND stddev_pop(abs(p - q)) > 0 THEN round(corr(d, abs(p - q)), 6) END AS r FROM w")
def cophenetic_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = supplier_pairs(spark, sf_dir)
    d = pairs.join(balances(spark, sf_dir, "a", "xa"), "a").join(balances(spark, sf_dir, "b", "xb"), "b").select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d"))
    return T.cophenetic_correlation(pairs, d).select(F.round("r", 6).alias("r"))


@query(f"""{WITH_TREE}, o AS (SELECT leaf.node, (row_number() OVER (ORDER BY 'root' || chr(1) || g.parent || chr(1) || t.parent || chr(1) || t.node) - 1)::DOUBLE AS x FROM leaf JOIN t USING (node) JOIN t g ON g.node = t.parent)
SELECT p.ancestor AS node, (min(x) + max(x)) / 2 AS x, round((SELECT max(distance) FROM path q WHERE q.node = p.ancestor), 6) AS y FROM path p JOIN o USING (node) GROUP BY p.ancestor""")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.layout(t, T.closure(t)).withColumn("y", F.round("y", 6))


def events_mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("intbc"))


@query()
def lineage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.call_lineage_groups(events_mol(spark, sf_dir), cluster_prop=0.05, kinship_thresh=0.4)


LINEAGE = "l AS (SELECT DISTINCT user_id AS cell, user_id % 4 AS lineage FROM events), e AS (SELECT DISTINCT user_id AS cell, event_type AS intbc FROM events), z AS (SELECT lineage, count(*) AS size FROM l GROUP BY lineage), p AS (SELECT lineage, intbc, 1 - count(*) / size::DOUBLE AS dropout FROM e JOIN l USING (cell) JOIN z USING (lineage) GROUP BY lineage, intbc, size)"


def lineage_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = events_mol(spark, sf_dir)
    return m, events_mol(spark, sf_dir).select("cell", (F.col("cell") % 4).alias("lineage")).distinct()


@query(f"WITH {LINEAGE} SELECT lineage, intbc, round(dropout, 9) AS dropout FROM p")
def lg_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.presence(*lineage_cells(spark, sf_dir)).withColumn("dropout", F.round("dropout", 9))


@query(f"""WITH {LINEAGE}, t AS (SELECT lineage, count(*) - sum(dropout) AS whole FROM p GROUP BY lineage),
r AS (SELECT e.cell, p.lineage, (count(*) - sum(dropout)) / whole AS raw FROM e JOIN p USING (intbc) JOIN t ON t.lineage = p.lineage GROUP BY e.cell, p.lineage, whole)
SELECT cell, lineage, round(raw / sum(raw) OVER (PARTITION BY cell), 6) AS share FROM r""")
def lg_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, lineages = lineage_cells(spark, sf_dir)
    return clones.membership(m, clones.presence(m, lineages)).withColumn("share", F.round("share", 6))


@query(f"""WITH {CML}, c AS (SELECT character, state, count(*) AS n FROM cml WHERE state <> -1 GROUP BY ALL), p AS (SELECT character, sum(n) AS present FROM c GROUP BY character)
SELECT 'c' AS clade, character::INT AS character, state::INT AS state, n FROM c JOIN p USING (character) WHERE state <> 0 AND n < present ORDER BY n DESC, character, state LIMIT 1""")
def greedy_split_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.split_choice(cm(spark, sf_dir).withColumn("clade", F.lit("c")))


@query()
def hybrid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.hybrid_tree(cm(spark, sf_dir))


def joined_clades(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """All cells: Spark cuts clades down to 40 distinct cells, and only those are joined, a clade a group."""
    return greedy.hybrid_tree(cm(spark, sf_dir), cutoff=40, method=method)


@query()
def upgma_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of all cells, by average linkage of squared distances of the vectors themselves, which do not tie."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("states"))
    d = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return joining.upgma_tree(P.all_pairs(v).select("a", "b", d.alias("d")))


@query()
def hybrid_neighbor_joining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_clades(spark, sf_dir, "nj")


POINTS = "xy AS (SELECT vec_id AS cell, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
NEAR = "g AS (SELECT a.cell AS a, b.cell AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS q FROM xy a, xy b WHERE a.cell <> b.cell AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03::DOUBLE * 0.03::DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"WITH {POINTS}, {NEAR} SELECT a, b, round(sqrt(q), 9) AS distance FROM g")
def spatial_radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_graph(points(spark, sf_dir), 0.03).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {POINTS}, {NEAR}, {CML},
v AS (SELECT m.cell, m.character, o.state, count(*) AS n FROM cml m JOIN g ON g.a = m.cell JOIN cml o ON o.cell = g.b AND o.character = m.character WHERE m.state = -1 AND o.state <> -1 GROUP BY ALL),
w AS (SELECT cell, character, arg_max(state, (n, -state)) AS state, max(n) AS n, sum(n) AS whole FROM v GROUP BY ALL)
SELECT m.cell, m.character::INT AS character, CASE WHEN m.state = -1 AND w.n >= 0.6::DOUBLE * w.whole AND w.state <> 0 THEN w.state ELSE m.state END::INT AS state FROM cml m LEFT JOIN w ON w.cell = m.cell AND w.character = m.character""")
def spatial_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = written(spatial.radius_graph(points(spark, sf_dir), 0.03), "graph")
    return spatial.impute(cm(spark, sf_dir), graph, 0.6, 1)


@query(f"""{WITH_TREE}, g AS (SELECT 'C' || c_custkey AS a, lead('C' || c_custkey) OVER w AS b, lead('C' || c_custkey, 2) OVER w AS c FROM customer WINDOW w AS (ORDER BY c_custkey)),
j AS (SELECT g.*, x.parent AS pa, y.parent AS pb, z.parent AS pc, ra.parent AS qa, rb.parent AS qb, rc.parent AS qc FROM g JOIN t x ON x.node = a JOIN t y ON y.node = b JOIN t z ON z.node = c JOIN t ra ON ra.node = x.parent JOIN t rb ON rb.node = y.parent JOIN t rc ON rc.node = z.parent),
s AS (SELECT a, b, c, (pa = pb)::INT + (qa = qb)::INT AS ab, (pa = pc)::INT + (qa = qc)::INT AS ac, (pb = pc)::INT + (qb = qc)::INT AS bc FROM j)
SELECT a, b, c, CASE WHEN ab > ac AND ab > bc THEN c WHEN ac > ab AND ac > bc THEN b WHEN bc > ab AND bc > ac THEN a END AS out FROM s""")
def triplet_outgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("a"))
    name = lambda n, by: c.select((F.col("c_custkey") - by).alias("c_custkey"), F.col("a").alias(n))
    return T.outgroups(c.join(name("b", 1), "c_custkey").join(name("c", 2), "c_custkey"), T.closure(tree(spark, sf_dir)))


@query(f"""{WITH_TREE}, {STATES},
up AS (SELECT g.node, g.character, arg_min(y.state, p.hops) AS above FROM anc g JOIN path p ON p.node = g.node JOIN anc y ON y.node = p.ancestor AND y.character = g.character WHERE g.state = -1 AND y.state <> -1 GROUP BY ALL)
SELECT anc.node, anc.character::INT AS character, CASE WHEN anc.state = -1 AND above > 0 THEN above ELSE anc.state END::INT AS state FROM anc LEFT JOIN up ON up.node = anc.node AND up.character = anc.character""")
def impute_deducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    paths = T.closure(t)
    return T.impute_deducible(t, paths, written(T.ancestral_states(t, paths, leaf_states(spark, sf_dir)), "states"))


@query()
def hybrid_shared_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_clades(spark, sf_dir, "shared")


@query()
def evolutionary_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("grp"))
    return evolution.coupling(cm(spark, sf_dir), groups)


@query()
def log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    states = spark.range(3).select(F.col("id").cast("int").alias("character"), F.explode(F.array(F.lit(1), F.lit(2))).alias("state"), F.lit(0.5).alias("p"))
    return evolution.log_likelihood(t, T.closure(t), leaf_states(spark, sf_dir), states, 1.0, 0.1)


@query()
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return T.transition_counts(t, T.closure(t), segments(spark, sf_dir))
