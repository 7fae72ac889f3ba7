"""Bindings of read collapsing, barcode correction, ambiguous states, graphs of cells and likelihoods, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import blocks
from cladeworks.operators import characters as C
from cladeworks.operators import clocks, clones, collapse, evolution, fitness
from cladeworks.operators import graphs as G
from cladeworks.operators import molecules as M
from cladeworks.operators import pairs as P
from cladeworks.operators import editing as E
from cladeworks.operators import trees as T
from cladeworks.operators import triplets
from cladeworks.plans.bindings import STATE, query, read
from cladeworks.plans.tree_bindings import CELLS as NODE_STATES
from cladeworks.plans.tree_bindings import TREE, WIDE, node_states, orders_tree, wide_tree
from cladeworks.solve import greedy, maxcut, percolation, potential, spectral
from cladeworks.sources import bam, sequences
from cladeworks.sources.scratch import folder, written

# reads: the letters of a read come from the part's number, its qualities from the order's


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    seq = F.translate(F.concat(digits(F.col("l_suppkey") % 7, 6), digits(F.col("l_partkey") % 11, 2)), "0123456789", "ACGTACGTAC")
    qual = F.concat(*[F.char(33 + (F.col("l_orderkey") + 7 * i) % 41) for i in range(8)])
    read_id = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.concat(F.lit("u"), (F.col("l_suppkey") % 7).cast("string")).alias("umi"), read_id.alias("read"), seq.alias("seq"), qual.alias("qual"))


READS = "rd AS (SELECT l_returnflag AS cell, 'u' || (l_suppkey % 7) AS umi, translate(lpad((l_suppkey % 7)::VARCHAR, 6, '0') || lpad((l_partkey % 11)::VARCHAR, 2, '0'), '0123456789', 'ACGTACGTAC') AS seq, " + " || ".join(f"chr((33 + (l_orderkey + {7 * i}) % 41)::INT)" for i in range(8)) + " AS qual, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS read FROM lineitem)"
SEED = "AAACGTAC"


@query(f"WITH {READS} SELECT seq, qual, len(list_filter(range(1, 9), lambda i: substr(seq, i, 1) <> substr('{SEED}', i, 1) AND ascii(substr(qual, i, 1)) - 33 >= 20))::INT AS d, count(*) AS n FROM rd GROUP BY ALL")
def hq_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).groupBy("seq", "qual").agg(F.count(F.lit(1)).alias("n"))
    return r.select("seq", "qual", collapse.hq_mismatches_from_seed(F.lit(SEED), F.col("seq"), F.col("qual")).alias("d"), "n")


@query(f"WITH {READS} SELECT seq, qual, len(list_filter(range(1, 9), lambda i: substr(seq, i, 1) <> substr('{SEED}', i, 1) AND ascii(substr(qual, i, 1)) - 33 >= 15 AND ascii(substr(reverse(qual), i, 1)) - 33 >= 15))::INT AS d, count(*) AS n FROM rd GROUP BY ALL")
def hq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).groupBy("seq", "qual").agg(F.count(F.lit(1)).alias("n"))
    return r.select("seq", "qual", collapse.hq_hamming(F.col("seq"), F.lit(SEED), F.col("qual"), F.reverse("qual"), 15).alias("d"), "n")


@query(f"WITH {READS}, k AS (SELECT cell, umi, seq, count(*) AS n, min(read) AS first FROM rd GROUP BY ALL), m AS (SELECT cell, umi, arg_min(seq, (-n, first)) AS seed, max(n) AS n FROM k GROUP BY ALL) SELECT cell, umi, seed FROM m WHERE n > 1")
def proposed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every molecule's commonest sequence, the first read's of equals; those without one that stands twice have a consensus, which SQL leaves out here."""
    r = written(reads(spark, sf_dir), "reads")
    twice = r.groupBy("cell", "umi", "seq").count().where("count > 1").select("cell", "umi").distinct()
    return collapse.propose_seeds(r).join(twice, ["cell", "umi"], "left_semi")


@query()
def collapsed_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse_umis(reads(spark, sf_dir), 1, 2)


@query()
def collapsed_umis_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse_umis(reads(spark, sf_dir), 1, 2, "likelihood", 10**9)


@query(f"WITH {READS} SELECT cell, umi, 1::BIGINT AS reads, read, seq, qual FROM rd")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads written as unmapped records and read back: molecules by the name, sequences and a tag."""
    name = F.concat_ws("_", "cell", "umi", F.lit("1"))
    path = f"{folder(spark)}/reads-{uuid.uuid4().hex}"
    bam.write_bam(reads(spark, sf_dir).select(name.alias("name"), "seq", "qual", F.create_map(F.lit("XR"), "read").alias("tags")), path)
    back = sequences.molecules_of_names(bam.read_bam(spark, path).drop("flag"))
    return back.select("cell", "umi", "reads", F.col("tags")["XR"].alias("read"), "seq", "qual")


CELLS = "r AS (SELECT lpad((l_partkey % 500)::VARCHAR, 4, '0') AS raw, " + " || ".join(f"chr((33 + (l_orderkey + {i}) % 30)::INT)" for i in range(4)) + " AS qual FROM lineitem), w AS (SELECT DISTINCT lpad((p_partkey % 500)::VARCHAR, 4, '0') AS cell FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 500 < 400)"


@query(f"""WITH {CELLS}, p AS (SELECT cell, count(r.raw) + 1 AS prior FROM w LEFT JOIN r ON r.raw = cell GROUP BY cell),
o AS (SELECT DISTINCT raw, qual FROM r WHERE raw NOT IN (SELECT cell FROM w)),
n AS (SELECT raw, qual, cell, prior * pow(10.0::DOUBLE, -(ascii(substr(qual, list_filter(range(1, 5), lambda i: substr(raw, i, 1) <> substr(cell, i, 1))[1], 1)) - 33) / 10) AS w FROM o JOIN p ON hamming(raw, cell) = 1),
b AS (SELECT raw, qual, max({{'w': w, 'c': cell}}) AS best, sum(w) AS whole FROM n GROUP BY ALL)
SELECT r.raw, r.qual, coalesce(w.cell, CASE WHEN best.w >= 0.975::DOUBLE * whole THEN best.c END) AS cell, count(*) AS n FROM r LEFT JOIN w ON w.cell = r.raw LEFT JOIN b ON b.raw = r.raw AND b.qual = r.qual GROUP BY ALL""")
def corrected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").select(F.lpad((F.col("l_partkey") % 500).cast("string"), 4, "0").alias("raw"), F.concat(*[F.char(33 + (F.col("l_orderkey") + i) % 30) for i in range(4)]).alias("qual"))
    listed = read(spark, sf_dir, "part").where("p_partkey % 3 = 0 AND p_partkey % 500 < 400").select(F.lpad((F.col("p_partkey") % 500).cast("string"), 4, "0").alias("cell"))
    return M.correct_cells(r, listed).groupBy("raw", "qual", "cell").agg(F.count(F.lit(1)).alias("n"))


AMBIGUOUS = "am AS (SELECT l_partkey AS cell, l_returnflag AS character, list(l_linenumber % 4 ORDER BY l_linenumber % 4) AS states FROM lineitem GROUP BY ALL)"


def ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell"), F.col("l_returnflag").alias("character")).agg(F.array_sort(F.collect_list(F.col("l_linenumber") % 4)).alias("states"))


@query(f"WITH {AMBIGUOUS} SELECT cell, character, array_to_string(list_sort(list_distinct(states)), ',') AS states FROM am")
def collapsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse_ambiguous(ambiguous(spark, sf_dir)).select("cell", "character", F.concat_ws(",", F.col("states").cast("array<string>")).alias("states"))


@query(f"WITH {AMBIGUOUS}, u AS (SELECT cell, character, unnest(states) AS s FROM am), k AS (SELECT cell, character, s, count(*) AS n FROM u GROUP BY ALL) SELECT cell, character, arg_min(s, (-n, s))::BIGINT AS state FROM k GROUP BY cell, character")
def resolved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_ambiguous(ambiguous(spark, sf_dir)).withColumn("state", F.col("state").cast("long"))


@query(f"WITH {AMBIGUOUS} SELECT cell, max(len(states)) > 1 AS ambiguous FROM am GROUP BY cell")
def ambiguous_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ambiguous_cells(ambiguous(spark, sf_dir))


@query("SELECT l_partkey AS cell, l_returnflag AS character, (l_linenumber % 4)::BIGINT AS state FROM lineitem")
def unravelled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unravel(ambiguous(spark, sf_dir)).withColumn("state", F.col("state").cast("long"))


SITES = "SELECT l_suppkey AS cell, CASE WHEN l_linenumber = 3 THEN 'None' ELSE 'I' || l_linenumber END AS r1, CASE WHEN l_quantity > 40 THEN NULL ELSE 'D' || (l_partkey % 6) END AS r2 FROM lineitem"


@query(f"SELECT cell, r1, r2, CASE WHEN r1 = 'None' THEN 0.9::DOUBLE ELSE 2.9 END AS s1, CASE WHEN r2 IS NULL THEN 0.0::DOUBLE ELSE 1.9 END AS s2 FROM ({SITES})")
def cut_site_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.when(F.col("l_linenumber") == 3, "None").otherwise(F.concat(F.lit("I"), F.col("l_linenumber").cast("string"))).alias("r1"), F.when(F.col("l_quantity") <= 40, F.concat(F.lit("D"), (F.col("l_partkey") % 6).cast("string"))).alias("r2"))
    return C.with_site_codes(a, C.default_cut_sites(a))


@query("""WITH l AS (SELECT DISTINCT user_id AS cell, user_id % 4 AS lineage FROM events), o AS (SELECT user_id AS cell, event_type || (value > 50)::INT AS intbc, l.lineage FROM events JOIN l ON l.cell = user_id),
z AS (SELECT lineage, count(DISTINCT cell) AS size FROM o GROUP BY lineage), h AS (SELECT lineage, intbc FROM o JOIN z USING (lineage) GROUP BY lineage, intbc, size HAVING count(DISTINCT cell) > 0.6::DOUBLE * size AND intbc <> 'click1')
SELECT o.cell, o.lineage, o.intbc, count(*) AS n FROM o SEMI JOIN h USING (lineage, intbc) GROUP BY ALL""")
def final_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("cell"), F.concat("event_type", (F.col("value") > 50).cast("int").cast("string")).alias("intbc"))
    lineages = e.select(F.col("user_id").alias("cell"), (F.col("user_id") % 4).alias("lineage")).distinct()
    return clones.filter_final_barcodes(m, lineages, 0.6, "click1").groupBy("cell", "lineage", "intbc").agg(F.count(F.lit(1)).alias("n"))


# cells of whole vectors, in the clades of their labels

CMC = f"cmc AS (SELECT label::VARCHAR AS clade, vec_id AS cell, p AS character, {STATE} AS state FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))"


def in_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    state = lambda x: F.when(x <= -0.2, -1).when(F.abs(x) < 0.05, 0).when(x < 0, 1).when(x < 0.12, 2).otherwise(3)
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clade"), F.col("vec_id").alias("cell"), F.transform(v, state).alias("states"))


SHARED = f"{CMC}, sh AS (SELECT a.clade, a.cell AS a, b.cell AS b, count(*)::DOUBLE AS s FROM cmc a JOIN cmc b ON a.clade = b.clade AND a.character = b.character AND a.state = b.state AND a.state > 0 AND a.cell < b.cell GROUP BY ALL)"


@query(f"""WITH {CMC}, v AS (SELECT clade, character, state, count(*) AS f FROM cmc GROUP BY ALL), z AS (SELECT clade, count(DISTINCT cell) AS n FROM cmc GROUP BY clade),
k AS (SELECT c.*, v.f, z.n - v.f - coalesce(m.f, 0) AS rest FROM cmc c JOIN v USING (clade, character, state) JOIN z USING (clade) LEFT JOIN v m ON m.clade = c.clade AND m.character = c.character AND m.state = -1 WHERE c.state <> -1)
SELECT a.clade, a.cell AS a, b.cell AS b, sum(CASE WHEN a.state = b.state THEN -3 * a.rest ELSE CASE WHEN a.state <> 0 THEN a.f - 1 ELSE 0 END + CASE WHEN b.state <> 0 THEN b.f - 1 ELSE 0 END END)::DOUBLE AS w
FROM k a JOIN k b ON a.clade = b.clade AND a.character = b.character AND a.cell < b.cell WHERE a.state <> 0 OR b.state <> 0 GROUP BY ALL HAVING w <> 0""")
def connectivity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connectivity_graph(in_clades(spark, sf_dir))


SIMILAR = f"{SHARED}, ab AS (SELECT * FROM sh WHERE s > 8), lo AS (SELECT clade, min(s) AS least, count(*) AS k FROM ab GROUP BY clade), g AS (SELECT clade, a, b, CASE WHEN k > 1 THEN s - least ELSE s END AS w FROM ab JOIN lo USING (clade))"


@query(f"WITH {SIMILAR} SELECT * FROM g WHERE w > 0")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.similarity_graph(in_clades(spark, sf_dir), 8)


@query(f"WITH {SIMILAR} SELECT sum(CASE WHEN a % 2 <> b % 2 THEN w ELSE 0 END) AS w FROM g WHERE w > 0")
def cut_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.cut_weight(in_clades(spark, sf_dir).withColumn("side", F.col("cell") % 2), 8)


@query(f"WITH {SIMILAR}, s AS (SELECT a, b, CASE WHEN a % 2 <> b % 2 THEN -w ELSE w END AS q FROM g WHERE w > 0) SELECT cell, sum(q) AS gain FROM (SELECT a AS cell, q FROM s UNION ALL SELECT b, q FROM s) GROUP BY cell")
def cut_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.cut_gains(in_clades(spark, sf_dir).withColumn("side", F.col("cell") % 2), 8)


@query()
def max_cut_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = in_clades(spark, sf_dir).select("cell", (F.col("cell") % 2).alias("side"))
    return G.max_cut_improve(written(blocks.similarity_graph(in_clades(spark, sf_dir), 8), "graph"), sides)


@query(f"""WITH RECURSIVE {SHARED}, lv AS (SELECT DISTINCT clade, s AS t FROM sh UNION SELECT DISTINCT clade, 0 FROM cmc),
re(clade, t, a, b) AS (SELECT lv.clade, t, c.cell, c.cell FROM lv JOIN (SELECT DISTINCT clade, cell FROM cmc) c USING (clade) WHERE t >= (SELECT max(q) FROM (SELECT clade AS d, min(m) AS q FROM (SELECT clade, a AS x, max(s) AS m FROM (SELECT clade, a, s FROM sh UNION ALL SELECT clade, b, s FROM sh) GROUP BY ALL) GROUP BY clade) z WHERE z.d = lv.clade) - 3
    UNION SELECT re.clade, re.t, re.a, CASE WHEN sh.a = re.b THEN sh.b ELSE sh.a END FROM re JOIN sh ON sh.clade = re.clade AND (sh.a = re.b OR sh.b = re.b) AND sh.s > re.t),
pa AS (SELECT clade, t, a AS cell, min(b) AS root FROM re GROUP BY ALL), ok AS (SELECT clade, min(t) AS t FROM (SELECT clade, t FROM pa GROUP BY ALL HAVING count(DISTINCT root) > 1) GROUP BY clade)
SELECT pa.clade, pa.cell, pa.root FROM pa JOIN ok USING (clade, t)""")
def percolated_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = in_clades(spark, sf_dir)
    return G.percolate(cells, blocks.similarity_forest(cells))


ANCESTORS = f"""{CMC}, pr AS (SELECT a.clade, a.cell AS a, b.cell AS b, a.character AS p, a.state AS x, b.state AS y, CASE WHEN a.state = -1 THEN b.state WHEN b.state = -1 OR a.state = b.state THEN a.state ELSE 0 END AS u FROM cmc a JOIN cmc b ON a.clade = b.clade AND a.character = b.character AND a.cell < b.cell),
up AS (SELECT clade, a, b, array_to_string(list(u ORDER BY p), ',') AS states, sum((x <> u AND x <> -1 AND u <> -1)::INT + (y <> u AND y <> -1 AND u <> -1)::INT)::INT AS height FROM pr GROUP BY clade, a, b),
ne AS (SELECT cell, min(height) AS least FROM (SELECT a AS cell, height FROM up UNION ALL SELECT b, height FROM up) GROUP BY cell)"""


@query(f"WITH {ANCESTORS} SELECT a, b, states, height FROM up JOIN ne x ON x.cell = a JOIN ne y ON y.cell = b WHERE height < 40 OR height = x.least OR height = y.least")
def ancestor_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_clades(spark, sf_dir)
    return blocks.ancestor_layer(c, 40).withColumn("states", F.concat_ws(",", F.col("states").cast("array<string>")))


@query(f"""WITH {CMC}, ro AS (SELECT clade, character, CASE WHEN count(*) FILTER (state <> -1) = 0 THEN -1 WHEN min(state) FILTER (state <> -1) = max(state) FILTER (state <> -1) THEN min(state) FILTER (state <> -1) ELSE 0 END AS up FROM cmc GROUP BY ALL),
d AS (SELECT clade, cell, sum((state <> -1 AND up <> -1 AND state <> up)::INT) AS d FROM cmc JOIN ro USING (clade, character) GROUP BY ALL) SELECT clade, max(d) <= 42 AS done FROM d GROUP BY clade""")
def clades_within_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_cutoff(in_clades(spark, sf_dir), lca_cutoff=42)


@query(f"WITH RECURSIVE {TREE}, sp AS (SELECT ancestor AS node, hops FROM path WHERE node = 'O37') SELECT t.node, CASE WHEN sp.node IS NULL THEN t.parent ELSE x.node END AS parent, CASE WHEN sp.node IS NULL THEN t.length ELSE coalesce(y.length, 0.0) END AS length FROM t LEFT JOIN sp USING (node) LEFT JOIN sp x ON x.hops = sp.hops - 1 LEFT JOIN t y ON y.node = x.node")
def rerooted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_tree(spark, sf_dir)
    return G.rerooted(t, T.closure(t), "O37")


@query(f"WITH {CMC}, d AS (SELECT a.cell AS a, b.cell AS b, sum((a.state <> b.state)::INT)::DOUBLE AS d FROM cmc a JOIN cmc b ON a.character = b.character AND a.cell < b.cell WHERE a.cell = 3 OR b.cell = 3 GROUP BY ALL) SELECT CASE WHEN a = 3 THEN b ELSE a END AS other, 1.5::DOUBLE * d AS d FROM d")
def dissimilarity_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = in_clades(spark, sf_dir).where("size(states) > 0")
    one = cells.where("cell = 3").select(F.col("cell").alias("one"), F.col("states").alias("own"))  # the row that changes
    own = cells.where("cell <> 3").crossJoin(F.broadcast(one)).select(F.least("cell", "one").alias("a"), F.greatest("cell", "one").alias("b"), P.hamming(F.col("own"), F.col("states")).cast("double").alias("d"))
    pairs = written(own, "pairs")
    changed = G.set_dissimilarities(pairs, 3, G.dissimilarities_of(pairs, 3).withColumn("d", 1.5 * F.col("d")))
    return G.dissimilarities_of(changed, 3)


# likelihoods of irreversible editing on root -> nation -> supplier

LIKELY = """w(node, parent, length) AS (%s), st AS (SELECT 'S' || s_suppkey AS node, c AS character, CASE WHEN (s_suppkey + c) %% 5 = 0 THEN -1 ELSE (s_suppkey * (c + 1)) %% 3 END AS state FROM supplier, range(3) r(c)),
k AS (SELECT DISTINCT c AS character, s AS cut FROM range(3) x(c), (SELECT unnest([1, 2]) AS s)),
lf AS (SELECT st.node, st.character, k.cut, CASE WHEN state = -1 THEN 0.1::DOUBLE WHEN state = 0 THEN 0.9 ELSE 0 END AS o, CASE WHEN state = -1 THEN 0.1::DOUBLE WHEN state = k.cut THEN 0.9 ELSE 0 END AS q FROM st JOIN k USING (character)),
e1 AS (SELECT lf.node, w.parent, character, min(%s * o) + sum((1 - %s) * 0.5::DOUBLE * q) AS up FROM lf JOIN w USING (node) GROUP BY lf.node, w.parent, character),
lg AS (SELECT x, CASE WHEN x > 0 THEN ln(x) ELSE '-infinity'::DOUBLE END AS y FROM (SELECT 1.0::DOUBLE AS x)),
no AS (SELECT parent AS node, character, sum(CASE WHEN up > 0 THEN ln(up) ELSE '-infinity'::DOUBLE END) AS o FROM e1 GROUP BY ALL),
nq AS (SELECT w.parent AS node, lf.character, lf.cut, sum(CASE WHEN q > 0 THEN ln(q) ELSE '-infinity'::DOUBLE END) AS q FROM lf JOIN w USING (node) GROUP BY ALL),
e2 AS (SELECT no.node, no.character, min(%s * exp(no.o)) + sum((1 - %s) * 0.5::DOUBLE * exp(nq.q)) AS up FROM no JOIN nq USING (node, character) JOIN w USING (node) GROUP BY no.node, no.character)
SELECT character::INT AS character, round(sum(ln(up)), 6) AS loglik FROM e2 GROUP BY character"""
STAY, STEP = "exp(-0.7::DOUBLE * length)", "0.6::DOUBLE"


def likelihood_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = F.col("s_suppkey")
    entry = lambda c: F.when((s + c) % 5 == 0, -1).otherwise((s * (c + 1)) % 3).cast("int")
    cells = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s.cast("string")).alias("node"), F.array(*(entry(c) for c in range(3))).alias("states"))
    t = wide_tree(spark, sf_dir)
    used = cells.select("node").union(t.join(cells, "node").select("parent").distinct()).union(t.where("parent IS NULL").select("node"))
    priors = spark.range(3).select(F.col("id").cast("int").alias("character"), F.explode(F.array(F.lit(1), F.lit(2))).alias("state"), F.lit(0.5).alias("p"))
    return written(t.join(used, "node", "left_semi"), "likely-tree"), cells, priors


@query("WITH " + LIKELY % (WIDE, STAY, STAY, STAY, STAY))
def likelihood_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cells, priors = likelihood_inputs(spark, sf_dir)
    return evolution.log_likelihood(t, T.closure(t), cells, priors, 0.7, 0.1).withColumn("loglik", F.round("loglik", 6))


@query("WITH " + LIKELY % (WIDE, STEP, STEP, STEP, STEP))
def likelihood_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cells, priors = likelihood_inputs(spark, sf_dir)
    return evolution.log_likelihood_discrete(t, T.closure(t), cells, priors, 0.4, 0.1).withColumn("loglik", F.round("loglik", 6))


@query(f"""WITH RECURSIVE {TREE}, {NODE_STATES}, l AS (SELECT node, unnest(states) AS state, unnest([0, 1]) AS character FROM cs),
e AS (SELECT t.node, count(*) FILTER (x.state <> 0) AS m, count(*) FILTER (x.state = 0) AS u FROM t JOIN l x USING (node) JOIN l y ON y.node = t.parent AND y.character = x.character WHERE y.state = 0 AND x.state <> -1 GROUP BY t.node)
SELECT t.node, t.parent, round(CASE WHEN t.parent IS NULL THEN 0.0::DOUBLE ELSE coalesce(greatest(0.01, -ln(greatest(u, 0.5) / (m + u))), 0.01) END, 9) AS length FROM t LEFT JOIN e USING (node)""")
def exponential_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = node_states(spark, sf_dir).select("node", F.posexplode("states").alias("character", "state"))
    return evolution.exponential_lengths(orders_tree(spark, sf_dir), states).withColumn("length", F.round("length", 9))


# splitters of clades and the trees they build


@query(f"""WITH {SHARED}, le AS (SELECT clade, min(s) AS least, count(*) AS k FROM sh GROUP BY clade), ed AS (SELECT clade, a, b, CASE WHEN k > 1 THEN s - least ELSE s END AS w FROM sh JOIN le USING (clade)),
de AS (SELECT clade, cell, sum(w) AS d FROM (SELECT clade, a AS cell, w FROM ed WHERE w > 0 UNION ALL SELECT clade, b, w FROM ed WHERE w > 0) GROUP BY ALL),
ve AS (SELECT label::VARCHAR AS clade, vec_id AS cell, embedding[1]::DOUBLE AS x, coalesce(d, 0) AS d, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE, vec_id) AS p FROM embeddings LEFT JOIN de ON de.clade = label::VARCHAR AND de.cell = vec_id),
ii AS (SELECT e.clade, greatest(x.p, y.p) AS p, sum(w) AS inside FROM ed e JOIN ve x ON x.clade = e.clade AND x.cell = e.a JOIN ve y ON y.clade = e.clade AND y.cell = e.b GROUP BY ALL),
pr AS (SELECT ve.*, sum(d - 2 * coalesce(inside, 0)) OVER o AS across, sum(d) OVER o AS volume, sum(d) OVER (PARTITION BY ve.clade) AS total, max(p) OVER (PARTITION BY ve.clade) AS n FROM ve LEFT JOIN ii USING (clade, p) WINDOW o AS (PARTITION BY ve.clade ORDER BY p)),
fr AS (SELECT *, lag(across) OVER (PARTITION BY clade ORDER BY p) AS before FROM pr), be AS (SELECT clade, coalesce(min(p - 1) FILTER (abs(across) > 1e-9 AND abs(before) <= 1e-9), arg_min(p, CASE WHEN least(volume, total - volume) > 1e-9 THEN round(across / least(volume, total - volume), 12) ELSE 0 END)) AS best FROM fr WHERE p < n GROUP BY clade)
SELECT clade, cell, (p <= best)::INT AS side FROM pr JOIN be USING (clade) WHERE total > 0""")
def swept_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut along a given vector, here each cell's first number."""
    first = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clade"), F.col("vec_id").alias("cell"), F.get(F.col("embedding").cast("array<double>"), F.lit(0)).alias("x"))
    return spectral.sweeps_of(in_clades(spark, sf_dir), first)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose few large numbers are their cuts."""
    state = lambda x: F.when(x <= -0.25, 1).when(x > 0.25, 2).when(F.abs(x) < 0.002, -1).otherwise(0)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.transform(F.col("embedding").cast("array<double>"), state).alias("states"))


@query()
def spectral_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def spectral_greedy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_greedy_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def max_cut_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxcut.max_cut_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def max_cut_greedy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxcut.max_cut_greedy_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def percolation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.percolation_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def greedy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.greedy_tree(matrix(spark, sf_dir), cutoff=1024)


@query()
def potential_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors that the cells of each label may have."""
    labels = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").cast("string").alias("clade"))
    edges = potential.potential_graph(matrix(spark, sf_dir).join(labels, "cell"), lca_height=2)
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return edges.withColumn("parent", text("parent")).withColumn("child", text("child"))


# times under a clock, on the full binary tree whose leaves are all suppliers


def clock_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node k has the children 2 k and 2 k + 1; every third node on the way from the root cuts a character, every seventh loses one."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    low, high, n = s.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    leaves = s.select((F.col("k") - low + n).alias("k"))  # keys without gaps
    inner = leaves.select((F.col("k") - n).alias("k")).where("k > 0")
    way = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.floor(F.col("k") / F.pow(F.lit(2.0), i)).cast("long")), lambda a: a > 0)
    nodes = leaves.union(inner).select("k", F.floor(F.col("k") / 2).cast("long").alias("parent"), F.size(F.filter(way, lambda a: a % 3 == 0)).alias("cuts"), (40 - F.size(F.filter(way, lambda a: a % 7 == 0))).alias("present"))
    root = spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("cuts"), F.lit(40).alias("present"))
    return nodes.select(F.col("k").alias("node"), "parent", "cuts", "present").union(root)


@query()
def clock_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = written(clock_nodes(spark, sf_dir), "clock-nodes")
    return clocks.clock_lengths(nodes, clocks.posterior_times(nodes, 0.4, 4.0, 0.2, 300))


@query()
def node_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness in the same tree, with branches of an eighth to seven eighths."""
    nodes = clock_nodes(spark, sf_dir).withColumn("length", F.when(F.col("parent").isNotNull(), (F.col("node") % 7 + 1) / 8))
    return fitness.inferred_fitness(nodes)


@query()
def triplets_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of the tree of orders, looked for in the same tree with its polytomies resolved."""
    t = orders_tree(spark, sf_dir)
    return triplets.triplets_correct_by_depth(triplets.sample_triplets(t, T.closure(t), 100), T.closure(E.resolve_polytomies(t)))
