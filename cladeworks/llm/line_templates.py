"""Recurring lines by a log-template tree of fixed depth: lines that recur over documents but for variable fields are dropped.

Tokens that hold a digit are variable fields wherever they stand. A line descends by its token count, then by its ``depth`` leading tokens,
then by one of up to three parts, of ``depth`` tokens at least, of its remaining tokens, so that a leaf holds lines that agree in their
opening and in one whole part; a line is in one leaf for each part, and fields may vary in all parts but one. Only leaves that recur over
documents are looked at further. Within a leaf a token is constant at its position if more than half of the leaf's lines have it
there. The leaf's agreement does not depend on how large the corpus is, and neither does what is constant. A template is the opening and
the constant tokens; if it recurs and enough of the tokens after the opening are constant, its lines are dropped wherever they stand.

All of it is DataFrame functions. Lines are told apart by what is left of them when digits are masked, and each
distinct one is one row whatever the number of documents that hold it; joins that bring verdicts back to documents are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import written

DEPTH, PARTS, MIN_DOCS, STEADY, MIN_CONSTANT, SALTS = 3, 3, 5, 0.5, 0.6, 8
FIELD = "<*>"


def masked(text: Column) -> Column:
    """A text with spaces as its only white space besides line feeds, and with fields for the tokens that hold a digit."""
    odd = F.lit(False)
    for space in "\t\r\x0b\x0c":
        odd |= F.contains(text, F.lit(space))
    plain = F.when(odd, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)
    # a match begins where a token does, so that long tokens are read once
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)).otherwise(plain)


def tightened(plain: Column) -> Column:
    """Of a masked text, the tokens of each line with one space between; each line feed stays."""
    loose = F.contains(plain, F.lit("  ")) | F.contains(plain, F.lit("\n ")) | F.contains(plain, F.lit(" \n")) | F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" "))
    single = F.regexp_replace(plain, " {2,}", " ")
    return F.when(loose, F.trim(F.replace(F.replace(single, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n")))).otherwise(plain)


def leaves(tokens: Column, depth: int, parts: int) -> Column:
    """The hashes of a line's leaves, one for each part of at least ``depth`` tokens."""
    rest = F.greatest(F.size(tokens) - depth, F.lit(0))
    count = F.greatest(F.least(F.lit(parts), F.floor(rest / depth).cast("int")), F.lit(1))
    bound = lambda j: F.floor(j * rest / count).cast("int")
    key = lambda j: F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth), F.lit(j), F.slice(tokens, bound(j) + depth + 1, bound(j + 1) - bound(j)))
    found = F.array(key(0))
    for n in range(2, parts + 1):
        found = F.when(count < n, found).otherwise(F.array(*map(key, range(n))))
    return found


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, parts: int = PARTS, min_docs: int = MIN_DOCS, steady: float = STEADY, min_constant: float = MIN_CONSTANT, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256 (and the kept text if ``with_text``).

    Lines end at line feeds; tokens are runs of anything but ASCII white space. A leaf recurs if ``min_docs`` documents have a
    line in it; a line that a document repeats counts once. Constant is what more than a share of ``steady`` (a half at least) of the leaf's lines have. A template recurs from ``min_docs``
    lines on and is dropped if at least ``min_constant`` of the tokens after the opening are constant; a line of no more
    than ``depth`` tokens is its own template. Blank lines stay. Null and empty texts have no lines. Equal rows count as one document; rows
    that share an id with different texts, and rows without an id, count each. Documents, lines and leaves are told apart by
    64-bit hashes. Texts and lines of any length are read whole. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    # whole texts are masked, once; a line is known by its place afterwards
    plain = rows.select("row", masked(F.col("text")).alias("plain")).select("row", tightened(F.col("plain")).alias("plain"))
    lines = plain.select("row", F.posexplode(F.split("plain", "\n")).alias("pos", "line")).where("line <> ''")
    keyed = lines.select("row", "pos", "line", F.xxhash64("line").alias("shape"), F.split("line", " ").alias("tokens"))
    masked_lines = written(keyed.select("row", "pos", "shape", leaves(F.col("tokens"), depth, parts).alias("leaves"), "line"), "line-leaves")
    hashed = masked_lines.drop("line")
    filed = hashed.select("row", "shape", F.explode("leaves").alias("leaf"))

    recurring = filed.groupBy("leaf").agg(F.count_distinct("row").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    held = filed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted(recurring), ["leaf", "salt"], "left_semi")
    held = written(held.groupBy("leaf", "shape").agg(F.count_distinct("row").alias("n")), "recurring-leaves")
    # one way at every size; few lines are left to sort
    texts = masked_lines.select("shape", "line", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).join(salted(held.select("shape").distinct()).hint("shuffle_hash"), ["shape", "salt"], "left_semi")
    texts = texts.groupBy("shape").agg(F.first("line").alias("line"))
    held = written(held.join(texts, "shape").select("leaf", "shape", "n", F.slice(F.split("line", " "), F.lit(depth + 1), F.greatest(F.size(F.split("line", " ")) - depth, F.lit(0))).alias("rest")), "leaf-lines")

    sizes = held.groupBy("leaf").agg(F.sum("n").alias("lines"))
    tokens = held.select("leaf", "n", F.posexplode("rest").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    constants = tokens.join(sizes, "leaf").where((F.col("token") != FIELD) & (F.col("n") > F.lit(float(steady)) * F.col("lines")))
    # more than half leaves room for one token at a place
    constants = constants.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("at"))
    # each constant after as many nulls as places were passed over
    before = F.concat(F.array(F.lit(-1)), F.slice(F.col("at.pos"), F.lit(1), F.size("at") - 1))
    spread = F.zip_with("at", before, lambda c, last: F.concat(F.array_repeat(F.lit(None).cast("string"), c["pos"] - last - 1), F.array(c["token"])))
    constants = constants.select("leaf", F.flatten(spread).alias("constants"))
    shaped = held.join(constants, "leaf", "left").withColumn("template", F.zip_with("rest", F.coalesce("constants", F.array().cast("array<string>")), lambda t, c: F.when(t == c, t).otherwise(FIELD)))
    fixed = F.size(F.filter("template", lambda t: t != FIELD))
    shaped = written(shaped.where(fixed >= F.lit(float(min_constant)) * F.size("rest")).select("leaf", "shape", "n", F.md5(F.concat_ws(" ", "template")).alias("template")), "leaf-templates")
    common = shaped.groupBy("leaf", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "template")
    gone = shaped.join(common, ["leaf", "template"], "left_semi").select("shape").distinct()
    dropped = hashed.select("row", "pos", "shape", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).join(salted(gone), ["shape", "salt"], "left_semi")
    dropped = dropped.groupBy("row").agg(F.collect_set("pos").alias("dropped"))

    # texts are dealt by document at every size, and not sorted; those that lose no line are not split
    out = rows.repartition("row").join(dropped.hint("shuffle_hash"), "row", "left").withColumn("lines", F.when(F.col("dropped").isNotNull(), F.split("text", "\n")))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("lines").isNotNull(), F.size("lines")).when(F.col("text") == "", 0).otherwise(feeds + 1).cast("long")
    n_dropped = F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    stay = F.transform(places, lambda i: F.get("lines", i))
    out = out.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.concat_ws("\n", stay)).alias("kept_text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), *["kept_text"] * with_text)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT doc_id, text FROM d),
l AS (SELECT doc_id, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x:
    array_to_string(list_filter(string_split(regexp_replace(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    '), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda t: t <> ''), ' ')))) AS line FROM u),
t AS (SELECT doc_id, text, line, string_split(line, ' ') AS tokens FROM l WHERE line <> ''),
r AS (SELECT *, len(tokens) AS n, tokens[1:3] AS lead, tokens[4:] AS rest, greatest(len(tokens) - 3, 0) AS m, greatest(least(greatest(len(tokens) - 3, 0) // 3, 3), 1) AS s FROM t),
k AS (SELECT *, unnest(range(s)) AS j FROM r),
f AS (SELECT doc_id, text, line, n, lead, rest, j, rest[(j * m) // s + 1:((j + 1) * m) // s] AS part FROM k),
leaves AS (SELECT n, lead, j, part FROM f GROUP BY n, lead, j, part HAVING count(DISTINCT (doc_id, text)) >= 5),
h AS (
    SELECT f.n, f.lead, f.j, f.part, f.line, f.rest, count(*) AS c FROM f JOIN leaves v ON v.n = f.n AND v.lead = f.lead AND v.j = f.j AND v.part IS NOT DISTINCT FROM f.part
    GROUP BY f.n, f.lead, f.j, f.part, f.line, f.rest),
e AS (SELECT row_number() OVER () AS entry, dense_rank() OVER (ORDER BY n, lead, j, part) AS leaf, * FROM h),
z AS (SELECT leaf, sum(c) AS lines FROM e GROUP BY leaf),
p AS (SELECT entry, leaf, c, unnest(rest) AS token, unnest(range(len(rest))) AS pos FROM e),
q AS (SELECT p.leaf, p.pos, p.token FROM p JOIN z USING (leaf) WHERE token <> '<*>' GROUP BY p.leaf, p.pos, p.token, z.lines HAVING sum(c) > 0.5::DOUBLE * z.lines),
w AS (
    SELECT p.entry, sum(CASE WHEN q.token IS NULL THEN 0 ELSE 1 END) AS fixed, string_agg(coalesce(q.token, '<*>'), ' ' ORDER BY p.pos) AS template
    FROM p LEFT JOIN q ON q.leaf = p.leaf AND q.pos = p.pos AND q.token = p.token GROUP BY p.entry),
a AS (SELECT e.leaf, e.line, e.c, coalesce(w.template, '') AS template FROM e LEFT JOIN w USING (entry) WHERE coalesce(w.fixed, 0) >= 0.6::DOUBLE * len(e.rest)),
g AS (SELECT leaf, template FROM a GROUP BY leaf, template HAVING sum(c) >= 5),
gone AS (SELECT DISTINCT line FROM a SEMI JOIN g USING (leaf, template)),
x AS (SELECT u.doc_id, u.text, list(t.line) AS dropped FROM u JOIN t ON t.doc_id IS NOT DISTINCT FROM u.doc_id AND t.text = u.text SEMI JOIN gone ON gone.line = t.line GROUP BY u.doc_id, u.text),
o AS (
    SELECT d.doc_id, CASE WHEN d.text = '' THEN [] ELSE string_split(d.text, chr(10)) END AS lines, coalesce(x.dropped, []) AS dropped
    FROM d LEFT JOIN x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text),
y AS (SELECT doc_id, lines, list_filter(lines, lambda i: NOT list_contains(dropped,
    array_to_string(list_filter(string_split(regexp_replace(translate(i, chr(9) || chr(11) || chr(12) || chr(13), '    '), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda t: t <> ''), ' '))) AS stay FROM o)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256 FROM y
"""
