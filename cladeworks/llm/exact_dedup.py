"""Exact duplicates: rows are grouped by a 128-bit content hash, and the bytes of the texts settle what the hash left open.

The whole path is DataFrame functions. One exchange carries each distinct text of a map task once, because
``groupBy(hash, text)`` combines on the map side: a group that holds a third of all rows arrives as one row a task. The
texts are grouping keys, so that Spark compares them byte by byte and two texts with one hash stay two groups. The
verdicts go back to the rows by a join on hash and SHA-256, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import ascii_lower


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` (the smallest stable id) or ``max``. Texts are equal when identical after lower-casing A-Z.
    Null text counts as empty and empty texts form a group like any other. A null id never wins over another id; a
    group of null ids only has keep_id null, and its rows count as kept. Rows that repeat an id with an equal text are
    one document: they count in group_size and share the verdict. An empty table gives an empty result. Texts of any
    length are compared whole. Other columns are not read, so their names cannot clash.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    keyed = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("hash", content_hash(F.col("norm")))
    groups = keyed.groupBy("hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    rows = keyed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return rows.join(groups, ["hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row stays if its id is the one that its text keeps. Rows that share an id but not a text are judged each by
    their own text, so none is lost; of rows that repeat an id with an equal text, one stays. Rows without an id stay.
    """
    kept = exact_duplicates(docs, id_col, text_col, keep).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_text")).distinct()
    keyed = docs.withColumn("__text", F.sha2(ascii_lower(F.col(text_col)), 256))
    named = keyed.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__text"])
    stay = named.join(kept, (F.col(id_col) == F.col("__kept_id")) & (F.col("__text") == F.col("__kept_text")), "left_semi").drop("__text")
    return stay.unionByName(docs.where(F.col(id_col).isNull()))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
