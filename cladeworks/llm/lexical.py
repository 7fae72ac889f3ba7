"""Ranked lexical search that scores each bag of item terms once.

Of a document only the terms of the items and its length matter for its score. So documents shrink to the counts of the
item vocabulary (a bag) and a length class ``m``; bags meet by their hash, and the bags themselves are grouping keys, so
that Spark compares them and no two different bags become one class. A class is scored once for all items, and its
members follow by ascending id: no more than ``k`` of a class can be among the first ``k``, so window limits keep ``k``
ids a class in every task before anything is exchanged, however large the class.

Items come in blocks of bounded vocabulary, each a whole search of its own over all documents. Only a block's terms,
their document counts and postings are sent to the tasks; nothing of the documents comes to the driver but two totals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.shared import Tables

#: Bytes to a term's bytes: A-Z lower-cased; what separates terms (ASCII but letters and digits) becomes a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE = 1 << 20
#: A block of items has at most so many different terms, or is one item.
BLOCK_TERMS = 1 << 17


def count_terms(text: bytes | None) -> Counter:
    """How often each term stands in a whole text, cut between terms into pieces so that a long text is never one list."""
    counts: Counter = Counter()
    if text:
        text, at = text.translate(TABLE), 0
        while at < len(text):
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            counts.update(text[at:end].split())
            at = end
    return counts


@dataclass
class Block:
    """Items with their terms: numbers of the vocabulary, and (term numbers, repeats) an item."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[list[tuple[int, int]]]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in the order of their ids, read one block at a time; rows without a term are left out, for they find nothing.

    Rows that repeat an id are items of their own and give ranks of their own.
    """
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    block = Block([], {}, [])
    for row in rows.toLocalIterator():
        counts = count_terms(bytes(row.t))
        if not counts:
            continue
        if block.ids and len(block.vocabulary) + len(counts) > most:
            yield block
            block = Block([], {}, [])
        block.ids.append(row.i)
        block.terms.append([(block.vocabulary.setdefault(term, len(block.vocabulary)), n) for term, n in sorted(counts.items())])
    if block.ids:
        yield block


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) for each row: its number of terms, and numbers and counts of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS terms, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                counts = count_terms(text.as_py())
                n.append(counts.total())
                found = sorted((number[t], c) for t, c in counts.items() if t in number)
                terms.append([t for t, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def weight(total: int, df: int) -> int:
    return floor(1000 * log((2 * total + 2) / (2 * df + 1)))


def best(classes: DataFrame, block: Block, weights: list[int], k: int, id_type: str) -> DataFrame:
    """(item, score, doc_id): each task's ``k`` best documents an item, from classes of (terms, tfs, m, ids)."""
    postings: dict[int, tuple[list[int], list[int]]] = {}
    for item, terms in enumerate(block.terms):
        for term, n in terms:
            postings.setdefault(term, ([], []))[0].append(item)
            postings[term][1].append(n * weights[term])
    shared = classes.sparkSession.sparkContext.broadcast({t: (np.array(i), np.array(w, np.int64)) for t, (i, w) in postings.items()})
    n_items = len(block.ids)
    rows_at_once = max(1, min(2048, (1 << 22) // n_items))

    def order(entry: tuple) -> tuple:
        return -entry[0], entry[1] is None, entry[1] if entry[1] is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, first = shared.value, [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                terms, m = batch.column("terms"), batch.column("m").to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
                terms, tf = terms.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
                part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
                by_term = np.argsort(terms, kind="stable")
                scores = np.zeros((batch.num_rows, n_items), np.int64)
                for own in np.split(by_term, np.flatnonzero(np.diff(terms[by_term])) + 1) if len(terms) else []:
                    items, w = post[int(terms[own[0]])]
                    scores[owner[own][:, None], items[None, :]] += part[own][:, None] * w[None, :]
                ids = batch.column("ids")
                for item in np.flatnonzero((scores >= least).any(axis=0)):
                    column = scores[:, item]
                    level = max(int(least[item]), int(np.partition(column, -k)[-k]) if len(column) > k else 1)
                    found = first[item] + [(int(column[c]), i) for c in np.flatnonzero(column >= level) for i in ids[int(c)].as_py()]
                    first[item] = sorted(found, key=order)[:k]
                    if len(first[item]) == k:
                        least[item] = first[item][-1][0]
        out = [(item, s, i) for item, entries in enumerate(first) for s, i in entries]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], classes_type)], ["item", "score", "doc_id"])

    classes_type = pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else pa.int32()
    return classes.select("terms", "tfs", "m", "ids").mapInArrow(run, f"item int, score long, doc_id {id_type}")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, or all if fewer.

    Equal scores rank by ascending doc_id, a null id last. Null and empty texts hold no term; they find nothing and are not found.
    Repeated rows are documents of their own, in ranks and in all counts. Texts of any length are read whole. Without
    documents or items the result is empty. Other columns are not read, so their names cannot clash. Ids are numbers or strings.
    """
    spark: SparkSession = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    found = []
    for block in blocks(items, item_col, item_text_col, block_terms):
        tables = Tables(spark)
        rows = tables.written(bags(docs, block.vocabulary, id_col, text_col), "bags")
        total, words = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not total:
            tables.clear()
            continue
        df = {r.term: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # one row a term of the block
        weights = [weight(total, df.get(t, 0)) for t in range(len(block.vocabulary))]
        keyed = rows.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", F.expr(f"75 + (25 * n * {total}L) div {words}L").alias("m"))
        keyed = keyed.withColumn("hash", F.xxhash64("terms", "tfs", "m"))
        same = ["hash", "terms", "tfs", "m"]
        members = keyed.withColumn("at", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id")))).where(F.col("at") <= k)
        classes = members.groupBy(*same).agg(F.collect_list("doc_id").alias("listed"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        ids = F.concat(F.array_sort("listed"), F.when(F.col("nulls") > 0, F.array_repeat(F.lit(None).cast(id_type), F.col("nulls").cast("int"))).otherwise(F.array().cast(f"array<{id_type}>")))
        scored = best(classes.withColumn("ids", ids), block, weights, k, id_type)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_type}")
        found.append(Tables(spark).written(names.join(ranked, "item").select("item_id", "rank", "doc_id", "score"), "ranks"))  # k rows an item
        tables.clear()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
it AS (SELECT item_id, t, count(*) AS reps FROM (SELECT item_id, unnest(ts) AS t FROM i) GROUP BY item_id, t),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT it.item_id, tf.doc_id, sum(it.reps * floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df.df + 1)))::BIGINT * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
      FROM it JOIN tf USING (t) JOIN df USING (t), total GROUP BY it.item_id, tf.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
