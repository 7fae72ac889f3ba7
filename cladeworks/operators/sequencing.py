"""From reads to alleles: consensus sequences, alignments to a reference, and indels called at cut sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(reads: DataFrame, keys: list[str], high: int = 30) -> DataFrame:
    """(keys, seq, qual, n): per position the base with most high-quality reads, then most reads, then the best mean quality; a full tie is N.

    Quality is 31 where the base has a majority and a high-quality read, else 10, and 2 for N (offset 33). A position's
    bases are counted before they meet, so a group of many reads arrives as a few rows.
    """
    at = F.posexplode(F.arrays_zip(F.split("seq", "").alias("b"), F.split("qual", "").alias("q")))
    bases = reads.select(*keys, at.alias("pos", "x")).where("x.b IS NOT NULL AND x.b <> ''").select(*keys, "pos", F.col("x.b").alias("base"), (F.ascii("x.q") - 33).alias("q"))
    votes = bases.groupBy(*keys, "pos", "base").agg(F.count_if(F.col("q") >= high).alias("hq"), F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"))
    ranked = votes.groupBy(*keys, "pos").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("hq", "n", "mean", "base")), asc=False).alias("r"))
    best, second = F.col("r")[0], F.get(F.col("r"), F.lit(1))
    tie = second.isNotNull() & (best["hq"] == second["hq"]) & (best["n"] == second["n"]) & (best["mean"] == second["mean"])
    quality = F.when(tie, 2).when((best["n"] * 2 > F.col("all")) & (best["hq"] > 0), 31).otherwise(10)
    each = ranked.select(*keys, F.struct("pos", F.when(tie, "N").otherwise(best["base"]).alias("b"), F.char(quality + 33).alias("q")).alias("e"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e"))
    sizes = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return whole.join(sizes, keys).select(*keys, F.concat_ws("", F.transform("e", lambda x: x["b"])).alias("seq"), F.concat_ws("", F.transform("e", lambda x: x["q"])).alias("qual"), "n")


def align_local(ref: str, seq: str, match: int = 5, mismatch: int = -4, gap_open: int = 20, gap_extend: int = 1) -> tuple[str, int, int, int]:
    """(cigar, query start, reference start, score) of the best local alignment with affine gaps; N scores 0. Of equal ends the first in the query, then in the reference, wins."""
    a, b = np.frombuffer(seq.encode(), np.uint8), np.frombuffer(ref.encode(), np.uint8)
    n, m, low = len(a), len(b), -(10**9)
    best = np.zeros((n + 1, m + 1), np.int64)
    ins = np.full((n + 1, m + 1), low, np.int64)
    gone = np.full((n + 1, m + 1), low, np.int64)
    steps = np.arange(m + 1) * gap_extend
    for i in range(1, n + 1):
        score = np.where((b == a[i - 1]), match, mismatch)
        score[(b == ord("N")) | (a[i - 1] == ord("N"))] = 0
        ins[i] = np.maximum(best[i - 1] - gap_open, ins[i - 1] - gap_extend)
        here = np.maximum(0, np.maximum(ins[i], np.concatenate(([0], best[i - 1, :-1] + score))))
        # a deletion ending at j opens somewhere before: a running maximum of what it opened from
        gone[i, 1:] = np.maximum.accumulate(here + steps)[:-1] - steps[1:] - gap_open + gap_extend
        best[i] = np.maximum(here, gone[i])
    i, j = divmod(int(best.argmax()), m + 1)
    top, ops, state = int(best[i, j]), [], "M"
    while i > 0 and (state != "M" or best[i, j] > 0):
        if state == "M":
            score = 0 if ord("N") in (a[i - 1], b[j - 1]) else match if a[i - 1] == b[j - 1] else mismatch
            if best[i, j] == best[i - 1, j - 1] + score:
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "I" if best[i, j] == ins[i, j] else "D"
        elif state == "I":
            ops.append("I")
            state = "M" if ins[i, j] == best[i - 1, j] - gap_open else "I"
            i -= 1
        else:
            ops.append("D")
            # the deletion closes where its opening cell explains the score that is left
            state = "M" if gone[i, j] == best[i, j - 1] - gap_open else "D"
            j -= 1
    runs: list[list[object]] = []
    for op in reversed(ops):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return "".join(f"{k}{op}" for k, op in runs), i, j, top


def align_global(ref: str, seq: str, match: int = 5, mismatch: int = -4, gap_open: int = 20, gap_extend: int = 1, free: bool = True) -> tuple[str, int, int, int]:
    """(cigar, query start, reference start, score) of the best alignment of whole sequences; with ``free`` from an end of one to an end of one, gaps at the ends costing nothing.

    Where several reach the score, matches are preferred to insertions and those to deletions, from the last column back.
    """
    a, b, low = seq.encode(), ref.encode(), float("-inf")
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1))
    ins, gone = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    if not free:
        ins[1:, 0] = best[1:, 0] = -(gap_open + gap_extend * np.arange(n))
        gone[0, 1:] = best[0, 1:] = -(gap_open + gap_extend * np.arange(m))
    letters = np.frombuffer(b, np.uint8)
    for i in range(1, n + 1):
        score = np.where(letters == a[i - 1], match, mismatch).astype(float)
        score[(letters == ord("N")) | (a[i - 1] == ord("N"))] = 0
        ins[i, 1:] = np.maximum(best[i - 1, 1:] - gap_open, ins[i - 1, 1:] - gap_extend)
        for j in range(1, m + 1):
            gone[i, j] = max(best[i, j - 1] - gap_open, gone[i, j - 1] - gap_extend)
            best[i, j] = max(best[i - 1, j - 1] + score[j - 1], ins[i, j], gone[i, j])
    ends = [(best[n, j], j, n) for j in range(m + 1)] + [(best[i, m], m, i) for i in range(n + 1)]
    top, j, i = max(ends) if free else (best[n, m], m, n)
    ops: list[str] = []
    while i > 0 and j > 0:
        score = 0 if ord("N") in (a[i - 1], b[j - 1]) else match if a[i - 1] == b[j - 1] else mismatch
        if best[i, j] == best[i - 1, j - 1] + score:
            ops.append("M")
            i, j = i - 1, j - 1
        elif best[i, j] == ins[i, j]:
            while i > 1 and ins[i, j] != best[i - 1, j] - gap_open:
                ops.append("I")
                i -= 1
            ops.append("I")
            i -= 1
        else:
            while j > 1 and gone[i, j] != best[i, j - 1] - gap_open:
                ops.append("D")
                j -= 1
            ops.append("D")
            j -= 1
    if not free:
        ops += ["I"] * i + ["D"] * j
        i = j = 0
    runs: list[list[object]] = []
    for op in reversed(ops):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return "".join(f"{k}{op}" for k, op in runs), i, j, int(top)


def align(molecules: DataFrame, ref: str, gap_open: int = 20, gap_extend: int = 1, method: str = "local") -> DataFrame:
    """Add cigar, query_begin, ref_begin and score, by ``local`` or ``global`` alignment; each distinct ``seq`` is aligned once, in any task."""
    one = {"local": align_local, "global": align_global}[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(ref, s, gap_open=gap_open, gap_extend=gap_extend) for s in pdf["seq"]]
            yield pd.DataFrame([(s, *f) for s, f in zip(pdf["seq"], found)], columns=["seq", "cigar", "query_begin", "ref_begin", "score"])

    once = molecules.select("seq").where("seq IS NOT NULL AND seq <> ''").distinct().mapInPandas(run, "seq string, cigar string, query_begin int, ref_begin int, score long")
    return molecules.join(once, "seq", "left")


def steps(cigar: str = "cigar", query: str = "query_begin", ref: str = "ref_begin") -> Column:
    """The operations of a CIGAR string with where they begin: structs (op, len, r, q), from 0."""
    parts = F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+[MIDH])"), F.lit(1))
    one = F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.expr("0").alias("z"), F.regexp_extract(p, r"\d+", 0).cast("int").alias("len")))
    empty = F.array().cast("array<struct<op:string,len:int,r:int,q:int>>")
    start = F.struct(empty.alias("out"), F.col(ref).cast("int").alias("r"), F.col(query).cast("int").alias("q"))
    move = lambda s, p: F.struct(F.concat(s["out"], F.array(F.struct(p["op"].alias("op"), p["len"].alias("len"), s["r"].alias("r"), s["q"].alias("q")))).alias("out"), (s["r"] + F.when(p["op"].isin("M", "D"), p["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(p["op"].isin("M", "I", "H"), p["len"]).otherwise(0)).alias("q"))
    return F.aggregate(one, start, move, lambda s: s["out"])


def call_alleles(alignments: DataFrame, barcode: tuple[int, int] = (20, 34), sites: tuple[int, ...] = (112, 166, 220), width: int = 12, context: int = 5) -> DataFrame:
    """Add intbc, r1.. and allele from cigar, query_begin, ref_begin and seq.

    A site's text names the insertions and deletions that touch it within ``width`` as ``position:lengthI`` or D in
    brackets, with ``context`` read bases on both sides; a site that the read covers without any is None; one that it does not reach is empty.
    The barcode is what the read has between the places that align to the interval's ends. All are expressions over the
    operations, evaluated in the JVM.
    """
    out = alignments.withColumn("steps", steps())
    place = lambda at: F.get(F.transform(F.filter("steps", lambda s: (s["op"] == "M") & (s["r"] <= at) & (s["r"] + s["len"] >= at)), lambda s: s["q"] + at - s["r"]), F.lit(0))
    low, high = place(F.lit(barcode[0])), place(F.lit(barcode[1]))
    out = out.withColumn("intbc", F.when(low.isNotNull() & high.isNotNull(), F.substring("seq", low + 1, high - low)))
    around = lambda q, size: (F.substring("seq", F.greatest(q - context, F.lit(0)) + 1, F.least(q, F.lit(context))), F.substring("seq", q + size + 1, F.lit(context)))

    def text(s: Column) -> Column:
        before, after = around(s["q"], F.when(s["op"] == "I", s["len"]).otherwise(0))
        mark = F.concat((s["r"] + 1).cast("string"), F.lit(":"), s["len"].cast("string"), s["op"])
        return F.concat(before, F.lit("["), mark, F.lit("]"), after) if context else mark

    def near(site: int) -> Column:
        return F.filter("steps", lambda s: s["op"].isin("I", "D") & (s["r"] <= site + width) & (s["r"] + F.when(s["op"] == "D", s["len"]).otherwise(0) >= site - width))

    names = []
    for k, site in enumerate(sites, 1):
        touched = near(site)
        q = place(F.lit(site))
        before, after = around(q, F.lit(0))
        uncut = F.concat(before, F.lit("[None]"), after) if context else F.lit("None")
        out = out.withColumn(f"r{k}", F.when(F.size(touched) > 0, F.concat_ws("", F.transform(touched, text))).when(q.isNotNull(), uncut).otherwise(F.lit("")))
        names.append(f"r{k}")
    return out.withColumn("allele", F.concat(*names)).drop("steps")
