"""Reads of one molecule become one sequence: clusters around seeds, all molecules a round together, then small clusters merge into the largest.

A round gives every molecule that has reads left one cluster: a seed, the reads within its radius, their consensus. All
of it is counting by molecule and position, so a molecule's reads never meet in one place; only pairs of consensus
sequences are aligned by a small kernel. Reads have the columns cell, umi, read (their order), seq and qual (offset 33).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.molecules import ParameterError
from cladeworks.operators.sequencing import align_global, consensus
from cladeworks.sources.scratch import written

KEYS = ["cell", "umi"]


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def quality(symbol: Column) -> Column:
    return F.ascii(symbol) - 33


def hq_mismatches_from_seed(seed: Column, seq: Column, qual: Column, min_q: int = 20) -> Column:
    """Positions where a read differs from the seed with a quality of at least ``min_q``; what one of them lacks at its end does not count."""
    at = F.arrays_zip(letters(seed).alias("s"), letters(seq).alias("r"), letters(qual).alias("q"))
    return F.size(F.filter(at, lambda x: x["s"].isNotNull() & x["r"].isNotNull() & (x["s"] != x["r"]) & (quality(x["q"]) >= min_q)))


def hq_hamming(a: Column, b: Column, qual_a: Column, qual_b: Column, min_q: int) -> Column:
    """Positions where two sequences differ and both qualities reach ``min_q``."""
    at = F.arrays_zip(letters(a).alias("a"), letters(b).alias("b"), letters(qual_a).alias("p"), letters(qual_b).alias("q"))
    return F.size(F.filter(at, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"]) & (quality(x["p"]) >= min_q) & (quality(x["q"]) >= min_q)))


def mismatch_quality(seed: Column, seq: Column, qual: Column) -> Column:
    """The summed quality of the positions where a read differs from the seed."""
    at = F.arrays_zip(letters(seed).alias("s"), letters(seq).alias("r"), letters(qual).alias("q"))
    wrong = F.filter(at, lambda x: x["s"].isNotNull() & x["r"].isNotNull() & (x["s"] != x["r"]))
    return F.aggregate(F.transform(wrong, lambda x: quality(x["q"])), F.lit(0), lambda a, q: a + q)


def propose_seeds(reads: DataFrame) -> DataFrame:
    """(cell, umi, seed): the commonest sequence if it stands twice, the first seen of equals; else the consensus of all reads."""
    counts = reads.groupBy(*KEYS, "seq").agg(F.count(F.lit(1)).alias("n"), F.min("read").alias("first"))
    modal = counts.groupBy(*KEYS).agg(F.min_by("seq", F.struct((-F.col("n")).alias("less"), "first")).alias("seed"), F.max("n").alias("n"))
    lone = reads.join(modal.where("n = 1").select(*KEYS), KEYS, "left_semi")
    return modal.where("n > 1").select(*KEYS, "seed").union(consensus(lone, KEYS).select(*KEYS, F.col("seq").alias("seed")))


def likely_seeds(reads: DataFrame) -> DataFrame:
    """(cell, umi, seed): at each position the base whose reads have the largest summed quality, the smaller letter of equals."""
    at = F.posexplode(F.arrays_zip(letters(F.col("seq")).alias("b"), letters(F.col("qual")).alias("q")))
    weight = reads.select(*KEYS, at.alias("pos", "x")).groupBy(*KEYS, "pos", F.col("x.b").alias("base")).agg(F.sum(quality(F.col("x.q"))).alias("w"))
    best = weight.groupBy(*KEYS, "pos").agg(F.min_by("base", F.struct(-F.col("w"), "base")).alias("base"))
    return best.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("e")).select(*KEYS, F.concat_ws("", F.transform("e", lambda x: x["base"])).alias("seed"))


def in_rounds(reads: DataFrame, seeds: Callable[[DataFrame], DataFrame], near: Callable[[DataFrame], Column]) -> DataFrame:
    """(cell, umi, cluster, read, seq, qual, n): clusters in the order in which they form; molecules whose seed is near none of their reads end with a cluster for each."""
    rest, out = written(reads.select(*KEYS, "read", "seq", "qual"), "reads"), None
    for at in count():
        if not rest.take(1):
            break
        sizes = rest.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("left"))
        told = rest.join(sizes, KEYS).join(seeds(rest), KEYS, "left")
        told = written(told.withColumn("near", (F.col("left") > 1) & F.coalesce(near(told), F.lit(False))), "near-seeds")
        grown = told.where("near").select(*KEYS).distinct()
        alone = told.join(grown, KEYS, "left_anti")
        made = consensus(told.where("near"), KEYS).select(*KEYS, F.lit(at).alias("cluster"), F.lit(None).cast(reads.schema["read"].dataType).alias("read"), "seq", "qual", "n")
        single = alone.select(*KEYS, F.lit(at).alias("cluster"), "read", "seq", "qual", F.lit(1).cast("long").alias("n"))
        now = written(made.union(single), "clusters")
        out = now if out is None else out.union(now)
        rest = written(told.where(~F.col("near")).join(grown, KEYS, "left_semi").select(*KEYS, "read", "seq", "qual"), "reads")
    return out if out is not None else reads.select(*KEYS, F.lit(0).alias("cluster"), "read", "seq", "qual", F.lit(1).cast("long").alias("n")).limit(0)


def form_clusters(reads: DataFrame, max_mismatches: int = 3) -> DataFrame:
    """Clusters by cutoff: reads within ``max_mismatches`` of the seed, low-quality differences not counted."""
    return in_rounds(reads, propose_seeds, lambda t: hq_mismatches_from_seed(t["seed"], t["seq"], t["qual"]) <= max_mismatches)


def form_clusters_likelihood(reads: DataFrame, proportion: float = 0.05, q_threshold: float | None = None) -> DataFrame:
    """Clusters by likelihood: the summed quality of a read's differences is at most ``q_threshold`` times ``proportion`` of the molecule's longest read.

    Unless given, the threshold is the median quality of the molecule's bases.
    """
    bases = reads.select(*KEYS, F.length("seq").alias("size"), F.explode(F.transform(letters(F.col("qual")), quality)).alias("q"))
    limit = written(bases.groupBy(*KEYS).agg(F.max("size").alias("longest"), F.percentile("q", 0.5).alias("median")).select(*KEYS, (F.lit(float(proportion)) * F.col("longest") * (F.col("median") if q_threshold is None else F.lit(float(q_threshold)))).alias("limit")), "limits")

    def seeds(rest: DataFrame) -> DataFrame:
        return likely_seeds(rest).join(limit, KEYS)

    return in_rounds(reads, seeds, lambda t: mismatch_quality(t["seed"], t["seq"], t["qual"]) <= t["limit"])


def align_clusters(pairs: DataFrame) -> DataFrame:
    """Add ``indels`` and ``mismatches`` of the columns seq, qual and seq2, qual2: gaps of their global alignment, and differing bases whose qualities both exceed 20."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for a, b, p, q in zip(pdf["seq"], pdf["seq2"], pdf["qual"], pdf["qual2"]):
                cigar, i, j, _ = align_global(b, a, free=False)
                gaps = wrong = 0
                size = ""
                for c in cigar:
                    if c.isdigit():
                        size += c
                        continue
                    k, size = int(size), ""
                    if c == "M":
                        wrong += sum(a[i + x] != b[j + x] and ord(p[i + x]) > 53 and ord(q[j + x]) > 53 for x in range(k))
                    gaps += c != "M"
                    i, j = i + k * (c != "D"), j + k * (c != "I")
                found.append((gaps, wrong))
            yield pdf.assign(indels=[f[0] for f in found], mismatches=[f[1] for f in found])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, indels long, mismatches long")


def merge_clusters(clusters: DataFrame, max_mismatches: int = 3, max_indels: int = 2) -> DataFrame:
    """(cell, umi, id, seq, qual, n): clusters numbered by size; smaller ones that align to a molecule's largest are added to it.

    The largest keeps its sequence, and ``+`` is put behind its number. Clusters of its size stay apart.
    """
    ranked = written(clusters.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "cluster", "read", "seq", "qual"))).alias("c")).select(*KEYS, F.posexplode("c").alias("id", "x")).select(*KEYS, "id", "x.seq", "x.qual", (-F.col("x.less")).alias("n")), "ranked-clusters")
    top = ranked.where("id = 0")
    pairs = top.select(*KEYS, "seq", "qual", F.col("n").alias("most")).join(ranked.where("id > 0").select(*KEYS, "id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"), "n"), KEYS).where("n < most")
    joined = written(align_clusters(pairs).where((F.col("indels") <= max_indels) & (F.col("mismatches") <= max_mismatches)).select(*KEYS, "id", "n"), "merged-clusters")
    more = joined.groupBy(*KEYS).agg(F.sum("n").alias("more"))
    out = ranked.join(joined.select(*KEYS, "id"), [*KEYS, "id"], "left_anti").join(more, KEYS, "left")
    grown = (F.col("id") == 0) & F.col("more").isNotNull()
    return out.select(*KEYS, F.concat(F.col("id").cast("string"), F.when(grown, "+").otherwise("")).alias("id"), "seq", "qual", (F.col("n") + F.when(grown, F.col("more")).otherwise(0)).alias("n"))


def collapse_umis(reads: DataFrame, max_mismatches: int = 3, max_indels: int = 2, method: str = "cutoff", many: int = 10_000) -> DataFrame:
    """(cell, umi, id, seq, qual, n): the molecules of a table of reads. With ``likelihood``, molecules of over ``many`` reads use the cutoff.

    Reads without cell, umi or sequence take no part; an empty table gives an empty result.
    """
    rows = reads.where("cell IS NOT NULL AND umi IS NOT NULL AND seq <> '' AND length(seq) = length(qual)")
    if method == "cutoff":
        return merge_clusters(form_clusters(rows, max_mismatches), max_mismatches, max_indels)
    if method != "likelihood":
        raise ParameterError(f"unknown method {method}")
    longest = rows.agg(F.max(F.length("seq"))).first()[0] or 1
    large = written(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > many).select(*KEYS), "large-molecules")
    likely = form_clusters_likelihood(rows.join(large, KEYS, "left_anti"), max_mismatches / longest)
    return merge_clusters(likely.union(form_clusters(rows.join(large, KEYS, "left_semi"), max_mismatches)), max_mismatches, max_indels)
