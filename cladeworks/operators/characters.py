"""Characters and states: indel priors, state numbers, character matrices in long form, profiles, bootstraps and their statistics.

A character is a barcode and a cut site. The long form has a row for each (cell, character) with ``states``, a sorted
array: one state as a rule, several where a cell's alleles conflict. Missing entries are absent from the long form or hold
the missing state, 0 is the uncut state.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.molecules import ParameterError

MISSING = -1


def melt(alleles: DataFrame, sites: list[str]) -> DataFrame:
    """(cell, character, indel) of every cut site; the character is barcode and site."""
    cells = F.explode(F.array(*[F.struct(F.concat("intbc", F.lit(s)).alias("character"), F.col(s).cast("string").alias("indel")) for s in sites]))
    return alleles.where("cell IS NOT NULL AND intbc IS NOT NULL").select("cell", cells.alias("x")).select("cell", "x.character", "x.indel")


def uncut(indel: Column) -> Column:
    return F.contains(F.upper(indel), F.lit("NONE"))


def indel_priors(alleles: DataFrame, sites: list[str], group: list[str]) -> DataFrame:
    """(indel, n, freq): the groups that hold an indel, and their share of all groups. Uncut sites do not count; nulls are no indel."""
    total = alleles.select(*group).distinct().count()
    each = alleles.select(*group, F.explode(F.array(*[F.col(s).cast("string") for s in sites])).alias("indel")).where(F.col("indel").isNotNull() & ~uncut(F.col("indel")))
    return each.distinct().groupBy("indel").agg(F.count(F.lit(1)).alias("n")).withColumn("freq", F.col("n") / F.lit(max(1, total)))


def prior_weights(priors: DataFrame, transformation: str = "negative_log", column: str = "freq") -> DataFrame:
    """Add ``weight``: -ln p, 1 / p or the root of 1 / p. Priors must lie in (0, 1]."""
    forms = {"negative_log": -F.log(column), "inverse": 1 / F.col(column), "square_root_inverse": F.sqrt(1 / F.col(column))}
    if transformation not in forms:
        raise ParameterError(f"unknown transformation {transformation}")
    if priors.where(~((F.col(column) > 0) & (F.col(column) <= 1)) | F.col(column).isNull()).take(1):
        raise ParameterError("priors must lie in (0, 1]")
    return priors.withColumn("weight", forms[transformation])


def character_table(alleles: DataFrame, sites: list[str], rep_thresh: float = 1.0, ignore: list[str] | None = None) -> DataFrame:
    """(cell, character, indels): the distinct indels of a cell at a character, sorted.

    A character goes if one of its indels makes up more than ``rep_thresh`` of its (cell, indel) pairs.
    """
    rows = melt(alleles.where(~F.col("intbc").isin(ignore)) if ignore else alleles, sites).where("indel IS NOT NULL").distinct()
    if rep_thresh < 1:
        share = rows.groupBy("character", "indel").agg(F.count(F.lit(1)).alias("n")).groupBy("character").agg((F.max("n") / F.sum("n")).alias("most"))
        rows = rows.join(share.where(F.col("most") <= rep_thresh).select("character"), "character", "left_semi")
    return rows.groupBy("cell", "character").agg(F.array_sort(F.collect_set("indel")).alias("indels"))


def state_numbers(table: DataFrame) -> DataFrame:
    """(character, indel, state): 0 for uncut indels; the others are numbered from 1 in the order of the first cell that shows them, then by name."""
    seen = table.select("cell", "character", F.explode("indels").alias("indel")).groupBy("character", "indel").agg(F.min("cell").alias("first"))
    # numbering needs one character's distinct indels together: they are few, and counted over all cells before
    order = Window.partitionBy("character").orderBy("first", "indel")
    cut = seen.where(~uncut(F.col("indel"))).select("character", "indel", F.row_number().over(order).alias("state"))
    return cut.union(seen.where(uncut(F.col("indel"))).select("character", "indel", F.lit(0).alias("state")))


def character_matrix(alleles: DataFrame, sites: list[str], rep_thresh: float = 1.0, ignore: list[str] | None = None) -> DataFrame:
    """The long form (cell, character, states)."""
    table = character_table(alleles, sites, rep_thresh, ignore)
    states = table.select("cell", "character", F.explode("indels").alias("indel")).join(state_numbers(table), ["character", "indel"])
    return states.groupBy("cell", "character").agg(F.array_sort(F.collect_set("state")).alias("states"))


def wide(matrix: DataFrame, characters: list[str], missing: int = MISSING) -> DataFrame:
    """(cell, states): an array over ``characters``; conflicting entries take their smallest state, absent ones ``missing``."""
    held = matrix.select("cell", F.struct("character", F.array_min("states").alias("state")).alias("e")).groupBy("cell").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return held.select("cell", F.transform(F.array(*[F.lit(c) for c in characters]), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(missing))).alias("states"))


def lineage_profile(alleles: DataFrame, sites: list[str], keys: list[str]) -> DataFrame:
    """Cells by characters, indels as sorted text, several joined by '|'. ``keys`` fixes columns and their order."""
    return character_table(alleles, sites).groupBy("cell").pivot("character", keys).agg(F.first(F.concat_ws("|", "indels")))


def to_alleles(matrix: DataFrame, keep_ambiguous: bool = False) -> DataFrame:
    """(cell, intbc, r1, umi): back from the long form; of conflicting states the first, or all."""
    states = F.explode("states") if keep_ambiguous else F.explode(F.slice("states", 1, 1))
    return matrix.select("cell", F.concat(F.lit("intbc-"), "character").alias("intbc"), states.alias("r1"), F.lit(1).alias("umi")).where(F.col("r1") != MISSING)


def mutation_frequencies(matrix: DataFrame) -> DataFrame:
    """(character, state, n): cells with each state, conflicting states counted each."""
    return matrix.select("character", F.explode("states").alias("state")).groupBy("character", "state").agg(F.count(F.lit(1)).alias("n"))


def array_frequencies(cells: DataFrame) -> DataFrame:
    """The same of the array form (cell, states): (character, state, n), characters numbered from 0."""
    return cells.select(F.posexplode("states").alias("character", "state")).groupBy("character", "state").agg(F.count(F.lit(1)).alias("n"))


def proportions(cells: DataFrame, missing: int = MISSING) -> DataFrame:
    """One row: the share of missing entries, and of mutated ones among those present."""
    x = cells.select(F.explode("states").alias("s"))
    n, gone, zero = F.count(F.lit(1)), F.count_if(F.col("s") == missing), F.count_if(F.col("s") == 0)
    return x.agg((gone / n).alias("missing"), F.try_divide(n - gone - zero, n - gone).alias("mutated"))


def duplicate_groups(cells: DataFrame) -> DataFrame:
    """(first, members, n): cells with equal state arrays, where there are several."""
    return cells.groupBy("states").agg(F.min("cell").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "n")


def bootstrap(cells: DataFrame, characters: int, samples: int = 10, seed: int = 1) -> DataFrame:
    """(sample, cell, states): characters drawn with replacement; a draw is a hash of (seed, sample, position), so reruns agree."""
    drawn = lambda b: F.transform(F.sequence(F.lit(0), F.lit(characters - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), b, i), F.lit(characters)).cast("int"))
    each = cells.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("drawn", drawn(F.col("sample")))
    return each.select("sample", "cell", F.transform("drawn", lambda i: F.get("states", i)).alias("states"))


def mutation_rate(mutated: Column, depth: Column, continuous: bool = True) -> Column:
    """Rate a unit of time, or probability a generation, at which a site mutates, from the share of mutated entries at ``depth``."""
    return F.when(F.lit(continuous), -F.log(1 - mutated) / depth).otherwise(1 - F.pow(1 - mutated, 1 / depth))


def most_abundant(states: Column) -> Column:
    """The state that stands most often in an array, the smallest of equals."""
    ranked = F.transform(F.array_distinct(states), lambda s: F.struct((-F.size(F.filter(states, lambda x: x == s))).alias("less"), s.alias("s")))
    return F.array_min(ranked)["s"]


def collapse_ambiguous(matrix: DataFrame) -> DataFrame:
    """The long form with each state of an entry once."""
    return matrix.withColumn("states", F.array_sort(F.array_distinct("states")))


def resolve_ambiguous(matrix: DataFrame, resolve: Callable[[Column], Column] = most_abundant) -> DataFrame:
    """(cell, character, state): one state an entry, chosen by ``resolve``, an expression over the array."""
    return matrix.select("cell", "character", resolve(F.col("states")).alias("state"))


def ambiguous_cells(matrix: DataFrame) -> DataFrame:
    """(cell, ambiguous): whether an entry of the cell holds several states."""
    return matrix.groupBy("cell").agg(F.max(F.size("states") > 1).alias("ambiguous"))


def unravel(matrix: DataFrame) -> DataFrame:
    """(cell, character, state): a row for each state of an entry, repeats included."""
    return matrix.select("cell", "character", F.explode("states").alias("state"))


def default_cut_sites(alleles: DataFrame) -> list[str]:
    """The columns whose name holds an r and a digit."""
    return [c for c in alleles.columns if re.search(r"r\d", c)]


def with_site_codes(alleles: DataFrame, sites: list[str]) -> DataFrame:
    """Add s1, s2 ... for plots: 0.9 for an uncut site, 1.9 for a deletion, 2.9 for an insertion, else 0."""
    code = lambda c: F.when(F.upper(c).contains("NONE"), 0.9).when(c.contains("D"), 1.9).when(c.contains("I"), 2.9).otherwise(0.0)
    return alleles.withColumns({site.replace("r", "s", 1): F.coalesce(code(F.col(site)), F.lit(0.0)) for site in sites})
