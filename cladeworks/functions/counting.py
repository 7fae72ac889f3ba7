"""Combinatorics in doubles, as products of ratios that do not overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial(n: Column, k: Column) -> Column:
    """n over k; 0 outside 0 <= k <= n."""
    m = F.least(k, n - k)
    product = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")), F.lit(1.0), lambda p, i: p * (n - m + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(m == 0, 1.0).otherwise(product)


def coalescent_clade_probability(n: Column, b: Column, k: Column) -> Column:
    """The chance that one of ``k`` lineages with ``n`` leaves in all has ``b``: C(n - b - 1, k - 2) / C(n - 1, k - 1)."""
    return binomial(n - b - 1, k - 2) / binomial(n - 1, k - 1)
