"""Molecule tables that grow: the stateless operators run on streams as they are; counting keeps state behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_molecules(stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, cell, n_umi, n_reads): molecules and reads of each cell in tumbling windows; rows later than ``late`` are dropped, and a window's state goes when the watermark passes it."""
    counted = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cell").agg(F.count(F.lit(1)).alias("n_umi"), F.sum("reads").alias("n_reads"))
    return counted.select(F.col("w.start").alias("start"), "cell", "n_umi", "n_reads")


def first_reads(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """A (cell, umi) that comes again within the watermark is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["cell", "umi"])


def corrected(stream: DataFrame, corrections: DataFrame) -> DataFrame:
    """Barcodes replaced by a fixed table (intbc, entry), such as a batch run of the whitelist correction gives; others are dropped. No state is kept."""
    return stream.join(corrections.select("intbc", "entry"), "intbc").withColumn("intbc", F.col("entry")).drop("entry")
