"""Expressions for layouts and annotation tables: angles, colours, strips and dataset lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours that stand for no cut, no call and a missing entry. Fixed values.
FIXED = {"none": "#d3d3d3", "nc": "#ffffff", "missing": "#ffffff"}


def polar_to_cartesian(degrees: Column, r: Column) -> tuple[Column, Column]:
    """x and y of an angle in degrees and a radius."""
    return r * F.cos(F.radians(degrees)), r * F.sin(F.radians(degrees))


def hex_to_rgb(value: Column) -> Column:
    """Red, green and blue of '#rrggbb' as an array of integers; null for other text."""
    part = lambda i: F.conv(F.substring(value, i, 2), 16, 10).cast("int")
    return F.when(value.rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def hsv_to_hex(h: Column, s: Column, v: Column) -> Column:
    """Colour of hue, saturation and value, each in [0, 1]."""
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(n) + h * 6, F.lit(6.0))
        return F.round(255 * (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return rgb_to_hex(channel(5), channel(3), channel(1))


def indel_colors(indels: DataFrame, seed: int = 1) -> DataFrame:
    """(indel, color): a hue by hash, saturation by the rank of the prior ``freq`` against the largest; fixed colours for uncut, uncalled and missing."""
    most = indels.agg(F.max("freq")).first()[0] or 1.0
    hue = F.pmod(F.xxhash64(F.lit(seed), "indel"), F.lit(3600)) / 3600
    drawn = hsv_to_hex(hue, F.lit(1.0) - 0.7 * F.coalesce(F.col("freq") / F.lit(most), F.lit(0.0)), F.lit(0.9))
    low = F.lower("indel")
    fixed = F.when(low.isNull() | (low == "missing"), FIXED["missing"]).when(low.contains("none"), FIXED["none"]).when(low == "nc", FIXED["nc"])
    return indels.select("indel", F.coalesce(fixed, drawn).alias("color"))


def random_color(key: Column, seed: int, *ranges: tuple[int, int]) -> Column:
    """A colour whose channels are drawn by hash of (seed, channel, key) from three ranges, ends included."""
    channel = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(ranges[i][1] - ranges[i][0] + 1)) + ranges[i][0]).cast("int")
    return rgb_to_hex(channel(0), channel(1), channel(2))


def random_indel_colors(indels: DataFrame, seed: int = 1) -> DataFrame:
    """(indel, color) of the distinct indels: drawn by hash, fixed colours for uncut, uncalled and missing."""
    low = F.lower("indel")
    fixed = F.when(low == "missing", FIXED["missing"]).when(low.contains("none"), FIXED["none"]).when(low == "nc", FIXED["nc"])
    drawn = random_color(F.col("indel"), seed, (40, 250), (40, 250), (40, 250))
    return indels.select("indel").where("indel IS NOT NULL").distinct().select("indel", F.coalesce(fixed, drawn).alias("color"))


def strip_size(placed: DataFrame) -> DataFrame:
    """(depth, width): a strip is a twentieth of the range of y deep, and a leaf of (x, y) has an equal share of the range of x."""
    return placed.agg(((F.max("y") - F.min("y")) * 0.05).alias("depth"), ((F.max("x") - F.min("x") + 1) / F.count(F.lit(1))).alias("width"))


def color_strip(placed: DataFrame, width: float, gap: float = 0.0) -> DataFrame:
    """Add x0, x1, y0, y1 of a box beyond each leaf (x, y): as wide as a leaf's place, ``width`` deep."""
    return placed.withColumns({"x0": F.col("x") - 0.5, "x1": F.col("x") + 0.5, "y0": F.col("y") + gap, "y1": F.col("y") + gap + width})


def gradient(value: Column, low: float, high: float) -> Column:
    """The place of a value between two bounds, clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def clade_colors(paths: DataFrame, colors: DataFrame) -> DataFrame:
    """(node, color): the colour of the nearest coloured ancestor or self. ``colors``: node, color."""
    of = colors.select(F.col("node").alias("ancestor"), "color")
    return paths.join(of, "ancestor").groupBy("node").agg(F.min_by("color", "hops").alias("color"))


def strip_dataset(values: DataFrame, name: str) -> DataFrame:
    """(line, value): the lines of a colour-strip dataset for tree viewers, in order of ``line``. ``values``: node, color, label."""
    head = ["DATASET_COLORSTRIP", "SEPARATOR TAB", f"DATASET_LABEL\t{name}", "COLOR\t#000000", "DATA"]
    top = values.sparkSession.createDataFrame([(f"0{i}", v) for i, v in enumerate(head)], "line string, value string")
    return top.union(values.select(F.concat(F.lit("1"), F.col("node").cast("string")), F.concat_ws("\t", F.col("node").cast("string"), "color", F.col("label").cast("string"))))
