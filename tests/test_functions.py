import math

import pytest
from pyspark.sql import functions as F

from cladeworks.functions import counting, drawing
from cladeworks.operators import trees as T
from tests.test_trees import tree


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_colors(spark):
    assert value(spark, drawing.hex_to_rgb(F.lit("#0a10ff"))) == [10, 16, 255] and value(spark, drawing.hex_to_rgb(F.lit("red"))) is None
    assert value(spark, drawing.rgb_to_hex(F.lit(10), F.lit(16), F.lit(255))) == "#0a10ff"
    assert [value(spark, drawing.hsv_to_hex(F.lit(h), F.lit(1.0), F.lit(1.0))) for h in (0.0, 1 / 3, 2 / 3)] == ["#ff0000", "#00ff00", "#0000ff"]
    got = {r.indel: r.color for r in drawing.indel_colors(spark.createDataFrame([("None", 0.1), ("I1", 0.5), (None, None)], "indel string, freq double")).collect()}
    assert got["None"] == "#d3d3d3" and got[None] == "#ffffff" and got["I1"].startswith("#")


def test_places(spark):
    x, y = drawing.polar_to_cartesian(F.lit(90.0), F.lit(2.0))
    assert value(spark, x) == pytest.approx(0, abs=1e-12) and value(spark, y) == pytest.approx(2)
    assert [value(spark, drawing.gradient(F.lit(v), 0.0, 10.0)) for v in (-1.0, 5.0, 99.0)] == [0, 0.5, 1]


def test_clade_colors_nest(spark):
    t = tree(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("c", "d")])
    got = {r.node: r.color for r in drawing.clade_colors(T.closure(t), spark.createDataFrame([("a", "red"), ("c", "blue")], "node string, color string")).collect()}
    assert got == {"a": "red", "c": "blue", "d": "blue"}
    lines = drawing.strip_dataset(spark.createDataFrame([("a", "#fff", "x")], "node string, color string, label string"), "n").orderBy("line").collect()
    assert lines[-1].value == "a\t#fff\tx" and lines[0].value == "DATASET_COLORSTRIP"


def test_counting(spark):
    assert value(spark, counting.binomial(F.lit(10), F.lit(2))) == 45 and value(spark, counting.binomial(F.lit(5), F.lit(7))) == 0
    assert value(spark, counting.binomial(F.lit(100), F.lit(50))) == pytest.approx(math.comb(100, 50))
    assert value(spark, counting.coalescent_clade_probability(F.lit(100), F.lit(2), F.lit(60))) == pytest.approx(0.24, abs=0.01)
