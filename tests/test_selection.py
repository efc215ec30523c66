"""Medians of groups, by narrowing prefixes of bits."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftwood.operators.selection import group_lower_medians, ordered_bits

ODD = [0.0, -0.0, 1.0, -1.0, 1e-300, -1e-300, 1e300, -1e300, math.inf, -math.inf, 5e-324, 0.1, 0.1 + 2**-56, math.nan]


def test_bits_keep_the_order(spark):
    rows = spark.createDataFrame([(v,) for v in ODD], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    got = sorted((r for r in rows if r["v"] == r["v"]), key=lambda r: r["b"])
    assert [r["v"] for r in got] == sorted(v for v in ODD if v == v)
    assert max(rows, key=lambda r: r["b"])["v"] != max(rows, key=lambda r: r["b"])["v"]
    assert len({r["b"] for r in rows if r["v"] == 0}) == 1


@pytest.mark.parametrize("small", [0, 3, 100_000])
def test_equals_the_lower_median(spark, small):
    g = random.Random(2)
    rows = []
    for group in [*"abcdefg", None]:
        for _ in range(g.randint(1, 60)):
            rows.append((group, g.choice([g.gauss(0, 1), g.choice(ODD[:-1]), 0.25]), g.choice([None, float(g.randint(0, 3))])))
    rows += [("none", None, None), ("same", 2.0, 1.0), ("same", 2.0, 1.0)]
    got = {r["g"]: (r["x"], r["y"]) for r in group_lower_medians(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], small).collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        both = [[r[i] for r in rows if r[0] == group and r[i] is not None] for i in (1, 2)]
        expected[group] = tuple(statistics.median_low(v) if v else None for v in both)
    assert got == expected


def test_a_group_of_a_million_rows(spark):
    rows = spark.range(1_000_001).select(F.lit("k").alias("g"), (F.col("id") / 7).alias("x"))
    r = group_lower_medians(rows, ["g"], ["x"], small=1000).first()
    assert r["x"] == 500_000 / 7


def test_empty(spark):
    assert group_lower_medians(spark.createDataFrame([], "g string, x double"), ["g"], ["x"]).count() == 0
