"""Blocks of intervals against comparing every point with every interval."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import intervals


def test_pairs_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(5)
    points = [(int(k), int(p)) for k, p in zip(rng.integers(0, 3, 300), rng.integers(-500, 500, 300), strict=True)] + [(0, None)]
    windows = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 80), rng.integers(-600, 600, 80), rng.integers(-5, 300, 80), strict=True)] + [(1, None, 3), (1, -4, None), (2, None, None), (0, 5, 5)]
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, k int, p long")
    held = spark.createDataFrame([(j, *w) for j, w in enumerate(windows)], "j int, k int, a long, b long")
    got = intervals.pairs(at, held, "p", "a", "b", ("k",))
    want = sorted((i, j) for i, (k, p) in enumerate(points) for j, (m, a, b) in enumerate(windows) if p is not None and k == m and (a is None or a <= p) and (b is None or p <= b))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 500
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {(r["k"], r["p"]) for r in intervals.holding(at, held, "p", "a", "b", ("k",)).collect()} == {points[i] for i, _ in want}


def test_dates_and_empty_tables(spark):
    days = spark.createDataFrame([(dt.date(2024, 2, d),) for d in range(1, 30)], "day date")
    windows = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 2, 3)), (dt.date(2024, 2, 28), None), (dt.date(2024, 2, 10), dt.date(2024, 2, 9))], "a date, b date")
    assert sorted(r["day"].day for r in intervals.holding(days, windows, "day", "a", "b").collect()) == [1, 2, 3, 28, 29]
    assert not intervals.holding(days.limit(0), windows, "day", "a", "b").collect() and not intervals.holding(days, windows.limit(0), "day", "a", "b").collect()


def test_blocks_are_the_fewest(spark):
    row = spark.range(1).select(intervals.blocks(F.lit(3).cast("long"), F.lit(16).cast("long"), 6).alias("b")).first()["b"]
    assert {(x["level"], x["block"]) for x in row} == {(0, 3), (2, 1), (3, 1), (0, 16)}
