"""Exact sums: one answer in any order of the rows, and fits that repeat bit by bit."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from framespan.operators import robust


def _rows(n, seed=3):
    r = random.Random(seed)
    out = [(r.randrange(3), r.uniform(0.1, 80.0) * 10 ** r.randint(-6, 3), r.uniform(0.1, 80.0)) for _ in range(n)]
    return [(k, p, p * 1.7 if r.random() < 0.3 else g) for k, p, g in out]  # a third fits exactly: weights of 1e8


def _fits(spark, rows, parts):
    df = spark.createDataFrame(rows, "seq int, pred double, gt double").repartition(parts)
    return [
        sorted(map(tuple, fit(df, ["seq"]).collect()))
        for fit in (robust.irls_scale_eval, robust.irls_scale_depth, robust.l1_scale_shift)
    ]


def test_sums_are_those_of_exact_arithmetic(spark):
    rows = [(k, p * (-1) ** i, g) for i, (k, p, g) in enumerate(_rows(2000))]
    df = spark.createDataFrame(rows, "seq int, pred double, gt double")
    sized = robust._sized(df, ["seq"], ["pred", "gt"], 3)
    got = robust.exact_sums(sized, ["seq"], {"s": (F.col("pred"), F.col("_top"))}).collect()
    for r in got:
        values = [p for k, p, _ in rows if k == r["seq"]]
        assert r["s"] == pytest.approx(math.fsum(values), rel=1e-15, abs=max(map(abs, values)) * 2.0**-90 * len(values))


def test_fits_do_not_depend_on_the_order_of_rows(spark):
    rows = _rows(3000)
    first = _fits(spark, rows, 1)
    random.Random(9).shuffle(rows)
    assert _fits(spark, rows, 7) == first


def test_values_that_are_no_numbers_show(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, float("nan"), 2.0), (1, 1.0, 2.0), (2, None, 1.0), (3, 0.0, 0.0)], "seq int, pred double, gt double")
    got = {r["seq"]: r["scale"] for r in robust.irls_scale_depth(df, ["seq"], clamp_min=None).collect()}
    assert math.isnan(got[0]) and got[1] == 2.0 and got[2] is None and set(got) == {0, 1, 2, 3}
