"""Quantiles by selection against sorted values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.quantiles import quantiles

WANTED = {"q0": ("v", 0.0, "linear"), "q80": ("v", 0.8, "linear"), "top": ("v", 1.0, "linear"), "low": ("v", 0.5, "lower"), "middle": ("w", 0.5, "linear")}


def linear(values, q):
    if not values:
        return None
    values, at = sorted(values), (len(values) - 1) * q
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def plain(rows):
    out = {}
    for k in {r[0] for r in rows}:
        v, w = ([r[i] for r in rows if r[0] == k and r[i] is not None and not math.isnan(r[i])] for i in (1, 2))
        lower = sorted(v)[max(math.ceil(len(v) / 2) - 1, 0)] if v else None
        out[k] = (linear(v, 0.0), linear(v, 0.8), linear(v, 1.0), lower, linear(w, 0.5))
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))


def table(n):
    pick = random.Random(3)
    hot = [("hot", pick.choice([1.0, 2.0, pick.random(), -1e300, 1e-300 * pick.random()]), float(i % 7)) for i in range(n)]
    tied = [("tied", 4.0, None) for _ in range(n // 2)] + [("tied", 5.0, float("nan"))] * (n // 4)
    small = [("small", pick.random(), pick.random()) for _ in range(9)] + [("small", None, 1.0), (None, 3.0, 2.0), (None, 5.0, 2.5), ("none", None, None)]
    return [*hot, *tied, *small]


@pytest.mark.parametrize("held", [5, 300, 10**6])
def test_selection_is_exact(spark, held):
    rows = table(2000)
    got = quantiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], WANTED, held, {"n": F.count(F.lit(1))}).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert all(map(close, tuple(r)[1:-1], want[r.k])), (r, want[r.k])
        assert r.n == sum(x[0] == r.k for x in rows)


def test_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "k string, v double, w double"), ["k"], WANTED, 5).count() == 0


def test_one_group_of_many_rows(spark):
    """All rows in one group: the last step orders no more than ``held`` of them."""
    df = spark.range(300_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 300_007).cast("double").alias("v"))
    values = sorted((i * 7919) % 300_007 for i in range(300_000))
    got = quantiles(df, ["k"], {"q": ("v", 0.37, "lower")}, 2000).first()
    assert got.q == values[math.ceil(300_000 * 0.37) - 1]
