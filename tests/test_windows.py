"""Totals of windows from running totals, against sums over the points in each window."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.sequences import window_totals

WINDOW, POINT = "k string, i int, s double, e double", "k string, t double, v double"


def totals(spark, windows, points, width=10.0):
    out = window_totals(spark.createDataFrame(windows, WINDOW), spark.createDataFrame(points, POINT), "k", ["i"], "s", "e", "t", "v", width)
    return {(r.k, r.i): (r.n, r.total) for r in out.collect()}


def plain(windows, points):
    inside = lambda k, s, e: [v for p, t, v in points if k is not None and p == k and None not in (t, v) and s <= t <= e]
    return {(k, i): (len(inside(k, s, e)), sum(inside(k, s, e))) for k, i, s, e in windows}


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_totals_are_sums_over_points(spark, width):
    pick = random.Random(7)
    points = [(pick.choice("aab"), float(pick.randrange(-40, 200)), float(pick.randrange(9))) for _ in range(400)]
    points += [("a", None, 1.0), ("a", 3.0, None), (None, 3.0, 2.0), ("b", 5.0, 5.0), ("b", 5.0, 5.0)]
    starts = [float(pick.randrange(-60, 220)) for _ in range(60)]
    windows = [(pick.choice("aabc"), i, s, s + pick.choice([0.0, 1.0, 7.0, 90.0, 1e9])) for i, s in enumerate(starts)] + [(None, 99, 0.0, 10.0)]
    got, want = totals(spark, windows, points, width), plain(windows, points)
    assert set(got) == set(want)
    assert all(got[w][0] == n and math.isclose(got[w][1], total, abs_tol=1e-9) for w, (n, total) in want.items())


def test_empty_sides(spark):
    assert totals(spark, [], [("a", 1.0, 1.0)]) == {}
    assert totals(spark, [("a", 0, 0.0, 1.0)], []) == {("a", 0): (0, 0.0)}


def test_fractions_of_time_meet_whole_windows(spark):
    windows = spark.sql("SELECT 'a' AS k, 0 AS i, CAST(1 AS BIGINT) AS s, CAST(2 AS BIGINT) AS e")
    points = spark.createDataFrame([("a", 0.9, 1.0), ("a", 1.5, 2.0), ("a", 2.1, 4.0)], POINT)
    assert window_totals(windows, points, "k", ["i"], "s", "e", "t", "v", 1.0).first().total == 2.0


def test_one_key_is_spread_over_its_blocks(spark):
    points = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("v"))
    windows = spark.range(50).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("i"), F.lit(0.0).alias("s"), (F.col("id") * 100).cast("double").alias("e"))
    out = window_totals(windows, points, "k", ["i"], "s", "e", "t", "v", 50.0)
    assert "hashpartitioning(k#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "_b#" in plan
    assert {r.i: r.n for r in out.collect()} == {i: i * 100 + 1 for i in range(50)}


@pytest.mark.parametrize("whole", [True, False])
def test_pooled_windows_meet_once(spark, whole):
    """Whole and broken times, touching windows, a doubled turn, a turn in two parts, turns without length or key, against plain code; no join."""
    from reelgrid.operators.sequences import pooled_windows

    pick, step, kind = random.Random(5), 1 if whole else 0.1, "long" if whole else "double"
    at = lambda lo, hi: pick.randrange(lo, hi) * step
    points = [(pick.choice("aab"), at(-30, 160), float(pick.randrange(9))) for _ in range(300)] + [("a", None, 1.0), ("a", 3 * step, None), (None, 3 * step, 2.0)]
    turns = [(pick.choice("aabc"), i, s, s + pick.choice([0, 1, 7, 40, 300]) * step) for i, s in enumerate(at(-50, 170) for _ in range(40))]
    turns += [turns[3], turns[3], ("a", 90, 3 * step, 40 * step), ("a", 90, 50 * step, 61 * step), (None, 91, 0 * step, 10 * step), ("a", 92, None, 3 * step), ("b", 93, 9 * step, 2 * step)]
    lengths, seen = [5, 18], {}
    for k, i, s, e in turns:
        for length in lengths if s is not None and e > s else []:
            for j in range(math.ceil((e - s) / length)):
                a, z = s + j * length, min(s + j * length + length, e)
                seen.setdefault((k, i, length), {}).setdefault(j, []).extend(v for p, t, v in points if k is not None and p == k and None not in (t, v) and a <= t <= z)
    want = {}
    for key, windows in seen.items():
        m = sorted(sum(v) / len(v) if v else 0.0 for v in windows.values())
        place = 0.8 * (len(m) - 1)
        low, high = math.floor(place), math.ceil(place)
        want[key] = (len(m), sum(m) / len(m), m[low] + (place - low) * (m[high] - m[low]))
    v, p = spark.createDataFrame(turns, f"k string, i int, s {kind}, e {kind}"), spark.createDataFrame(points, f"k string, t {kind}, v double")
    out = pooled_windows(v, p, "k", "i", "s", "e", "t", "v", lengths, None, 20)
    got = {(r.k, r.i, r.length): (r.n_windows, r.mean, r["quantile"]) for r in out.collect()}
    assert set(got) == set(want) and out.count() == len(want)
    assert all(got[k][0] == w[0] and math.isclose(got[k][1], w[1], abs_tol=1e-9) and math.isclose(got[k][2], w[2], abs_tol=1e-9) for k, w in want.items())
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
