"""Interval joins on intervals of any length against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import intervals as I


def spans(seed, n):
    r = random.Random(seed)
    out = [(k, i, float(a := r.randint(0, 5000)), float(a + 10 ** r.uniform(0, 6))) for i in range(n) for k in [r.choice("ab")]]
    return [*out, ("a", n, -5e8, 5e8), ("a", n + 1, 40.0, 30.0), ("b", n + 2, 7.0, 7.0), ("b", n + 3, None, 9.0), ("b", n + 4, 9.0, None)]


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(spans(1, 60), "k string, i int, s double, e double")


def test_points_in_intervals_of_any_length(spark, left):
    r = random.Random(2)
    pts = [(r.choice("abc"), p, float(r.randint(-100, 9000))) for p in range(150)] + [("a", 900, None), ("a", 901, 1e9)]
    points = spark.createDataFrame(pts, "k string, p int, t double")
    want = {(p, i) for k, p, t in pts for k2, i, s, e in spans(1, 60) if k == k2 and None not in (t, s, e) and s <= t <= e}
    got = I.point_join(points, left, "k", "t", "s", "e", 4).select("p", "i").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    kept = I.point_join(points, left, "k", "t", "s", "e", 4, how="right").select("p", "i").collect()
    alone = {p for _, p, _ in pts} - {p for p, _ in want}
    assert Counter(map(tuple, kept)) == Counter(want | {(p, None) for p in alone})


def test_overlaps_of_any_length(spark, left):
    other = spans(3, 60)
    right = spark.createDataFrame(other, "k string, j int, s2 double, e2 double")
    got = I.overlap_join(left, right, "k", "s", "e", "s2", "e2", 4).select("i", "j").collect()
    full = lambda rows: [x for x in rows if None not in x and x[3] >= x[2]]
    want = {(a[1], b[1]) for a in full(spans(1, 60)) for b in full(other) if a[0] == b[0] and not (a[3] <= b[2] or a[2] >= b[3])}
    found = Counter((i, j) for i, j in map(tuple, got) if i != 61 and j != 61)
    assert found == Counter(want)


def test_copies_follow_levels_not_lengths(left):
    levels = I.levels_in_use(left, "s", "e", 1)
    assert len(levels) > 4
    most = I.spread(left, "s", "e", 1, levels).groupBy("i").count().agg(F.max("count")).first()[0]
    above = I.spread(left, "s", "e", 1, levels, upward=True).groupBy("i").count().agg(F.max("count")).first()[0]
    assert most <= I.STEP + 1 and above <= I.STEP + 1 + 2 * len(levels)
