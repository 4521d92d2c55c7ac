"""Every core query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from reelgrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float | int) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    ours, theirs = rows(got.collect(), got.columns), rows(want.fetchall(), want.columns)
    assert len(ours) == len(theirs)
    bad = [(x, y) for x, y in zip(ours, theirs, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    """Rows that SQL can't give: the same at a second run, and no column is null throughout."""
    first, again = (catalog.QUERIES[name](spark, SF) for _ in range(2))
    values = rows(first.collect(), first.columns)
    assert values == rows(again.collect(), again.columns)
    if name != "face_tracks":
        assert values and all(any(r[i] is not None for r in values) for i in range(len(first.columns)))


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_turn_features_cover_every_turn(spark):
    from reelgrid.plans import adapters as A

    sf = "/root/testdata/sf0.01"
    assert catalog.QUERIES["turn_feature_vectors"](spark, sf).count() == A.intervals(spark, sf).where("e > s").count()


def test_face_tracks_cover_every_shot(spark):
    sf = "/root/testdata/sf0.01"
    shots = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert shots > 19 and catalog.QUERIES["face_tracks"](spark, sf).select("shot").distinct().count() == shots


def test_fitted_roles_follow_their_teacher(spark):
    from pyspark.sql import functions as F

    from reelgrid.plans.products import _turn_features

    turns = _turn_features(spark, SF).select("video_id", "idx", F.when(F.element_at("seg_feature", 4) < 60, "anchor").when(F.element_at("seg_feature", 6) < 2, "reporter").otherwise("guest").alias("want"))
    got = catalog.QUERIES["turn_roles"](spark, SF).join(turns, ["video_id", "idx"])
    assert got.count() == turns.count() and got.where("name = want").count() >= 0.8 * turns.count()
