"""Results and costs that showed only on larger tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.plans import catalog


def test_slot_scores_are_added_as_sql_adds(spark, tmp_path):
    """Probabilities that end in a tie of the fifth place, by the last bit of their total."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT row_number() OVER () AS doc_id, text FROM (VALUES ('31160'), ('57053'), ('58078'), ('65984'), (NULL)) x(text)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, speaker_attributes FROM ({catalog.ORACLES['model_slots']}) ORDER BY 1").fetchall()
    got = catalog.QUERIES["model_slots"](spark, str(tmp_path)).select("doc_id", "speaker_attributes").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_blocks_find_neighbours_and_trees_of_many_blocks(spark, monkeypatch):
    """Against plain code with blocks of a few rows, copies and ties of distance among them."""
    from reelgrid.operators import density_clusters as D
    from reelgrid.operators import vector_blocks as B
    from tests.test_density_clusters import collapsed, frame, plain_tree

    monkeypatch.setattr(B, "LEAST", 8)
    monkeypatch.setattr(B, "TILE", 60)
    g = np.random.default_rng(5)
    grid = [(float(a), float(b), 1.0) for a in range(4) for b in range(4)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*g.normal(0, 1, (60, 3)), *grid, *grid[:5]])]
    ids, x, copies, _ = collapsed(rows)
    tree, _ = plain_tree(ids, x, copies, 3)
    got = sorted((r.w, r.a, r.b) for r in D.reachability_tree(frame(spark, rows), "k", "i", "e", 3).collect())
    assert len(got) == len(tree) and np.allclose([e[0] for e in got], [e[0] for e in tree], atol=1e-9)
    near = {}
    for r in D.nearest(frame(spark, rows), "k", "i", "e", 4).collect():
        near.setdefault(r.i, []).append((r.rank, r.dist))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i in unit:
        want = sorted(float(np.linalg.norm(unit[i] - unit[j])) for j in unit if j != i)[:4]
        assert np.allclose([d for _, d in sorted(near[i])], want, atol=1e-9)


def test_neighbours_meet_no_pivots(spark, monkeypatch):
    """No row for each vector and pivot: of vectors without structure all cells stay open, and those rows grew by the power 1.5."""
    from reelgrid.operators import density_clusters as D
    from tests.test_density_clusters import frame

    monkeypatch.setattr(D, "cells", None)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(6).normal(0, 1, (40, 4)))]
    assert D.core_distances(frame(spark, rows), "k", "i", "e", 5).count() == 40


def test_turn_features_shuffle_no_windows(spark):
    """Windows are made in their turns' rows: none is an exchanged column, whatever their number."""
    from reelgrid.plans.products import _turn_features

    plan = _turn_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("w_start" in line or "win#" in line for line in joins)


def test_links_are_fewer_than_pairs_and_connect_the_same(spark, monkeypatch):
    """Of 90 vectors that are all near each other: 4,005 pairs, but for each two blocks fewer links than vectors."""
    from reelgrid.operators import proximity
    from reelgrid.operators import vector_blocks as B

    monkeypatch.setattr(B, "LEAST", 20)
    g = np.random.default_rng(8)
    rows = [("v", i, [float(c) for c in np.array([3.0, 0, 0, 0]) + g.normal(0, 0.05, 4)]) for i in range(90)]
    df = spark.createDataFrame([*rows, ("v", 90, [0.0, 1.0, 0.0, 0.0]), ("w", 91, [0.0, 1.0, 0.0, 0.0]), ("v", 92, None)], "v string, i long, e array<double>")
    assert proximity.near_pairs(df, "v", "i", "e", 0.1).count() == 90 * 89 // 2
    links = proximity.near_links(df, "v", "i", "e", 0.1)
    assert links.count() < 15 * 40
    names = {r.node: r.name for r in proximity.connected(links, "i", "other").collect()}
    assert set(names) == set(range(90)) and len(set(names.values())) == 1


def test_linking_meets_each_span_once(spark):
    """Many mentions and candidates on the same characters of one text: the join holds spans, not their product."""
    from reelgrid.operators.entities import link_mentions

    m = spark.range(300).selectExpr("id", "1 AS turn", "cast(id % 3 AS int) * 4 AS start", "cast(id % 3 AS int) * 4 + 10 AS end", "'name' AS text", "'PER' AS type")
    c = spark.range(400).selectExpr("concat('Q', id) AS qid", "id AS seq", "1 AS turn", "cast(id % 2 AS int) * 4 AS ch_from", "cast(id % 2 AS int) * 4 + 9 AS ch_to", "cast(id % 7 AS double) AS page_rank")
    found = spark.range(0).selectExpr("id AS hit", "'x' AS search_id")
    out = link_mentions(m, c, found, F.col("id") == F.col("hit"), ["id"], ["turn"])
    got = {r.id: r.wd_id for r in out.collect()}
    cands = [(i % 7, -i, i % 2 * 4) for i in range(400) if i % 7]
    want = {i: "Q%d" % -max((r, s) for r, s, f in cands if f >= i % 3 * 4 - 2 and f + 9 <= i % 3 * 4 + 12)[1] if any(f >= i % 3 * 4 - 2 and f + 9 <= i % 3 * 4 + 12 for _, _, f in cands) else "unk" for i in range(300)}
    assert got == want
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "ch_from" in line]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert joins and plan[plan.index(joins[0]) + len(joins[0]) :].lstrip(" :+-\n").startswith("Aggregate")


def test_vectors_that_hang_together_are_linked_once(spark, monkeypatch):
    """Of 90 vectors that are all near each other, as many links as join them, not as many for each two blocks."""
    from reelgrid.operators import proximity
    from reelgrid.operators import vector_blocks as B

    monkeypatch.setattr(B, "LEAST", 20)
    monkeypatch.setattr(B, "PROBES", 12, raising=False)
    g = np.random.default_rng(8)
    df = spark.createDataFrame([("v", i, [float(c) for c in np.array([3.0, 0, 0, 0]) + g.normal(0, 0.05, 4)]) for i in range(90)], "v string, i long, e array<double>")
    links = proximity.near_links(df, "v", "i", "e", 0.1).collect()
    assert len(links) == 89 and {x for r in links for x in (r.i, r.other)} == set(range(90))


@pytest.mark.parametrize("most", [16, 4096])
def test_clusters_of_any_shape_by_hearts_and_rounds(spark, monkeypatch, most):
    """Chains, knots, points alone, a key without links, a small one and a null one, against all pairs."""
    from functools import partial

    from reelgrid.operators import proximity, tracking
    from reelgrid.operators import vector_blocks as B

    monkeypatch.setattr(B, "LEAST", 20)
    monkeypatch.setattr(B, "PROBES", 10)
    monkeypatch.setattr(B, "GROWTH", 2)
    monkeypatch.setattr(proximity, "linked_within", partial(B.linked_within, most=most))
    g, rows = np.random.default_rng(3), []
    turn = lambda a, b, x: [float(np.cos(x)) if j == a else float(np.sin(x)) if j == b else 0.0 for j in range(8)]
    for key in ("v", "w"):
        rows += [(key, turn(0, 1, 0.05 * j)) for j in range(30)] + [(key, turn(2, 3, 0.04 * j)) for j in range(25)]
        rows += [(key, turn(4, 5, float(x))) for x in g.uniform(0, 1.5, 12)] + [(key, turn(6, 7, 0.3 * j)) for j in range(5)]
    rows += [("few", turn(0, 1, 0.01 * j)) for j in range(3)] + [("apart", turn(j // 8, j // 8 + 1, 0.19 * (j % 8))) for j in range(48)]
    rows += [("v", None), ("v", [0.0] * 8), (None, turn(0, 1, 0.0)), (None, turn(0, 1, 0.0))]
    rows = [(k, int(i), e) for i, (k, e) in zip(g.permutation(len(rows)), rows, strict=True)]
    eps, name = 0.004, {i: i for _, i, _ in rows}
    at = {i: (k, np.array(e) / np.linalg.norm(e)) for k, i, e in rows if k and e and any(e)}
    for _ in range(len(at)):
        for i, (k, x) in at.items():
            name[i] = min(name[j] for j, (m, y) in at.items() if m == k and (j == i or 1 - x @ y <= eps))
    sizes, want = {n: sum(m == n for m in name.values()) for n in name.values()}, {}
    for k, i, _ in rows:
        firsts = sorted({name[j] for m, j, _ in rows if m == k and sizes[name[j]] > 1})
        want[i] = firsts.index(name[i]) if sizes[name[i]] > 1 else -1
    got = tracking.cluster_vectors(spark.createDataFrame(rows, "v string, i long, e array<double>"), "v", "i", "e", eps).collect()
    assert len(got) == len(rows) and {r.i: r.cluster for r in got} == want


def test_made_rows_do_not_swell_a_task(spark, monkeypatch):
    """A task's observations are bounded by rows, not by the bytes that were shuffled before rows are made of them."""
    from reelgrid.operators import dealing

    monkeypatch.setattr(dealing, "ROWS", 50)
    data = "/root/testdata/sf0.001"
    out, n = catalog.QUERIES["interpolated_track"](spark, data), spark.read.parquet(f"{data}/orders.parquet").count()
    assert out.rdd.getNumPartitions() == -(-n // 50)


def test_faces_in_turns_are_dealt_by_rows(spark, monkeypatch):
    """Faces meet turns in as many tasks as their rows need, with the rows of the SQL."""
    from reelgrid.operators import dealing

    monkeypatch.setattr(dealing, "ROWS", 500)
    data = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, n = catalog.QUERIES["speaker_turns_meta"](spark, data), spark.read.parquet(f"{data}/lineitem.parquet").count()
        assert out.rdd.getNumPartitions() == -(-n // 500)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({catalog.ORACLES['speaker_turns_meta']})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_turn_features_meet_points_and_segments_once(spark):
    """Each join and job costs the driver memory for its plan and code, whatever the tables' size."""
    from reelgrid.plans.products import _turn_features

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("turn_features", "")
    try:
        plan = _turn_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert plan.count("Join ") <= 8 and len(tracker.getJobIdsForGroup("turn_features")) <= 20


def test_ensembles_are_fitted_on_every_labelled_row(spark):
    """A tree without a split counts in its root all rows that it was fitted on."""
    from pyspark.ml.linalg import Vectors

    from reelgrid.operators import classify

    df = spark.range(230_000).select(F.array(F.lit(1.0)).alias("f"), (F.col("id") % 2).cast("int").alias("label"))
    model = classify.fit_ensemble(df, "f", "label", "tree", depth=1)
    assert sum(model.predictRaw(Vectors.dense(1.0))) == 230_000


def test_slots_see_pieces_of_bounded_text(spark):
    """A slot's function gets 500 values and half a megabyte of text at most, as its results may be many times as large."""
    from reelgrid.functions.models import apply_model, registered

    df = spark.range(1300, numPartitions=1).select("id", F.when(F.col("id") % 5 != 0, F.repeat(F.lit("x "), 2000)).alias("t"))
    with registered("caption", lambda s: s.map(lambda _: f"{len(s)} {sum(len(v) for v in s if v is not None)}")):
        got = [r.c.split() for r in apply_model(df, "caption", F.col("t"), "c").select("c").collect()]
    assert len(got) == 1300 and all(int(n) <= 500 and int(size) <= 1 << 19 for n, size in got)
