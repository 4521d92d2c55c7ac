"""Operators on hand-written rows: ties, touching ends, absent neighbours, rows without length."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import numeric as N
from reelgrid.functions import text as T
from reelgrid.functions import vectors as V
from reelgrid.functions.models import apply_model, register, registered
from reelgrid.operators import aggregates as G
from reelgrid.operators import entities as E
from reelgrid.operators import fusion, graph, incremental, intervals, sequences, tiers, tracking
from reelgrid.sources import readers, sinks


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_point_join_ends(spark):
    p = spark.createDataFrame([("v", t) for t in (0.0, 1.0, 2.0)], "video_id string, t double")
    i = spark.createDataFrame([("v", 0.0, 2.0)], "video_id string, s double, e double")
    n = {ends: intervals.point_join(p, i, "video_id", "t", "s", "e", 1, ends).count() for ends in intervals.INSIDE}
    assert n == {"closed": 3, "open": 1, "left_open": 2, "right_open": 2}
    assert intervals.point_join(p.where("t > 5"), i, "video_id", "t", "s", "e", 1, how="left").count() == 1


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([("v", 1, 0.0, 1.0), ("v", 2, 0.5, 3.0)], "video_id string, a int, s1 double, e1 double")
    b = spark.createDataFrame([("v", 9, 1.0, 2.0)], "video_id string, b int, s2 double, e2 double")
    assert got(intervals.overlap_join(a, b, "video_id", "s1", "e1", "s2", "e2", 0.3), "a", "b") == [(2, 9)]


def test_overlap_join_against_plain_join(spark):
    a = spark.range(300).selectExpr("id % 3 AS video_id", "id AS a", "id * 7 % 91 AS s1", "id * 7 % 91 + id % 13 AS e1")
    b = a.selectExpr("video_id", "a AS b", "s1 AS s2", "e1 AS e2")
    want = got(a.alias("x").join(b.alias("y"), F.expr("x.video_id = y.video_id AND NOT (e1 <= s2 OR s1 >= e2)")), "a", "b")
    for width in (1, 5, 100):
        assert got(intervals.overlap_join(a, b, "video_id", "s1", "e1", "s2", "e2", width), "a", "b") == want


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("v", 1, 5.0), ("v", 2, 50.0), ("w", 3, 1.0)], "k string, id int, t double")
    right = spark.createDataFrame([("v", 4.0, "a"), ("v", 6.0, "b")], "k string, u double, p string")
    assert got(intervals.nearest(left, right, "k", "t", "u", ["p"], 10), "id", "p") == [(1, "a"), (2, None), (3, None)]


def test_turns_merge_and_repair(spark):
    rows = [("v", 0, 0, 100, "A", " a "), ("v", 1, 80, 90, "A", "b"), ("v", 2, 95, 300, "B", "c d"), ("v", 3, 400, 500, None, "e"), ("v", 4, 500, 600, None, "")]
    df = spark.createDataFrame(rows, "video_id string, idx int, start_us long, end_us long, speaker string, text string")
    t = sequences.speaker_turns(df, gap=10)
    assert got(t, "turn", "start", "end", "speaker", "n_words") == [(0, 0, 90, "A", 2), (1, 100, 300, "B", 2), (2, 400, 600, None, 1)]
    cut = sequences.speaker_turns_cut(df, gap=10)
    assert got(cut, "turn", "start", "end", "speaker") == [(0, 0, 100, "A"), (1, 110, 300, "B"), (2, 400, 590, "Unknown")]


def fold(rows, tol):
    out, at = [], 0.0
    for i, (s, e) in enumerate(rows):
        if 0 <= s - at < tol:
            stop = rows[i + 1][0] if i + 1 < len(rows) and abs(rows[i + 1][0] - e) < tol else e
            out.append((at, stop))
            at = stop
        elif s - at > tol:
            out += [(at, s), (s, e)]
            at = e
        elif e > at:
            out.append((at, e))
            at = e
    return out


def test_spans_follow_the_fold(spark):
    rows = [("v", i, float((i * 37) % 100), float((i * 37) % 100 + 3 + i % 9)) for i in range(40)] + [("w", 0, 3.0, 5.0), ("w", 1, 8.0, 9.0)]
    df = spark.createDataFrame(rows, "video_id string, i int, s double, e double")
    for video in "vw":
        want = fold([(s, e) for _, i, s, e in sorted((r for r in rows if r[0] == video), key=lambda r: (r[3], r[1]))], 3.0)
        have = sequences.spans(df.where(F.col("video_id") == video), "video_id", "s", "e", ["i"], 3.0).orderBy("span")
        assert [(r.start, r.end) for r in have.collect()] == want


def test_windows_are_cut_at_the_end(spark):
    df = spark.createDataFrame([("v", 0.0, 25.0), ("v", 5.0, 5.0)], "video_id string, s double, e double")
    assert got(sequences.tumbling(df, "s", "e", [10.0]), "w_start", "w_end") == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0)]
    assert got(sequences.fixed_chunks(df, "s", "e", 10.0, False), "c_start", "c_end") == [(0.0, 10.0), (10.0, 20.0)]


def test_votes_and_ties(spark):
    v = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (2, 2, "a")], "g int, m int, l string")
    assert got(G.majority(v, ["g"], "l"), "g", "l") == [(1, "a"), (2, "a")]
    assert got(G.ensemble_vote(v, ["g"], "m", "l", 0.6, "?"), "g", "l") == [(1, "?"), (2, "a")]


def test_longest_visible_prefers_clusters(spark):
    f = spark.createDataFrame([(1, None, 0), (1, None, 9), (1, 7, 3), (2, None, 1), (3, 1, 0), (3, 1, 4), (3, 2, 2), (3, 2, 6)], "turn int, c int, t int")
    assert got(G.longest_visible(f, ["turn"], "c", "t"), "turn", "c", "first_seen") == [(1, 7, 3), (2, None, 1), (3, 2, 2)]


def test_entity_edges_keep_first_and_unknown(spark):
    m = spark.createDataFrame([("v", 0, 0, "X", "x"), ("v", 1, 0, "X", "x"), ("v", 1, 1, "unk", "y"), ("v", 2, 0, "unk", "y")], "v string, turn int, pos int, wd_label string, text string")
    assert got(graph.entity_edges(m, "v", "wd_label", "text", ["turn", "pos"]), "turn", "entity") == [(0, "X"), (1, "y"), (2, "y")]


def test_upserts(spark):
    e = spark.createDataFrame([("a", "b", 1.0, 1), ("b", "a", 2.0, 2)], "src string, dst string, w double, seq int")
    assert got(graph.upsert_edges(e, [], "seq"), "src", "dst", "w") == [("a", "b", 2.0)]


def test_tracks_bridge_gaps_and_skip_none(spark):
    rows = [("s", f, f"{f}-{k}", 10.0 * k + 0.1 * f, 0.0, 10.0 * k + 8 + 0.1 * f, 8.0) for f in range(12) for k in (0, 5) if f != 6]
    df = spark.createDataFrame(rows, "shot string, frame int, face_id string, x1 double, y1 double, x2 double, y2 double")
    t = tracking.track_faces(df, ["shot"])
    assert t.select("track_id").distinct().count() == 2
    assert t.where("face_id IS NULL").count() == 2 and t.count() == 24


def test_clusters_and_noise(spark):
    df = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [0.99, 0.1]), ("v", 2, [0.0, 1.0])], "v string, i int, e array<double>")
    assert got(tracking.cluster_vectors(df, "v", "i", "e", 0.1), "i", "cluster") == [(0, 0), (1, 0), (2, -1)]


def test_rules_and_person_types(spark):
    b = spark.createDataFrame([(1, 2, "o"), (1, 1, "x"), (1, 3, "e")], "entity int, seq int, cls string")
    assert got(E.first_rule(b, "entity", "seq", [(F.col("cls") == "e", "EVENT"), (F.col("cls") == "o", "ORG")]), "entity", "rule_type") == [(1, "ORG")]
    p = spark.createDataFrame([("A B", "wikifier"), ("A", "wikifier"), ("A B", "unk")], "l string, d string")
    assert got(p.select(E.person_type(F.col("l"), F.col("d")).alias("t")), "t") == [("EPER",), ("LPER",), ("LPER",)]


def test_text_parsers(spark):
    df = spark.createDataFrame([("",), ("b",), ("The answer is d.",), ("maybe B",), ("none",)], "a string")
    assert [r[0] for r in df.select(T.choice_of(F.col("a"), ["A", "B"])).collect()] == ["Z", "b", "D", "B", "Z"]
    words = spark.createDataFrame([("aaa bb c",), ("",), ("longer x",)], "s string")
    assert [r[0] for r in words.select(T.char_chunks(F.col("s"), 5)).collect()] == [["aaa", "bb c"], [], ["", "longer", "x"]]


def test_sampling(spark):
    df = spark.createDataFrame([(0, 3), (0, 100)], "s int, e int")
    assert [r[0] for r in df.select(N.spread(F.col("s"), F.col("e"), 5)).collect()] == [[0, 1, 2, 3], [0, 25, 50, 75, 100]]


def test_incremental_run(spark, tmp_path):
    df = spark.createDataFrame([("c", "v1", 1), ("c", "v2", 2)], "channel string, video_id string, x int")
    path = f"file://{tmp_path}/a"
    incremental.write_parts(df, path, ["channel", "video_id"])
    incremental.write_parts(df.where("x = 2").withColumn("x", F.lit(9)), path, ["channel", "video_id"])
    done = spark.read.parquet(path)
    assert got(done, "video_id", "x") == [("v1", 1), ("v2", 9)]
    asked = spark.createDataFrame([("c", "v1"), ("c", "v3")], "channel string, video_id string")
    assert got(incremental.pending(asked, done, ["channel", "video_id"]), "video_id") == [("v3",)]


def test_tiers_round_trip(spark):
    turns = spark.createDataFrame([("v", 0, 0.0, 1.5, " A ", "x & <y>"), ("v", 1, 2.0, 2.0, "B", "gone")], "video_id string, idx int, start double, end double, speaker string, text string")
    docs = sinks.annotation_documents(tiers.turn_tiers(turns))
    back = readers.parsed_annotations(docs, "video_id", "xml")
    assert got(back, "tier", "start_ms", "end_ms", "value") == [("speaker_turn", 0, 1500, "A"), ("transcript", 0, 1500, "x & <y>")]


def test_readers(spark, tmp_path):
    (tmp_path / "ids.json").write_text('["Q1", "Q2"]')
    (tmp_path / "p.json").write_text('{"d": {"l": ["a", "b"]}}')
    (tmp_path / "l.csv").write_text("x,a photo\ny,a map\n")
    (tmp_path / "n.txt").write_text("one\n\n two\n")
    at = f"file://{tmp_path}"
    assert got(readers.id_list(spark, f"{at}/ids.json"), "value") == [("Q1",), ("Q2",)]
    assert got(readers.prompts(spark, f"{at}/p.json"), "domain", "label", "prompt") == [("d", "l", "a"), ("d", "l", "b")]
    assert got(readers.lexicon(spark, f"{at}/l.csv"), "label") == [("x",), ("y",)]
    assert readers.lines(spark, f"{at}/n.txt").count() == 2
    frames = readers.frame_index(spark.createDataFrame([("v", 10, 5.0)], "video_id string, total_frames int, fps_in double"), 2.0)
    assert got(frames, "index", "frame") == [(0, 0), (1, 3), (2, 6), (3, 9)]


def test_audio_slices_are_padded(spark, tmp_path):
    import io
    import wave

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(b"\x00\x40" * 300)
    files = spark.createDataFrame([("v", buffer.getvalue())], "video_id string, content binary")
    parts = spark.createDataFrame([("v", 0, 0.0, 0.5), ("v", 1, 1.0, 2.5)], "video_id string, idx int, start double, end double")
    out = {r.idx: r.samples for r in readers.audio_slices(parts, files, rate=100).collect()}
    assert len(out[0]) == 100 and out[0][49] == 0.5 and out[0][50] == 0 and len(out[1]) == 150


def test_face_counts(spark):
    faces = spark.createDataFrame([("v", 0.9, (0.0, 0.0, 0.1, 0.2)), ("v", 0.5, (0.0, 0.0, 0.1, 0.2))], "video_id string, det_score double, bbox struct<x double, y double, w double, h double>")
    one = spark.createDataFrame([("v",)], "video_id string")
    assert fusion.face_count_check(faces, one, one).first().ok
    assert not fusion.face_count_check(faces, one, one.union(one)).first().ok


def test_model_slots(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert apply_model(df, "caption", F.col("t"), "c").first().c
    before = apply_model(df, "caption", F.col("t"), "c").first().c
    with registered("caption", lambda s: s.str.upper()):
        assert apply_model(df, "caption", F.col("t"), "c").first().c == "X"
    assert apply_model(df, "caption", F.col("t"), "c").first().c == before
    with pytest.raises(KeyError):
        register("nothing", lambda s: s)


def test_even_samples_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300kB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        df = spark.range(200_000).repartition(9).select((F.col("id") * 7919 % 200_003).alias("v"), "id", F.repeat(F.lit("x"), 64).alias("payload"), (F.col("id") % 3).alias("g"))
        out = G.evenly_spaced(df, ["v", "id"], 100).collect()
        every = [r.v for r in df.orderBy("v", "id").collect()]
        wanted = [round(i * (len(every) - 1) / 99) for i in range(100)]
        assert sorted((r["rank"], r.v) for r in out) == [(i, every[i]) for i in wanted]
        # One group holds nearly all rows, one has a null name, one fewer rows than asked for.
        skewed = df.withColumn("g", F.when(F.col("id") < 3, 1).when(F.col("id") < 50, None).otherwise(2))
        picked = G.evenly_spaced(skewed, ["v", "id"], 5, ["g"]).groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
        assert {(r.g, r.n, r.last) for r in picked} == {(1, 3, 2), (None, 5, 46), (2, 5, 199_949)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert G.evenly_spaced(df.limit(0), ["v"], 5).count() == 0


def test_topics_assigned_in_the_row(spark):
    from reelgrid.operators import topics

    docs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "i int, v array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, v array<double>")
    assert got(topics.assign_topics(docs, "v", centres, "topic"), "i", "topic") == [(1, 0), (1, 0), (2, 1), (3, 0), (4, None)]
    assert got(topics.assign_topics(docs, "v", centres, "topic", 0.9), "i", "topic")[3] == (3, -1)
    assert got(topics.assign_topics(docs, "v", centres.limit(0), "topic"), "topic") == [(None,)] * 5
    with pytest.raises(ValueError):
        topics.fixed_vectors(centres, "topic", "v", 1)
    assert got(topics.class_centres(docs.withColumn("t", F.col("i") % 2), "t", "v"), "t", "v") == [(0, [0.0, 1.0]), (1, [1.0, 1 / 3])]


def blobs(rng, n, groups):
    import numpy as np

    centres = rng.normal(size=(groups, 16)) * 5
    return [(1, i, None if i == 3 else [0.0] * 16 if i == 5 else (centres[i % groups] + rng.normal(size=16) * 0.4).tolist()) for i in range(n)], np


def test_vector_join_by_pivots_against_all_pairs(spark):
    import numpy as np

    from reelgrid.operators import proximity

    tested = {}
    for n in (300, 600):
        rows, _ = blobs(np.random.default_rng(6), n, 12)
        df = spark.createDataFrame(rows, "v int, i int, e array<double>")
        unit = {i: np.array(e) / np.linalg.norm(e) for _, i, e in rows if e and any(e)}
        want = {(i, j) for i in unit for j in unit if i < j and 1 - unit[i] @ unit[j] <= 0.05}
        pairs = [(r.i, r.other) for r in proximity.near_pairs(df, "v", "i", "e", 0.05).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 1000
        home, visits = proximity.placed(df, "v", "i", "e", 0.05)
        members = {r.cell: r.c for r in home.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}
        tested[n] = sum(members.get(r.cell, 0) for r in visits.collect())
    # Twice the vectors: less than four times the comparisons, which are far fewer than all.
    assert tested[600] < 3.6 * tested[300] and tested[600] < 0.5 * 600 * 600


def test_connected_on_paths_and_stars(spark):
    from reelgrid.operators import proximity

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.name for r in proximity.connected(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    names = [{out[i] for i in part} for part in (range(61), range(100, 140), (200, 201))]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == 3 and len(out) == 61 + 40 + 2


def test_density_against_every_event(spark):
    import math

    events = [(1, 0.0), (1, 3.0), (1, 3.0), (1, 400.0), (2, 10.0)]
    grid = [(v, float(t)) for v in (1, 2, 3) for t in range(0, 420, 7)]
    out = got(sequences.density(spark.createDataFrame(grid, "v int, t double"), spark.createDataFrame(events, "v int, a double"), "v", "t", "a", 4.0), "v", "t", "y")
    want = []
    for v in (1, 2):
        own = [a for k, a in events if k == v]
        y = {t: sum(math.exp(-(((t - a) / 4.0) ** 2) / 2) for a in own) / len(own) for k, t in grid if k == v}
        low, high = min(y.values()), max(y.values())
        want += [(v, t, (x - low) / (high - low)) for t, x in y.items()]
    assert [r[:2] for r in out] == [r[:2] for r in sorted(want, key=repr)]
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(out, sorted(want, key=repr), strict=True))


def test_interpolation_between_observations(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 5.0), (1, 5, 4.0, 2.0), (1, 4, None, 1.0), (2, 7, 3.0, 3.0)], "v int, t int, x double, y double")
    assert got(sequences.interpolated(df, "v", "t", ["x", "y"]), "v", "t", "x", "y") == [(1, 2, 1.0, 5.0), (1, 3, 2.0, 4.0), (1, 4, 3.0, 3.0), (1, 5, 4.0, 2.0), (2, 7, 3.0, 3.0)]


def test_one_very_long_text_and_vector(spark):
    """Chunks and shares cost the length of their row, not its square."""
    text = " ".join("word%d" % (i % 97) for i in range(100_000))
    df = spark.createDataFrame([(text, [float(i % 5) for i in range(20_000)])], "s string, v array<double>")
    began = time.perf_counter()
    r = df.select(T.word_chunks(F.col("s")).alias("w"), T.char_chunks(F.col("s")).alias("c"), V.softmax(F.col("v")).alias("p"), V.l2_normalise(F.col("v")).alias("n"), V.l1_normalise(F.col("v")).alias("q")).first()
    assert time.perf_counter() - began < 20
    assert len(r.w) == 782 and " ".join(r.w) == text and " ".join(r.c) == text
    assert all(len(c) <= 128 for c in r.c) and all(len(a) + 1 + len(b.split()[0]) > 128 for a, b in zip(r.c, r.c[1:], strict=False))
    assert sum(r.p) == pytest.approx(1) and sum(r.q) == pytest.approx(1) and sum(x * x for x in r.n) == pytest.approx(1)


def test_diverse_terms_against_plain_code(spark):
    from reelgrid.operators import topics

    rows = [("a", "rain", 9.0), ("a", "rains", 8.9), ("a", "sun", 5.0), ("a", "wind", 4.0), ("b", "x", 1.0)]
    out = got(topics.diverse_terms(spark.createDataFrame(rows, "t string, term string, score double").withColumn("tf", F.lit(1)), "t", 0.7, k=3), "t", "pick", "term")

    def grams(t):
        return {t[i : i + 2] for i in range(max(1, len(t) - 1))}

    def plain(items, k):
        done = []
        while items and len(done) < k:
            worth = lambda x: 0.3 * x[1] / 9.0 - 0.7 * max([len(grams(x[0]) & grams(d)) / len(grams(x[0]) | grams(d)) for d in done], default=0.0)
            done.append(max(items, key=worth)[0])
            items = [x for x in items if x[0] not in done]
        return done

    assert out == [("a", i, w) for i, w in enumerate(plain([(w, s) for t, w, s in rows if t == "a"], 3))] + [("b", 0, "x")]


def test_clusters_on_principal_axes(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 12)) * 4
    rows = [(1, i, (centres[i % 3] + rng.normal(size=12) * 0.1).tolist()) for i in range(30)] + [(1, 30, (rng.normal(size=12) * 4).tolist())]
    df = spark.createDataFrame(rows, "v int, i int, e array<double>")
    out = {r.i: r.cluster for r in tracking.cluster_reduced(df, "v", "i", "e", 0.2, 0.95).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c)
    order = np.argsort(values)[::-1]
    n = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.95)) + 1
    y = c @ axes[:, order[:n]]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 1 - y @ y.T <= 0.2
    reach = np.linalg.matrix_power((near | np.eye(31, dtype=bool)).astype(float), 8) > 0
    for i in range(31):
        for j in range(31):
            if i != j:
                assert reach[i, j] == (out[i] == out[j] != -1)
    assert n < 12 and len(set(out.values()) - {-1}) >= 3


def test_ensembles_learn_their_teacher(spark):
    from reelgrid.operators import classify

    df = spark.range(600).select("id", F.array((F.col("id") % 40).cast("double"), (F.col("id") % 7).cast("double")).alias("f"), F.when(F.col("id") % 40 < 10, 0).when(F.col("id") % 7 < 3, 1).otherwise(2).alias("label"))
    models = [("f", classify.fit_ensemble(df.where("id % 2 = 0"), "f", "label", kind, trees=5, depth=4)) for kind in ("forest", "boosted", "tree")]
    votes = classify.ensemble_votes(df, models, ["id"])
    assert votes.count() == 1800
    voted = fusion.voted_labels(votes.withColumnRenamed("id", "video_id").withColumn("idx", F.lit(0)), {0: "x", 1: "y", 2: "z"}, confidence=0.5)
    right = voted.join(df, voted.video_id == df.id).where(F.col("name") == F.element_at(F.array(*map(F.lit, "xyz")), F.col("label") + 1)).count()
    assert right >= 580
    with pytest.raises(ValueError):
        classify.fit_ensemble(df, "f", "label", "none")


def test_graph_pages_hold_closing_tags(spark):
    n = spark.createDataFrame([("v", "a</script>", {"t": "x\"<&"})], "video_id string, id string, attrs map<string,string>")
    e = spark.createDataFrame([("v", "a</script>", "b", 1.5)], "video_id string, src string, dst string, weight double")
    pages = sinks.graph_pages(n, e)
    assert pages.first().html.count("</script>") == 2
    assert got(readers.parsed_pages(pages, "video_id", "html"), "kind", "id", "dst", "attr", "value") == [("edge", "a</script>", "b", "weight", "1.5"), ("node", "a</script>", None, "t", 'x"<&')]
    assert got(readers.parsed_graphs(sinks.graph_documents(n, e), "video_id", "xml"), "kind", "attr", "type", "value") == [("edge", "weight", "double", "1.5"), ("node", "t", "string", 'x"<&')]


def test_graph_documents_are_dealt_to_tasks_and_read_whole(spark):
    n = spark.range(4000).selectExpr("id % 16 AS video_id", "concat('n', id) AS id", "map('t', concat(' ', id, ' ')) AS attrs")
    e = spark.range(4000).selectExpr("id % 16 AS video_id", "concat('n', id) AS src", "'hub' AS dst", "cast(id AS double) AS weight")
    docs = sinks.graph_documents(n, e)
    assert docs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    want = [(r.video_id, "node", r.id, None, "t", "string", r.attrs["t"]) for r in n.collect()] + [(r.video_id, "edge", r.src, "hub", "weight", "double", str(r.weight)) for r in e.collect()]
    read = [tuple(r) for r in readers.parsed_graphs(docs, "video_id", "xml").collect()]
    assert sorted(read, key=str) == sorted(want, key=str)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<graphml><graph><node id='a'><data key='x'>1</data></node></graph>"), (4, "<graphml><graph><node id='a'><data key='x'>1</data></node></graph></graphml>")], "k long, xml string")
    assert [tuple(r) for r in readers.parsed_graphs(odd, "k", "xml").collect()] == [(4, "node", "a", None, None, None, "1")]


def test_terms_are_dealt_by_term_from_texts_that_are_dealt_out(spark, monkeypatch):
    from collections import Counter

    from reelgrid.operators import topics

    monkeypatch.setattr(topics, "TERMS", 3)
    rows = [("a", "One two the one two"), ("a", "two one"), ("b", "one"), ("b", None), ("b", ""), (None, "two x two")] * 3
    counts = topics.term_counts(spark.createDataFrame(rows, "topic string, text string").coalesce(1), "topic", "text", ["the"])
    want = Counter()
    for t, text in rows:
        w = [x for x in (text or "").lower().split() if len(x) > 1 and x != "the"]
        want.update((t, x) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    assert {(r.topic, r.term): r.tf for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "RoundRobinPartitioning" in plan and plan.count("hashpartitioning") == 1


def test_annotated_texts_are_dealt_out(spark):
    from reelgrid.operators.annotate import name_spans

    texts = spark.createDataFrame([(i, f"the red fox {i}") for i in range(40)], "id long, text string").coalesce(1)
    spans = name_spans(texts, "id", "text", spark.createDataFrame([("red fox",)], "name string"))
    assert spans.count() == 40 and spans.select(F.spark_partition_id()).distinct().count() > 1
