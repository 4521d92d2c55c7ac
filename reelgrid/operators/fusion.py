"""Fused products: faces, active speakers, turn features, roles.

Each takes artifact tables that share ``video_id`` and covers all videos in one
plan. Times of one call share a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.numeric import overlap_share
from reelgrid.functions.vectors import bound, l1_normalise
from reelgrid.operators.aggregates import ensemble_vote, evenly_spaced, longest_visible
from reelgrid.operators.intervals import left_fusion, overlap_join, point_join
from reelgrid.operators.sequences import window_start
from reelgrid.sources.staging import written


def face_analysis(faces: DataFrame, tracks: DataFrame, clusters: DataFrame, gaze: DataFrame, speaking: DataFrame, emotions: DataFrame) -> DataFrame:
    """Each detected face with its track, cluster, gaze, speech and emotion.

    faces(video_id, face_id, ...), tracks(video_id, face_id, track_id),
    clusters(video_id, face_id, cluster_id), gaze(video_id, face_id, gaze),
    speaking(video_id, track_id, speaking, speaking_ratio, speaking_frames),
    emotions(video_id, face_id, emotions). Absent parts are null, a face
    without a scored track doesn't speak, cluster -1 is no cluster.
    """
    on = ["video_id", "face_id"]
    known = clusters.withColumn("cluster_id", F.when(F.col("cluster_id") >= 0, F.col("cluster_id")))
    parts = [(tracks, on, {}), (known, on, {}), (gaze, on, {}), (speaking, ["video_id", "track_id"], {"speaking": False, "speaking_ratio": 0.0, "speaking_frames": 0}), (emotions, on, {})]
    return left_fusion(faces, parts)


def face_count_check(faces: DataFrame, gaze: DataFrame, emotions: DataFrame, least_score: float = 0.6, least_height: float = 0.05) -> DataFrame:
    """(video_id, faces, gaze, emotions, ok): good faces must have one row of gaze and one of emotion each."""
    good = faces.where((F.col("det_score") >= least_score) & (F.col("bbox.h") > least_height))
    n = lambda df, name: df.select("video_id", F.lit(name).alias("part"))
    counts = n(good, "faces").union(n(gaze, "gaze")).union(n(emotions, "emotions")).groupBy("video_id").pivot("part", ["faces", "gaze", "emotions"]).count().fillna(0)
    return counts.withColumn("ok", (F.col("faces") == F.col("gaze")) & (F.col("faces") == F.col("emotions")))


def speaker_turns_meta(turns: DataFrame, faces: DataFrame, roles: DataFrame, situations: DataFrame, width: float, threshold: float = 0.5, n_rows: int | None = None) -> DataFrame:
    """Turns with the face that speaks longest in them, their role and situation.

    turns(video_id, idx, start, end, speaker), faces(video_id, time, face_id,
    cluster_id, speaking), roles(video_id, idx, role_l0, role_l1),
    situations(video_id, idx, situation). A turn is active if the extent of the
    face passes ``threshold`` of the turn; turns without length have no ratio;
    turns without a speaking face are inactive with ratio 0 and no face.
    With ``n_rows``, the number of faces, faces and turns are dealt to as many
    tasks as these need.
    """
    seen = faces.where("speaking").select("video_id", "time", "cluster_id", "face_id")
    hits = point_join(seen, turns.select("video_id", "idx", "start", "end"), "video_id", "time", "start", "end", width, n_rows=n_rows)
    best = longest_visible(hits, ["video_id", "idx", "start", "end"], "cluster_id", "time", n_rows, ["video_id", "idx"], [] if n_rows is None else ["_bl", "_bb"])
    extent = F.col("last_seen") - F.col("first_seen")
    face = F.struct(F.col("first_seen").alias("first_appearance"), F.col("last_seen").alias("last_appearance"), F.col("cluster_id"))
    found = best.select("video_id", "idx", F.when(F.col("end") > F.col("start"), extent / (F.col("end") - F.col("start"))).alias("active_ratio"), face.alias("face"))
    out = turns.join(found, ["video_id", "idx"], "left").join(roles, ["video_id", "idx"], "left").join(situations, ["video_id", "idx"], "left")
    ratio = F.when(F.col("face").isNull(), F.lit(0.0)).otherwise(F.col("active_ratio"))
    return out.withColumn("active_ratio", ratio).withColumn("active", F.coalesce(F.col("active_ratio") > threshold, F.lit(False)))


def _points_met(labels: DataFrame, density: DataFrame, extents: DataFrame, width: float) -> DataFrame:
    """(video_id, idx, _labels, _ys): labelled values and densities in each closed extent as arrays, met in one join."""
    none = F.lit(None).cast("double")
    both = labels.select("video_id", "t", "l", "value", none.alias("y")).unionByName(density.select("video_id", "t", F.lit(0).alias("l"), none.alias("value"), F.col("y").cast("double").alias("y")))
    hits = point_join(both, extents.select("video_id", "idx", "h_start", "h_end"), "video_id", "t", "h_start", "h_end", width)
    kept = lambda own, *cols: F.collect_list(F.when(own, F.struct("t", *cols)))
    return hits.groupBy("video_id", "idx").agg(kept(F.col("l") > 0, "l", "value").alias("_labels"), kept(F.col("l") == 0, "y").alias("_ys"))


def _segments_met(shots: DataFrame, sentiment: DataFrame, firsts: list[DataFrame], sent: list[str], extents: DataFrame, width: float, least: float = 0.7) -> DataFrame:
    """(video_id, idx, _shots, _sent, _first0, ...): shots and sentiment that overlap each extent as arrays, met in one join.

    Each of ``firsts``, segments with ``idx`` and ``vector``, gives the key (_seq, s, e) of the first segment of
    which more than ``least`` lies in the turn and whose vector isn't all zero; ``_vectors_of`` has its vector.
    """
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    rows = lambda df, kind: df.withColumn("_kind", F.lit(kind))
    every = rows(shots.select("video_id", "s", "e"), 0).unionByName(rows(sentiment.select("video_id", "s", "e", *[F.col(c).cast("double").alias(c) for c in sent]), 1), True)
    for i, df in enumerate(firsts):
        every = every.unionByName(rows(df.where(total != 0).select("video_id", "s", "e", F.col("idx").alias("_seq")), i + 2), True)
    hits = overlap_join(every, extents, "video_id", "s", "e", "h_start", "h_end", width)
    kind = lambda k: F.col("_kind") == k
    inside = overlap_share(F.col("s"), F.col("e"), F.col("start"), F.col("end")) > least
    return hits.groupBy("video_id", "idx").agg(
        F.collect_list(F.when(kind(0), F.struct("s", "e"))).alias("_shots"), F.collect_list(F.when(kind(1), F.struct("s", "e", *sent))).alias("_sent"),
        *[F.min(F.when(kind(i + 2) & inside, F.struct("_seq", "s", "e"))).alias(f"_first{i}") for i in range(len(firsts))],
    )


def _vectors_of(segments: DataFrame, first: str, out: str) -> DataFrame:
    """(video_id, first, out): the vector at each key of ``_segments_met``; vectors join after the first is known."""
    return segments.select("video_id", F.struct(F.col("idx").alias("_seq"), "s", "e").alias(first), F.col("vector").alias(out)).dropDuplicates(["video_id", first])


def _mean(values: Column) -> Column:
    """Mean of an array's values that are not null; null without one."""
    return bound(F.filter(values, lambda v: v.isNotNull()), lambda known: F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known)))


def turn_features(turns: DataFrame, labels: DataFrame, density: DataFrame, shots: DataFrame, sentiment: DataFrame, pos: DataFrame, ner: DataFrame, context: DataFrame, label_order: list[str], window_lengths: list, width: float, snap=None, least_length=1.0) -> DataFrame:
    """(video_id, idx, seg_feature, sw_feature): features of a whole turn, and of windows in it.

    Order of the first: label means, length, density, shots, sentiment (3),
    part-of-speech shares, entity flags, context similarities. The second has,
    for each window length, label means, density, the 0.8 quantile of each
    sentiment and shots, averaged over windows, then the rest of the first.
    A turn first gathers the points and segments in its whole extent.
    Turns shorter than ``least_length`` have zeros throughout; so has whatever
    isn't found. Part-of-speech and entity inputs are taken as named.
    """
    long = turns.where(F.col("end") - F.col("start") >= least_length)
    begin = window_start("start", snap)
    extents = written(long.select("video_id", "idx", "start", "end", F.least("start", begin).alias("h_start"), F.col("end").alias("h_end")), "extents")
    sent = ["positive", "negative", "neutral"]
    known = labels.select("video_id", "t", F.array_position(F.array(*map(F.lit, label_order)), F.col("label")).cast("int").alias("l"), F.col("value").cast("double").alias("value")).where("l > 0")
    on = ["video_id", "idx"]
    firsts = ["_first0", "_first1"]
    met = extents.select(*on, "start", "end").join(_points_met(known, density, extents, width), on, "left").join(_segments_met(shots, sentiment, [pos, ner], sent, extents, width), on, "left")
    # Windows are made in the rows of their turns, which hold all that a window can meet, so no window is shuffled.
    window = lambda length, a, z: F.struct(F.lit(float(length)).alias("length"), a.cast("double").alias("w_start"), z.cast("double").alias("w_end"))

    def cut(x):
        numbers = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("end") - begin) / x) - 1)
        return F.transform(numbers, lambda i: window(x, begin + i * x, F.least(begin + i * x + x, F.col("end"))))

    windows = [F.array(window(0, F.col("start"), F.col("end"))), *map(cut, window_lengths)]
    each = met.withColumn("_win", F.explode(F.concat(*windows))).select("video_id", "idx", "_win.*", "_labels", "_ys", "_shots", "_sent", *firsts)
    of_label = lambda i: F.filter("_labels", lambda p: p["l"] == i)["value"]
    inside = lambda p: (p["t"] >= F.col("w_start")) & (p["t"] <= F.col("w_end"))
    over = lambda g: ~((g["e"] <= F.col("w_start")) | (g["s"] >= F.col("w_end")))
    share = lambda g: overlap_share(g["s"], g["e"], F.col("w_start"), F.col("w_end"))
    each = each.select(
        "video_id", "idx", *firsts, "length", F.filter("_labels", inside).alias("_labels"), F.filter("_ys", inside)["y"].alias("_ys"),
        F.size(F.filter(F.coalesce("_shots", F.array()), over)).alias("n_shots"), F.filter("_sent", lambda g: over(g) & (share(g) >= 0.8)).alias("_sent"),
    )
    each = each.select(
        "video_id", "idx", *firsts, "length", "n_shots", _mean(F.col("_ys")).alias("_density"), *[_mean(F.col("_sent")[c]).alias(c) for c in sent],
        *[_mean(of_label(i + 1)).alias(x) for i, x in enumerate(label_order)],
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    labelled = [F.coalesce(F.avg(F.col(f"`{x}`")), F.lit(0.0)) for x in label_order]
    pooled = each.groupBy("video_id", "idx", "length").agg(
        F.array(*labelled, F.avg(zero("_density"))).alias("_a"), F.array(*[F.percentile(zero(c), 0.8) for c in sent]).alias("_q"), F.array(*[F.avg(zero(c)) for c in sent]).alias("_s"), F.avg(zero("n_shots")).alias("_n"),
        *[F.min(c).alias(c) for c in firsts],
    )
    n = len(label_order)
    by_length = pooled.groupBy("video_id", "idx").agg(
        F.max_by(F.struct("_a", "_s", "_n"), F.when(F.col("length") == 0, 1)).alias("_w"),
        F.flatten(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("length", "_a", "_q", "_n"))), lambda x: x["length"] > 0), lambda x: F.concat(x["_a"], x["_q"], F.array(x["_n"])))).alias("_windows"),
        *[F.min(c).alias(c) for c in firsts],
    )
    tags = _vectors_of(pos, "_first0", "_pos").withColumn("_pos", l1_normalise(F.col("_pos")))
    flags = _vectors_of(ner, "_first1", "_ner").withColumn("_ner", F.transform("_ner", lambda x: (x > 0).cast("double")))
    out = turns.join(by_length, on, "left").join(tags, ["video_id", "_first0"], "left").join(flags, ["video_id", "_first1"], "left").join(context.select(*on, F.col("context").cast("array<double>").alias("_ctx")), on, "left")
    sizes = {"_pos": 14, "_ner": 6, "_ctx": 6}
    rest = F.concat(*[F.coalesce(c, F.array_repeat(F.lit(0.0), k)) for c, k in sizes.items()])
    length = F.array(F.col("end").cast("double") - F.col("start"))
    whole_vec = F.concat(F.slice("_w._a", 1, n), length, F.array(F.element_at("_w._a", n + 1), F.col("_w._n")), F.col("_w._s"), rest)
    seg = F.when(F.col("_w").isNotNull(), whole_vec).otherwise(F.array_repeat(F.lit(0.0), n + 6 + sum(sizes.values())))
    sw = F.when(F.col("_w").isNotNull(), F.concat("_windows", length, rest)).otherwise(F.array_repeat(F.lit(0.0), len(window_lengths) * (n + 5) + 1 + sum(sizes.values())))
    return out.select(*on, seg.alias("seg_feature"), sw.alias("sw_feature"))


def voted_labels(votes: DataFrame, names: dict, confidence: float = 0.7, unsure: str = "unsure") -> DataFrame:
    """(video_id, idx, name, confidence) from votes(video_id, idx, model, label), segment models numbered first."""
    v = ensemble_vote(votes, ["video_id", "idx"], "model", "label", confidence)
    name: Column = F.lit(unsure)
    for k, text in names.items():
        name = F.when(F.col("label") == k, F.lit(text)).otherwise(name)
    return v.select("video_id", "idx", name.alias("name"), "confidence")


def angle_sample(frames: DataFrame, faces: DataFrame, by: str, tolerance: float, max_angle: float, step: float, n: int, inclusive: bool = False) -> DataFrame:
    """Faces nearest to frames in time, small angles only, binned in two directions, and ``n`` of each pair of bins in even steps.

    frames(by, frame, t), faces(by, face_t, theta_x, theta_y, score, height).
    ``inclusive`` also drops angles equal to ``max_angle``.
    """
    from reelgrid.functions.numeric import angle_bin
    from reelgrid.operators.intervals import nearest

    near = nearest(frames, faces, by, "t", "face_t", ["theta_x", "theta_y", "score", "height"], tolerance).where(F.col("face_t").isNotNull())
    big = (lambda c: F.abs(c) >= max_angle) if inclusive else (lambda c: F.abs(c) > max_angle)
    good = near.where(~big(F.col("theta_x")) & ~big(F.col("theta_y")) & (F.col("score") >= 0.85) & (F.col("height") >= 0.1))
    binned = good.withColumn("bin_x", angle_bin(F.col("theta_x"), step)).withColumn("bin_y", angle_bin(F.col("theta_y"), step))
    return evenly_spaced(binned, [by, "frame"], n, ["bin_x", "bin_y"]).drop("rank")
