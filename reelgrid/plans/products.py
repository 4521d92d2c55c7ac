"""Fused products, annotation documents and event windows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions.models import SLOTS, apply_models
from reelgrid.operators import classify, fusion, tiers
from reelgrid.plans import adapters as A
from reelgrid.plans.registry import query, table
from reelgrid.sources import readers, sinks
from reelgrid.sources.staging import staging, written
from reelgrid.streaming import events as V


def _turns(spark, sf):
    return A.intervals(spark, sf).selectExpr("video_id", "seg_id AS idx", "s AS start", "e AS end", "concat('spk', seg_id % 5) AS speaker")


@query(
    "speaker_turns_meta",
    f"""
    WITH {A.INTERVALS},
    f AS (SELECT o_custkey AS video_id, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 5 END AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'),
    h AS (SELECT v.video_id, seg_id, s, e, c, min(t) AS a, max(t) AS b FROM intervals v JOIN f ON f.video_id = v.video_id AND f.t BETWEEN v.s AND v.e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_id ORDER BY (c IS NOT NULL) DESC, b - a DESC, a DESC, c DESC) AS rn FROM h)
    SELECT v.video_id, v.seg_id AS idx, CASE WHEN r.seg_id IS NULL THEN 0.0::DOUBLE WHEN v.e > v.s THEN CAST(r.b - r.a AS DOUBLE) / (v.e - v.s) END AS active_ratio,
           coalesce(CASE WHEN r.seg_id IS NOT NULL AND v.e > v.s THEN CAST(r.b - r.a AS DOUBLE) / (v.e - v.s) END > 0.5, false) AS active, r.a AS first_appearance, r.b AS last_appearance, r.c AS cluster_id,
           'role' || (v.seg_id % 3) AS role_l1, CASE WHEN v.seg_id % 2 = 0 THEN 'studio' END AS situation
    FROM intervals v LEFT JOIN r ON r.video_id = v.video_id AND r.seg_id = v.seg_id AND rn = 1
    """,
)
def speaker_turns_meta(spark, sf):
    """Turns with their active face, role and situation: J3, J4, A14-A16."""
    turns = _turns(spark, sf)
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    faces = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("video_id"), F.unix_date(F.col("l_shipdate").cast("date")).alias("time"), F.col("l_partkey").alias("face_id"), F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 5 END").alias("cluster_id"), (F.col("l_returnflag") != "N").alias("speaking")
    )
    roles = turns.selectExpr("video_id", "idx", "'x' AS role_l0", "concat('role', idx % 3) AS role_l1")
    situations = turns.where("idx % 2 = 0").selectExpr("video_id", "idx", "'studio' AS situation")
    m = fusion.speaker_turns_meta(turns, faces, roles, situations, 365, n_rows=li.count())
    face = [F.col(f"face.{c}").cast("long").alias(c) for c in ("first_appearance", "last_appearance", "cluster_id")]
    return m.select("video_id", "idx", "active_ratio", "active", *face, "role_l1", "situation")


@query(
    "face_analysis",
    """
    SELECT c_custkey AS face_id, CASE WHEN c_custkey % 3 <> 0 THEN 'T' || (c_custkey % 20) END AS track_id, CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS cluster_id,
           CASE WHEN c_acctbal > 0 THEN c_acctbal END AS gaze, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 20 < 10 END, false) AS speaking, c_mktsegment AS emotions
    FROM customer
    """,
)
def face_analysis(spark, sf):
    """J1 as a product: faces with track, cluster, gaze, speech, emotion."""
    c = table(spark, sf, "customer").selectExpr("'v' AS video_id", "c_custkey AS face_id", "c_nationkey", "c_acctbal", "c_mktsegment")
    part = lambda *cols: c.selectExpr("video_id", "face_id", *cols)
    tracks = c.where("face_id % 3 <> 0").selectExpr("video_id", "face_id", "concat('T', face_id % 20) AS track_id")
    asd = tracks.selectExpr("video_id", "track_id", "cast(substring(track_id, 2) AS int) < 10 AS speaking").distinct().withColumns({"speaking_ratio": F.lit(1.0), "speaking_frames": F.lit(1)})
    out = fusion.face_analysis(part(), tracks, part("CASE WHEN c_nationkey >= 5 THEN c_nationkey ELSE -1 END AS cluster_id"), part("c_acctbal AS gaze").where("gaze > 0"), asd, part("c_mktsegment AS emotions"))
    return out.select("face_id", "track_id", "cluster_id", "gaze", "speaking", "emotions")


TURN_FEATURES = f"""WITH {A.INTERVALS}, {A.POINTS},
    v AS (SELECT video_id, seg_id AS idx, s::DOUBLE AS s, e::DOUBLE AS e FROM intervals WHERE e > s),
    l AS (SELECT * FROM v WHERE e - s >= 1),
    w AS (SELECT video_id, idx, 0 AS length, 0::BIGINT AS win, s AS ws, e AS we FROM l
          UNION ALL SELECT video_id, idx, length, win, s + win * length, least(s + win * length + length, e) FROM (SELECT *, unnest(generate_series(0, CAST(ceil((e - s) / length) AS BIGINT) - 1)) AS win FROM l, (VALUES (180), (365)) x(length))),
    m AS (SELECT w.video_id, idx, length, win, avg(value / 50) FILTER (label = 'A') AS la, avg(value / 50) FILTER (label = 'N') AS ln, avg(value / 50) FILTER (label = 'R') AS lr, coalesce(avg(value / 50), 0) AS d
          FROM w LEFT JOIN points p ON p.video_id = w.video_id AND p.t BETWEEN ws AND we GROUP BY 1, 2, 3, 4),
    h AS (SELECT w.video_id, w.idx, length, win, count(v.idx) AS shots FROM w LEFT JOIN v ON v.video_id = w.video_id AND v.s < we AND v.e > ws GROUP BY 1, 2, 3, 4),
    f AS (SELECT w.*, v.idx AS seg, (least(v.e, we) - greatest(v.s, ws)) / (v.e - v.s) AS share FROM w JOIN v ON v.video_id = w.video_id AND v.s < we AND v.e > ws),
    z AS (SELECT video_id, idx, length, win, avg(seg % 7 / 7.0) AS p, avg(seg % 5 / 5.0) AS n, avg(seg % 3 / 3.0) AS u FROM f WHERE share >= 0.8 GROUP BY 1, 2, 3, 4),
    a AS (SELECT video_id, idx, length, [coalesce(avg(la), 0), coalesce(avg(ln), 0), coalesce(avg(lr), 0)] AS lab, avg(d) AS d,
                 [quantile_cont(coalesce(p, 0), 0.8), quantile_cont(coalesce(n, 0), 0.8), quantile_cont(coalesce(u, 0), 0.8)] AS q, [avg(coalesce(p, 0)), avg(coalesce(n, 0)), avg(coalesce(u, 0))] AS s, avg(shots) AS shots
          FROM m JOIN h USING (video_id, idx, length, win) LEFT JOIN z USING (video_id, idx, length, win) GROUP BY 1, 2, 3),
    g AS (SELECT video_id, idx, min(seg) FILTER (seg % 3 <> 0) AS tag, min(seg) AS flag FROM f WHERE length = 0 AND share > 0.7 GROUP BY 1, 2),
    r AS (SELECT l.video_id, l.idx, l.e - l.s AS len,
                 [CASE WHEN tag IS NULL THEN 0.0 ELSE (i * tag % 3) / 15.0 END for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]] AS pos,
                 [CASE WHEN flag IS NULL THEN 0.0 ELSE ((i + flag) % 2)::DOUBLE END for i in [1, 2, 3, 4, 5, 6]] AS ner, [(l.idx % (i + 1)) / 8.0 for i in [1, 2, 3, 4, 5, 6]] AS ctx
          FROM l LEFT JOIN g USING (video_id, idx)),
    o AS (SELECT r.video_id, r.idx, list_concat(list_concat(list_concat(a0.lab, [len, a0.d, a0.shots]), a0.s), list_concat(list_concat(pos, ner), ctx)) AS seg,
                 list_concat(list_concat(list_concat(list_concat(a1.lab, [a1.d]), list_concat(a1.q, [a1.shots])), list_concat(list_concat(a2.lab, [a2.d]), list_concat(a2.q, [a2.shots]))), list_concat([len], list_concat(list_concat(pos, ner), ctx))) AS sw
          FROM r JOIN a a0 ON a0.video_id = r.video_id AND a0.idx = r.idx AND a0.length = 0 JOIN a a1 ON a1.video_id = r.video_id AND a1.idx = r.idx AND a1.length = 180 JOIN a a2 ON a2.video_id = r.video_id AND a2.idx = r.idx AND a2.length = 365)
    SELECT video_id, idx, array_to_string([CAST(round(x * 10000 + 0.0137) AS BIGINT) for x in seg], ',') AS seg_feature, array_to_string([CAST(round(x * 10000 + 0.0137) AS BIGINT) for x in sw], ',') AS sw_feature FROM o
    """


def _turn_features(spark, sf):
    v = written(A.intervals(spark, sf).where("e > s").selectExpr("video_id", "seg_id AS idx", "cast(s AS double) AS start", "cast(e AS double) AS end"), "turns")
    p = written(A.points(spark, sf).selectExpr("video_id", "cast(t AS double) AS t", "value / 50 AS value", "label"), "points")
    seg = v.selectExpr("video_id", "start AS s", "end AS e", "idx")
    sent = seg.selectExpr("video_id", "s", "e", "idx % 7 / 7 AS positive", "idx % 5 / 5 AS negative", "idx % 3 / 3 AS neutral")
    pos = seg.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: (i * F.col("idx")) % 3))
    ner = seg.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i + F.col("idx")) % 2))
    ctx = v.select("video_id", "idx", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.col("idx") % (i + 1)) / 8.0).alias("context"))
    return fusion.turn_features(v, p, p.select("video_id", "t", F.col("value").alias("y")), seg.select("video_id", "s", "e"), sent, pos, ner, ctx, ["A", "N", "R"], [180.0, 365.0], 365)


@query("turn_feature_vectors", TURN_FEATURES)
def turn_feature_vectors(spark, sf):
    """All values of the role and situation features of turns, in ten-thousandths."""
    # The shift keeps values off the ties of rounding.
    digits = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 10000 + 0.0137).cast("long").cast("string")), ",").alias(c)
    return _turn_features(spark, sf).select("video_id", "idx", digits("seg_feature"), digits("sw_feature"))


def _voted(spark, sf, names, label):
    """Two ensembles fitted on the turns of even videos, a forest over whole turns and a tree over windows, voting on all turns."""
    path = staging(spark, "turn_features")
    _turn_features(spark, sf).withColumn("label", label).write.parquet(path)
    turns = spark.read.schema("video_id long, idx long, seg_feature array<double>, sw_feature array<double>, label int").parquet(path)
    known = turns.where("video_id % 2 = 0")
    models = [("seg_feature", classify.fit_ensemble(known, "seg_feature", "label")), ("sw_feature", classify.fit_ensemble(known, "sw_feature", "label", "tree"))]
    return fusion.voted_labels(classify.ensemble_votes(turns, models, ["video_id", "idx"]), names)


@query("turn_roles")
def turn_roles(spark, sf):
    """Voted roles of turns from tree ensembles; fitted models, so a test holds them against their teacher."""
    label = F.when(F.element_at("seg_feature", 4) < 60, 0).when(F.element_at("seg_feature", 6) < 2, 1).otherwise(2)
    return _voted(spark, sf, {0: "anchor", 1: "reporter", 2: "guest"}, label)


@query("turn_situations")
def turn_situations(spark, sf):
    """Voted situations of turns from tree ensembles; as turn_roles."""
    return _voted(spark, sf, {0: "studio", 1: "interview"}, (F.element_at("seg_feature", 6) > 1).cast("int"))


@query(
    "role_votes",
    """
    WITH v AS (SELECT o_custkey AS idx, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY idx) AS total, row_number() OVER (PARTITION BY idx ORDER BY n DESC, f) AS rn FROM v)
    SELECT idx, CASE WHEN n / total >= 0.7 THEN ['anchor', 'reporter', 'guest'][label + 1] ELSE 'unsure' END AS name, n / total AS confidence FROM t WHERE rn = 1
    """,
)
def role_votes(spark, sf):
    """A28 as a product: voted roles with names."""
    o = table(spark, sf, "orders").selectExpr("1 AS video_id", "o_custkey AS idx", "o_orderkey AS model", "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label")
    return fusion.voted_labels(o, {0: "anchor", 1: "reporter", 2: "guest"}).select("idx", "name", "confidence")


TIERS = """t AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id % 1000 / 8.0 AS s, event_id % 1000 / 8.0 + CAST(json_extract(props, '$.k') AS INT) / 16.0 AS e, event_type AS speaker, props AS text FROM events),
    m AS (SELECT *, CAST(trunc(s * 1000) AS BIGINT) AS start_ms, CAST(trunc(e * 1000) AS BIGINT) AS end_ms FROM t)"""


def _timed(spark, sf):
    return A.segments(spark, sf).join(
        table(spark, sf, "events").selectExpr("user_id AS video_id", "unix_micros(cast(ts AS timestamp)) AS start_us", "event_id"), ["video_id", "start_us"]
    ).select("video_id", "idx", (F.col("event_id") % 1000 / 8.0).alias("start"), (F.col("event_id") % 1000 / 8.0 + F.get_json_object("text", "$.k").cast("int") / 16.0).alias("end"), "speaker", "text")


@query(
    "annotation_tiers",
    f"""WITH {TIERS}
    SELECT video_id, 'shots' AS tier, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS VARCHAR) AS value FROM m WHERE start_ms <> end_ms
    UNION ALL SELECT video_id, 'speaker_turn', start_ms, end_ms, speaker FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'transcript', start_ms, end_ms, text FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'topic', start_ms, end_ms, CASE WHEN idx % 3 = 0 THEN 'topic' || idx % 7 ELSE 'None' END FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'active_speaker', start_ms, end_ms, CASE WHEN idx % 2 = 0 THEN 'Yes' ELSE 'No' END FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'speaker_role', start_ms, end_ms, 'role' FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'situation', start_ms, end_ms, 'studio' FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'speaker_audio_clf', start_ms, end_ms, CASE WHEN idx % 4 = 0 THEN '' ELSE 'Speech, ' || speaker END FROM m WHERE start_ms < end_ms
    UNION ALL SELECT video_id, 'speaker_audio_prob', start_ms, end_ms, CASE WHEN idx % 4 = 0 THEN '' ELSE '0.75, 0.25' END FROM m WHERE start_ms < end_ms""",
)
def annotation_tiers(spark, sf):
    """Shots, turns, topics and speakers as tiers in milliseconds."""
    t = _timed(spark, sf)
    topics = t.where("idx % 3 = 0").selectExpr("video_id", "idx", "concat('topic', idx % 7) AS topic")
    meta = t.selectExpr("*", "idx % 2 = 0 AS active", "'role' AS role_l1", "'studio' AS situation")
    top = F.when(F.col("idx") % 4 != 0, F.array(*[F.struct(x.alias("label"), F.lit(p).alias("prob")) for x, p in ((F.lit("Speech"), 0.75), (F.col("speaker"), 0.25))]))
    audio = tiers.audio_tiers(t.withColumn("top3", top), "speaker_audio")
    return tiers.shot_tier(t).unionByName(tiers.turn_tiers(t)).unionByName(tiers.topic_tier(t, topics)).unionByName(tiers.speaker_tiers(meta)).unionByName(audio)


@query(
    "frame_majority_tiers",
    f"""WITH {A.INTERVALS}, v AS (SELECT * FROM intervals WHERE e > s),
    f AS (SELECT o_custkey AS video_id, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t, l_returnflag AS label, l_orderkey * 10 + l_linenumber AS label_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    j AS (SELECT video_id, t, string_agg(label, '_' ORDER BY label_idx) AS joined FROM f GROUP BY 1, 2),
    c AS (SELECT v.video_id, seg_id, joined, count(*) AS n FROM v JOIN j ON j.video_id = v.video_id AND j.t BETWEEN s AND e GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_id ORDER BY n DESC, joined) AS rn FROM c)
    SELECT v.video_id, name AS tier, CAST(s AS BIGINT) * 1000 AS start_ms, CAST(e AS BIGINT) * 1000 AS end_ms, coalesce(joined, 'None') AS value FROM v LEFT JOIN b ON b.video_id = v.video_id AND b.seg_id = v.seg_id AND rn = 1, (VALUES ('social_roles'), ('locations'), ('events')) x(name)""",
)
def frame_majority_tiers(spark, sf):
    """K5: tiers of social roles, locations and events, each the majority over the frames of a shot."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    frames = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("video_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("t"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label_idx"))
    shots = A.intervals(spark, sf).where("e > s").selectExpr("video_id", "seg_id AS idx", "cast(s AS double) AS start", "cast(e AS double) AS end")
    parts = [tiers.majority_tier(shots, frames, name, 365) for name in ("social_roles", "locations", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "annotation_documents",
    f"""WITH {TIERS} SELECT video_id, tier, start_ms, end_ms, value FROM (
        SELECT video_id, 'speaker_turn' AS tier, start_ms, end_ms, speaker AS value FROM m WHERE start_ms < end_ms UNION ALL SELECT video_id, 'transcript', start_ms, end_ms, text FROM m WHERE start_ms < end_ms)""",
)
def annotation_documents(spark, sf):
    """Tiers written as annotation XML a video and read back."""
    docs = sinks.annotation_documents(tiers.turn_tiers(_timed(spark, sf)))
    return readers.parsed_annotations(docs, "video_id", "xml").select("video_id", "tier", "start_ms", "end_ms", "value")


@query(
    "annotation_categories",
    """
    SELECT category, label, count(*) AS total FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'story' WHEN p_size % 4 = 1 THEN 'FEP' END AS category, lower(p_type) AS label FROM part WHERE p_size % 4 <= 2) WHERE category IS NOT NULL GROUP BY 1, 2
    """,
)
def annotation_categories(spark, sf):
    """Imported tiers by category and label; turns and unknown tiers stay out."""
    name = F.expr("CASE p_size % 4 WHEN 0 THEN 'story' WHEN 1 THEN 'FEP' WHEN 2 THEN 'speaker_turn' ELSE 'other' END")
    t = table(spark, sf, "part").select(F.concat(name, F.lit(":"), F.col("p_type")).alias("tier"), F.col("p_name").alias("value"))
    return tiers.annotation_statistics(t)


def _graph(spark, sf):
    c = table(spark, sf, "customer")
    n = c.selectExpr("c_nationkey AS video_id", "c_name AS id", "map('type', c_mktsegment, 'region', cast(c_nationkey % 5 AS string)) AS attrs")
    e = c.selectExpr("c_nationkey AS video_id", "c_name AS src", "concat('hub <', c_custkey % 5, '>') AS dst", "cast(c_custkey AS double) / 4 AS weight")
    return n, e


GRAPH = """
    SELECT c_nationkey AS video_id, 'node' AS kind, c_name AS id, NULL::VARCHAR AS dst, 'type' AS attr, 'string' AS type, c_mktsegment AS value FROM customer
    UNION ALL SELECT c_nationkey, 'node', c_name, NULL, 'region', 'long', CAST(c_nationkey % 5 AS VARCHAR) FROM customer
    UNION ALL SELECT c_nationkey, 'edge', c_name, 'hub <' || (c_custkey % 5) || '>', 'weight', 'double', CAST(CAST(c_custkey AS DOUBLE) / 4 AS VARCHAR) FROM customer
    """


@query("graph_documents", GRAPH)
def graph_documents(spark, sf):
    """K3: one graph document a nation with typed attributes, read back."""
    docs = sinks.graph_documents(*_graph(spark, sf), types={"region": "long"})
    return readers.parsed_graphs(docs, "video_id", "xml")


@query("graph_pages", "SELECT video_id, kind, id, dst, attr, value FROM (" + GRAPH + ")")
def graph_pages(spark, sf):
    """K4: one self-contained page a graph, its data read back."""
    return readers.parsed_pages(sinks.graph_pages(*_graph(spark, sf)), "video_id", "html")


@query(
    "page_titles",
    r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages
    """,
)
def page_titles(spark, sf):
    """Fields of raw markup."""
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit("<p[ >]")).cast("long").alias("n_paragraphs")
    )


@query(
    "event_windows",
    """
    SELECT time_bucket(INTERVAL '6 hours', ts) AS w_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2
    """,
)
def event_windows(spark, sf):
    """Added: tumbling event-time windows; the same function runs on a stream."""
    e = V.with_event_time(table(spark, sf, "events"), "ts", "1 hour").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return V.window_counts(e, "ts", "event_type", "cents", "6 hours").select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", "total")


@query(
    "event_sessions",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL '8 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL '8 hours' AS s_end, count(*) AS n FROM s GROUP BY user_id, sid
    """,
)
def event_sessions(spark, sf):
    """Added: sessions closed by a gap; the same function runs on a stream."""
    e = V.with_event_time(table(spark, sf, "events"), "ts", "1 hour")
    s = V.sessions(e, "ts", "user_id", "8 hours")
    return s.select("user_id", F.col("s_start").cast("timestamp_ntz").alias("s_start"), F.col("s_end").cast("timestamp_ntz").alias("s_end"), "n")


def _slot_sql() -> str:
    """The stand-ins of all slots in SQL: bytes of an MD5 as units."""
    cols = []
    for name, (kind, labels) in SLOTS.items():
        h = f"md5('{name}:' || text)"
        unit = lambda i, h=h: f"(CAST('0x' || substr({h}, {2 * i + 1}, 2) AS INT) / 255.0)"
        if kind == "string":
            value = f"[{', '.join(f"'{x}'" for x in labels)}][CAST('0x' || substr({h}, 1, 12) AS BIGINT) % {len(labels)} + 1]"
        elif name == "transcribe":
            value = f"substr({h}, 1, 8) || ' S' || (CAST('0x' || substr({h}, 9, 1) AS INT) % 3)"
        elif name == "tag_text":
            value = "len(regexp_extract_all(text, '\\S+'))"
        elif name == "detect_faces":
            value = f"[{', '.join(f'round({unit(i)}, 5)' for i in range(5))}]"
        elif kind.startswith("array<struct"):
            total = " + ".join(f"({unit(i)} + 0.01)" for i in range(len(labels)))
            value = f"[{', '.join(f'round(({unit(i)} + 0.01) / ({total}), 5)' for i in range(len(labels)))}]"
        else:
            value = f"[{', '.join(f'round({unit(i)}, 5)' for i in range(8))}]"
        cols.append(f"CASE WHEN text IS NOT NULL THEN {value} END AS {name}")
    return f"SELECT doc_id, {', '.join(cols)} FROM documents"


@query("model_slots", _slot_sql())
def model_slots(spark, sf):
    """Each model slot with its stand-in, over whole texts, as numbers and labels of its result type."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("text").isNotNull().alias("known"))
    d = apply_models(d, {name: name for name in SLOTS}, F.col("text"), ["doc_id", "known"])
    # As the SQL rounds: scaled, to the nearest whole number, and back.
    five = lambda c: F.transform(c, lambda x: F.round(x.cast("double") * 100000) / 100000)
    shown = {
        "transcribe": F.concat(F.get("transcribe", F.lit(0))["text"], F.lit(" "), F.get("transcribe", F.lit(0))["speaker"]),
        "tag_text": F.size("tag_text").cast("long"),
        "detect_faces": five(F.array(*[F.get("detect_faces", F.lit(0))[x] for x in ("x", "y", "w", "h", "score")])),
    }
    for name, (kind, _) in SLOTS.items():
        if name not in shown:
            shown[name] = F.col(name) if kind == "string" else five(F.transform(name, lambda x: x["prob"])) if kind.startswith("array<struct") else five(F.col(name))
    return d.select("doc_id", *[F.when(F.col("known"), c).alias(n) for n, c in shown.items()])


@query(
    "calibration_sample",
    """
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value % 40 - 20 AS tx, CAST(event_id % 50 - 25 AS DOUBLE) AS ty FROM events),
    f AS (SELECT * FROM e WHERE event_type = 'click'), g AS (SELECT * FROM e WHERE event_type <> 'click'),
    p AS (SELECT f.user_id, f.event_id AS frame, f.t, g.t AS pt, g.tx AS px, g.ty AS py FROM f ASOF LEFT JOIN g ON f.user_id = g.user_id AND f.t >= g.t),
    n AS (SELECT f.event_id AS frame, g.t AS nt, g.tx AS nx, g.ty AS ny FROM f ASOF LEFT JOIN g ON f.user_id = g.user_id AND f.t < g.t),
    m AS (SELECT user_id, frame, t, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pt ELSE nt END AS ft, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN px ELSE nx END AS tx, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN py ELSE ny END AS ty FROM p JOIN n USING (frame)),
    b AS (SELECT user_id, frame, CAST(floor(abs(tx) / 2) AS BIGINT) AS bin_x, CAST(floor(abs(ty) / 2) AS BIGINT) AS bin_y FROM m WHERE abs(t - ft) <= 7200000000 AND abs(tx) <= 20 AND abs(ty) <= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin_x, bin_y ORDER BY user_id, frame) - 1 AS r, count(*) OVER (PARTITION BY bin_x, bin_y) AS n FROM b)
    SELECT user_id, frame, bin_x, bin_y FROM r WHERE n <= 5 OR r IN (SELECT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i))
    """,
)
def calibration_sample(spark, sf):
    """Faces nearest to frames, small angles, an even sample of each pair of bins."""
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    frames = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("frame"), "t")
    faces = e.where("event_type <> 'click'").select("user_id", F.col("t").alias("face_t"), (F.col("value") % 40 - 20).alias("theta_x"), (F.col("event_id") % 50 - 25).cast("double").alias("theta_y"), F.lit(0.9).alias("score"), F.lit(0.2).alias("height"))
    return fusion.angle_sample(frames, faces, "user_id", 7_200_000_000, 20, 2, 5).select("user_id", "frame", "bin_x", "bin_y")
