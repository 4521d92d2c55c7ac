"""Turns, spans, windows and other ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import sequences as S
from reelgrid.operators.dealing import dealt
from reelgrid.plans import adapters as A
from reelgrid.plans.registry import query, table

ISLANDS = f"""WITH {A.SEGMENTS},
    c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS NOT DISTINCT FROM lag(speaker) OVER w THEN 0 ELSE 1 END AS c FROM segments WINDOW w AS (PARTITION BY video_id ORDER BY start_us, idx)),
    i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY video_id ORDER BY start_us, idx) AS BIGINT) AS island FROM c)"""


@query(
    "speaker_turns",
    f"""{ISLANDS},
    t AS (SELECT video_id, island AS turn, min(start_us) AS s, arg_max(end_us, idx) AS "end", min(speaker) AS speaker, string_agg(trim(text, ' '), ' ' ORDER BY idx) AS text,
                 CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM i GROUP BY 1, 2),
    b AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY turn) AS before FROM t)
    SELECT video_id, turn, CASE WHEN s - before <= 10000 THEN before + 10000 ELSE s END AS start, "end", speaker, text, n_words FROM b
    """,
)
def speaker_turns(spark, sf):
    """Canonical turns."""
    return S.speaker_turns(A.segments(spark, sf))


@query(
    "speaker_turns_gap",
    f"""{ISLANDS},
    r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id, island ORDER BY start_us, idx) = 1 THEN end_us ELSE end_us - 10000 END AS e2 FROM i),
    t AS (SELECT video_id, island AS turn, min(start_us) AS s, max(e2) AS "end", min(speaker) AS speaker FROM r GROUP BY 1, 2),
    b AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY turn) AS before FROM t)
    SELECT video_id, turn, CASE WHEN s - before < 10000 THEN before + 10000 ELSE s END AS start, "end", speaker FROM b
    """,
)
def speaker_turns_gap(spark, sf):
    """Turns whose end is the latest end less the gap."""
    return S.speaker_turns_cut(A.segments(spark, sf))


@query(
    "speaker_turns_bridged",
    f"""WITH {A.SEGMENTS},
    l AS (SELECT *, lead(start_us) OVER (PARTITION BY video_id ORDER BY idx) AS nxt FROM segments),
    c AS (SELECT *, CASE WHEN nxt - end_us < 3000000 THEN nxt - 40000 ELSE end_us END AS e2,
                 CASE WHEN row_number() OVER w = 1 OR speaker IS NOT DISTINCT FROM lag(speaker) OVER w THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
    i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY video_id ORDER BY idx) AS BIGINT) AS turn FROM c)
    SELECT video_id, turn, arg_min(start_us, idx) AS start, arg_max(e2, idx) AS "end", arg_min(speaker, idx) AS speaker FROM i GROUP BY 1, 2
    """,
)
def speaker_turns_bridged(spark, sf):
    """T4: pauses closed, then neighbours merged."""
    return S.speaker_turns_bridged(A.segments(spark, sf))


@query(
    "topic_islands",
    f"""{ISLANDS} SELECT video_id, island, min(start_us) AS start, arg_max(end_us, idx) AS "end", min(speaker) AS label, count(*) AS n_rows FROM i GROUP BY 1, 2""",
)
def topic_islands(spark, sf):
    """Runs of one topic."""
    return S.merged_labels(A.segments(spark, sf), "video_id", ["start_us", "idx"], "speaker", "start_us", "end_us")


@query(
    "topic_transitions",
    f"""WITH {A.SEGMENTS}, l AS (SELECT speaker AS src, lead(speaker) OVER (PARTITION BY video_id ORDER BY start_us, idx) AS dst FROM segments)
    SELECT src, dst, count(*) AS n FROM l WHERE dst IS NOT NULL GROUP BY 1, 2""",
)
def topic_transitions(spark, sf):
    """Counts of label changes."""
    return S.transitions(A.segments(spark, sf), "video_id", ["start_us", "idx"], "speaker")


@query(
    "topic_degrees",
    f"""WITH {A.SEGMENTS}, l AS (SELECT speaker AS src, lead(speaker) OVER (PARTITION BY video_id ORDER BY start_us, idx) AS dst FROM segments),
    e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL)
    SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1""",
)
def topic_degrees(spark, sf):
    """Degree of each topic in the transition graph."""
    from reelgrid.operators.aggregates import degrees

    return degrees(S.transitions(A.segments(spark, sf), "video_id", ["start_us", "idx"], "speaker"))


@query(
    "timeline_spans",
    f"""WITH RECURSIVE {A.INTERVALS},
    v AS (SELECT video_id, s::DOUBLE AS s, e::DOUBLE AS e, lead(s::DOUBLE) OVER w AS nxt, row_number() OVER w AS i FROM intervals WHERE e > s WINDOW w AS (PARTITION BY video_id ORDER BY e, seg_id % 2, seg_id)),
    f(video_id, i, reached, kind, before) AS (
        SELECT DISTINCT video_id, 0::BIGINT, 0.0::DOUBLE, 'none', 0.0::DOUBLE FROM v
        UNION ALL
        SELECT video_id, i, CASE kind WHEN 'attach' THEN CASE WHEN abs(nxt - e) < 30 THEN nxt ELSE e END WHEN 'none' THEN reached ELSE e END, kind, reached
        FROM (SELECT v.*, f.reached, CASE WHEN v.s - f.reached >= 0 AND v.s - f.reached < 30 THEN 'attach' WHEN v.s - f.reached > 30 THEN 'filler' WHEN v.e > f.reached THEN 'tail' ELSE 'none' END AS kind
              FROM f JOIN v ON v.video_id = f.video_id AND v.i = f.i + 1)),
    o AS (SELECT f.video_id, f.i, 1 AS k, before AS "start", CASE WHEN kind = 'filler' THEN v.s ELSE reached END AS "end" FROM f JOIN v ON v.video_id = f.video_id AND v.i = f.i WHERE kind <> 'none'
          UNION ALL SELECT f.video_id, f.i, 2, v.s, v.e FROM f JOIN v ON v.video_id = f.video_id AND v.i = f.i WHERE kind = 'filler')
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY i, k) - 1 AS span, "start", "end" FROM o""",
)
def timeline_spans(spark, sf):
    """A gap-free timeline of two kinds of intervals, by their end."""
    v = A.intervals(spark, sf).where("e > s")
    both = v.select("video_id", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), (F.col("seg_id") % 2).alias("source_order"), "seg_id")
    return S.spans(both, "video_id", "s", "e", ["source_order", "seg_id"], 30.0)


@query(
    "chain_edges",
    f"""WITH {A.SHOTS}, l AS (SELECT video_id, vec_id AS src, lead(vec_id) OVER (PARTITION BY video_id ORDER BY idx) AS dst FROM shots) SELECT * FROM l WHERE dst IS NOT NULL""",
)
def chain_edges(spark, sf):
    """Edges between neighbouring intervals."""
    return S.chain_edges(A.shots(spark, sf), "video_id", ["idx"], "vec_id")


WINDOWS = f"""WITH {A.INTERVALS}, {A.POINTS}, v AS (SELECT * FROM intervals WHERE e > s),
    l AS (SELECT v.*, CAST(n AS BIGINT) AS length, s // 7 * 7 AS s0 FROM v, (VALUES (180), (365), (730)) x(n)),
    w AS (SELECT *, unnest(generate_series(0, CAST(ceil((e - s0) / length) AS BIGINT) - 1)) AS win FROM l),
    x AS (SELECT video_id, seg_id, length, win, s0 + win * length AS w_start, least(s0 + win * length + length, e) AS w_end FROM w)"""


@query(
    "tumbling_multi",
    f"""{WINDOWS}, m AS (SELECT x.video_id, seg_id, length, win, coalesce(avg(value), 0) AS mean FROM x LEFT JOIN points p ON p.video_id = x.video_id AND p.t BETWEEN w_start AND w_end GROUP BY ALL)
    SELECT video_id, seg_id, length, count(*) AS n_windows, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.8), 6) AS q80 FROM m GROUP BY 1, 2, 3""",
)
def tumbling_multi(spark, sf):
    """Windows of several lengths in a turn, closed at both ends, means and their 0.8 quantile."""
    v = A.intervals(spark, sf).selectExpr("video_id", "seg_id", "cast(s as long) s", "cast(e as long) e")
    p = A.points(spark, sf).select("video_id", F.col("t").cast("long").alias("t"), "value")
    out = S.pooled_windows(v, p, "video_id", "seg_id", "s", "e", "t", "value", [180, 365, 730], 7, 365)
    return out.select("video_id", "seg_id", F.col("length").cast("long").alias("length"), "n_windows", F.round("mean", 6).alias("mean"), F.round("quantile", 6).alias("q80"))


@query(
    "fixed_chunks",
    f"""WITH {A.INTERVALS}, v AS (SELECT video_id, seg_id, s, e FROM intervals WHERE e > s),
    a AS (SELECT *, true AS rest, unnest(generate_series(0, CAST(ceil((e - s) / 400.0) AS BIGINT) - 1)) AS chunk FROM v
          UNION ALL SELECT *, false, unnest(generate_series(0, greatest(CAST(floor((e - s) / 400.0) AS BIGINT), 1) - 1)) FROM v)
    SELECT video_id, seg_id, rest, chunk, s + chunk * 400 AS c_start, least(s + chunk * 400 + 400, e) AS c_end FROM a""",
)
def fixed_chunks(spark, sf):
    """Chunks of one length with and without the rest."""
    v = A.intervals(spark, sf).where("e > s").selectExpr("video_id", "seg_id", "cast(s as long) s", "cast(e as long) e")
    each = [S.fixed_chunks(v, "s", "e", 400, rest).withColumn("rest", F.lit(rest)) for rest in (True, False)]
    return each[0].unionByName(each[1]).select("video_id", "seg_id", "rest", "chunk", "c_start", "c_end")


@query(
    "shot_density_kde",
    """
    WITH s AS (SELECT label AS video_id, CAST(vec_id AS DOUBLE) AS pos FROM embeddings),
    m AS (SELECT video_id, max(pos) AS last_at FROM s GROUP BY 1),
    g AS (SELECT video_id, unnest(generate_series(0, CAST(ceil(last_at / 10) AS BIGINT))) AS i, last_at, CAST(ceil(last_at / 10) AS BIGINT) AS n FROM m),
    t AS (SELECT video_id, i, 0 + i * (last_at - 0) / greatest(n, 1) AS t FROM g),
    y AS (SELECT t.video_id, i, avg(exp(-((t - pos) / 10) * ((t - pos) / 10) / 2)) AS y FROM t JOIN s USING (video_id) GROUP BY 1, 2)
    SELECT video_id, i, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 6) AS y FROM y WINDOW w AS (PARTITION BY video_id)
    """,
)
def shot_density_kde(spark, sf):
    """Gaussian density of shot starts on a grid, scaled to 0..1."""
    from reelgrid.functions.numeric import linspace

    s = table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").cast("double").alias("at"))
    last = s.groupBy("video_id").agg(F.max("at").alias("last_at"))
    grid = last.select("video_id", F.posexplode(linspace(F.lit(0.0), F.col("last_at"), (F.ceil(F.col("last_at") / 10) + 1).cast("int"))).alias("i", "t"))
    d = S.density(grid, s, "video_id", "t", "at", 10)
    return d.join(grid, ["video_id", "t"]).select("video_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(
    "moving_avg",
    f"""WITH {A.SEGMENTS} SELECT video_id, idx, round(avg(end_us - start_us) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS smooth FROM segments""",
)
def moving_avg(spark, sf):
    """Centred mean of five."""
    d = A.segments(spark, sf).select("video_id", F.col("idx").cast("long").alias("idx"), (F.col("end_us") - F.col("start_us")).alias("v"))
    return S.moving_average(d, "video_id", "idx", "v").select("video_id", "idx", F.round("smooth", 2).alias("smooth"))


@query(
    "median_filter",
    f"""WITH {A.SEGMENTS}, w AS (SELECT video_id, idx, list(CAST(end_us - start_us AS DOUBLE)) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l FROM segments)
    SELECT video_id, idx, list_sort(list_concat(l, list_transform(generate_series(1, 13 - len(l)), lambda x: 0.0::DOUBLE)))[7] AS filtered FROM w""",
)
def median_filter(spark, sf):
    """Running median of 13, zeros beyond the edges."""
    d = A.segments(spark, sf).select("video_id", F.col("idx").cast("long").alias("idx"), (F.col("end_us") - F.col("start_us")).alias("v"))
    return S.median_filter(d, "video_id", "idx", "v").select("video_id", "idx", "filtered")


@query(
    "interpolated_track",
    """
    WITH o AS (SELECT o_custkey AS track, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS f, max(o_totalprice) AS x FROM orders GROUP BY 1, 2),
    g AS (SELECT track, unnest(generate_series(min(f), max(f))) AS f FROM o GROUP BY 1),
    n AS (SELECT g.track, g.f, x, last_value(CASE WHEN x IS NOT NULL THEN g.f END IGNORE NULLS) OVER a AS pf, last_value(x IGNORE NULLS) OVER a AS px,
                 first_value(CASE WHEN x IS NOT NULL THEN g.f END IGNORE NULLS) OVER b AS nf, first_value(x IGNORE NULLS) OVER b AS nx
          FROM g LEFT JOIN o ON o.track = g.track AND o.f = g.f
          WINDOW a AS (PARTITION BY g.track ORDER BY g.f), b AS (PARTITION BY g.track ORDER BY g.f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT track, f // 64 AS block, count(*) AS n, round(sum(x) + 0.00031234, 2) AS total, round(min(x) + 0.00031234, 2) AS low, round(max(x) + 0.00031234, 2) AS high
    FROM (SELECT track, f, CASE WHEN nf = pf THEN px ELSE px + (nx - px) * (f - pf) / (nf - pf) END AS x FROM n) GROUP BY ALL
    """,
)
def interpolated_track(spark, sf):
    """Linear interpolation between observed frames, summed up over blocks of 64 frames; the shift keeps sums off the ties of rounding."""
    orders = table(spark, sf, "orders")
    seen = orders.select(F.col("o_custkey").alias("track"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("f"), F.col("o_totalprice").alias("x"))
    o = dealt(seen, orders.count(), "track").groupBy("track", "f").agg(F.max("x").alias("x"))
    full = S.interpolated(o, "track", "f", ["x"])
    return full.groupBy("track", F.floor(F.col("f") / 64).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x") + 0.00031234, 2).alias("total"), F.round(F.min("x") + 0.00031234, 2).alias("low"), F.round(F.max("x") + 0.00031234, 2).alias("high"))


@query(
    "scene_ranges",
    f"""WITH {A.SEGMENTS}, c AS (SELECT video_id, idx, CASE WHEN end_us - start_us > 60000000000 THEN 1 ELSE 0 END AS c FROM segments),
    b AS (SELECT *, CASE WHEN c = 0 AND coalesce(lag(c) OVER (PARTITION BY video_id ORDER BY idx), 1) = 1 THEN 1 ELSE 0 END AS b FROM c),
    r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY video_id ORDER BY idx) - 1 AS BIGINT) AS scene FROM b)
    SELECT video_id, scene, min(idx) AS first, max(idx) AS last FROM r WHERE c = 0 GROUP BY 1, 2""",
)
def scene_ranges(spark, sf):
    """Runs below a threshold as scenes."""
    d = A.segments(spark, sf).select("video_id", F.col("idx").cast("long").alias("idx"), (F.col("end_us") - F.col("start_us")).alias("p"))
    return S.run_ranges(d, "video_id", "idx", "p", 60_000_000_000)


@query(
    "full_batches",
    f"""WITH {A.SEGMENTS}, b AS (SELECT video_id, idx, idx // 16 AS batch FROM segments), n AS (SELECT *, count(*) OVER (PARTITION BY video_id, batch) AS n FROM b) SELECT video_id, idx, batch FROM n WHERE n = 16""",
)
def full_batches(spark, sf):
    """Frames in batches, the last one only if full."""
    d = A.segments(spark, sf).select("video_id", F.col("idx").cast("long").alias("idx"))
    return S.full_batches(d, "video_id", "idx", 16)


@query(
    "image_context_similarity",
    f"""WITH {A.SHOTS}, n AS (SELECT video_id, idx, e, lag(e) OVER w AS p, lead(e) OVER w AS n FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY idx))
    SELECT video_id, idx, round(coalesce(list_dot_product(e, p), 0), 6) AS prev, round(coalesce(list_dot_product(e, n), 0), 6) AS next FROM n""",
)
def image_context_similarity(spark, sf):
    """Similarity to the context of one turn on either side, 0 where there is none."""
    from pyspark.sql import Window

    from reelgrid.functions.vectors import dot

    w = Window.partitionBy("video_id").orderBy("idx")
    s = A.shots(spark, sf)
    at = lambda other: F.round(F.coalesce(dot(F.col("embedding"), other.over(w)), F.lit(0.0)), 6)
    return s.select("video_id", F.col("idx").cast("long").alias("idx"), at(F.lag("embedding")).alias("prev"), at(F.lead("embedding")).alias("next"))
