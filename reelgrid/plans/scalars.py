"""Scalar functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import collections as C
from reelgrid.functions import numeric as N
from reelgrid.functions import text as T
from reelgrid.functions import vectors as V
from reelgrid.plans.registry import query, table


@query(
    "text_basics",
    r"""
    SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words,
           sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped,
           sha256(array_to_string(regexp_extract_all(text, '\S+'), ' ')) AS joined,
           trim(regexp_replace(split_part(text, chr(10), 1), '\.+$', ''), ' ') AS undotted,
           substr(text, 1, 24999) = text AS whole,
           len(regexp_extract_all(text, '\S+')) >= 25 AS long_enough,
           trim(text, ' ') <> '' AS visible
    FROM documents
    """,
)
def text_basics(spark, sf):
    """Counts, stripping, joining, prefixes."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        T.word_count(t).cast("long").alias("n_words"),
        F.sha2(T.strip(t), 256).alias("stripped"),
        F.sha2(T.join_words(T.words(t)), 256).alias("joined"),
        T.strip_dots(F.substring_index(t, "\n", 1)).alias("undotted"),
        (F.substring(t, 1, 24999) == t).alias("whole"),
        (T.word_count(t) >= 25).alias("long_enough"),
        (F.trim(t) != "").alias("visible"),
    )


ROUTES = {"http://m": "mobile", "https://m": "mobile", "http://": "plain", "https://": "secure"}


@query(
    "url_parts",
    r"""
    SELECT page_id,
           CASE WHEN starts_with(url, 'http://m') OR starts_with(url, 'https://m') THEN 'mobile'
                WHEN starts_with(url, 'http://') THEN 'plain' WHEN starts_with(url, 'https://') THEN 'secure' END AS route,
           regexp_extract(url, '([^/]*)$', 1) AS last_segment,
           regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
           regexp_extract(url, '\.([^./]*)$', 1) AS ext,
           lower(regexp_replace(url, '^[^:]*:', '')) AS tail,
           CASE WHEN contains(url, 'http') THEN url ELSE concat('http:', url) END AS with_scheme,
           ends_with(url, 'x') AS ends_x, replace(url, 'example', 'site') AS renamed
    FROM pages
    """,
)
def url_parts(spark, sf):
    """Routing by prefix, path parts, suffixes, replacement."""
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        T.route_by_prefix(u, ROUTES).alias("route"),
        T.last_segment(u).alias("last_segment"),
        T.path_stem(u).alias("stem"),
        T.extension(u).alias("ext"),
        T.after_colon(u).alias("tail"),
        T.with_scheme(u).alias("with_scheme"),
        u.endswith("x").alias("ends_x"),
        F.replace(u, F.lit("example"), F.lit("site")).alias("renamed"),
    )


OPTIONS = ["A", "B", "C", "D"]


@query(
    "answer_parsing",
    r"""
    WITH a AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN chr(CAST(65 + p_size % 6 AS INT)) || '.'
                      WHEN 2 THEN 'The answer is ' || chr(CAST(97 + p_size % 4 AS INT)) || '...' WHEN 3 THEN 'I think C, maybe D'
                      WHEN 4 THEN p_name WHEN 5 THEN 'Response:Evaluative, high' ELSE ' yes ' END AS answer FROM part),
    s AS (SELECT *, trim(regexp_replace(answer, '\.+$', ''), ' ') AS x FROM a)
    SELECT p_partkey,
           CASE WHEN length(x) = 0 THEN 'Z' WHEN length(x) = 1 THEN x
                WHEN regexp_extract(x, '(?i)answer is ([A-Z])', 1) <> '' THEN upper(regexp_extract(x, '(?i)answer is ([A-Z])', 1))
                WHEN contains(x, 'A') THEN 'A' WHEN contains(x, 'B') THEN 'B' WHEN contains(x, 'C') THEN 'C' WHEN contains(x, 'D') THEN 'D' ELSE 'Z' END AS choice,
           CASE WHEN contains(lower(answer), 'non-evaluative') THEN 'non-evaluative' WHEN contains(lower(answer), 'evaluative') THEN 'evaluative' ELSE 'non-evaluative' END AS label,
           CASE WHEN contains(lower(answer), 'high') THEN 'high' WHEN contains(lower(answer), 'medium') THEN 'medium' ELSE 'low' END AS confidence,
           CASE WHEN contains(answer, 'Response:') THEN split_part(answer, 'Response:', 2) END AS response,
           CASE WHEN lower(trim(answer, ' ')) = 'yes' THEN 1 ELSE 0 END AS flag
    FROM s
    """,
)
def answer_parsing(spark, sf):
    """Free-text answers to options, labels, flags."""
    k = F.col("p_partkey") % 7
    letter = lambda base, m: F.char((F.lit(base) + F.col("p_size") % m).cast("int"))
    answer = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.concat(letter(65, 6), F.lit(".")))
        .when(k == 2, F.concat(F.lit("The answer is "), letter(97, 4), F.lit("...")))
        .when(k == 3, F.lit("I think C, maybe D"))
        .when(k == 4, F.col("p_name"))
        .when(k == 5, F.lit("Response:Evaluative, high"))
        .otherwise(F.lit(" yes "))
    )
    a = F.col("answer")
    return table(spark, sf, "part").withColumn("answer", answer).select(
        "p_partkey",
        T.choice_of(a, OPTIONS).alias("choice"),
        T.label_in(a, ["non-evaluative", "evaluative"], "non-evaluative").alias("label"),
        T.label_in(a, ["high", "medium"], "low").alias("confidence"),
        T.after_marker(a, "Response:").alias("response"),
        T.yes_no(a).alias("flag"),
    )


@query(
    "id_formatting",
    r"""
    SELECT p_partkey, 'shot_' || p_partkey AS node, 'Spk. turn ' || p_partkey AS title, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS padded,
           sha256(p_brand || chr(31) || p_partkey) AS surrogate,
           CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'LARGE' THEN 'big' ELSE 'unsure' END AS recoded,
           printf('%s (%d): %s', p_brand, p_size, p_name) AS label
    FROM part
    """,
)
def id_formatting(spark, sf):
    """Ids, recoding through a map, titles."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        T.node_id("shot_", k).alias("node"),
        T.node_id("Spk. turn ", k).alias("title"),
        T.padded(k).alias("padded"),
        T.surrogate_id(F.col("p_brand"), k).alias("surrogate"),
        C.lookup({"ECONOMY": "cheap", "LARGE": "big"}, F.col("p_type"), "unsure").alias("recoded"),
        F.format_string("%s (%d): %s", "p_brand", "p_size", "p_name").alias("label"),
    )


@query(
    "text_chunks",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents),
    c AS (SELECT doc_id, ws, unnest(generate_series(0, (len(ws) - 1) // 128)) AS chunk FROM w WHERE len(ws) > 0)
    SELECT doc_id, chunk, array_to_string(ws[chunk * 128 + 1 : chunk * 128 + 128], ' ') AS words FROM c
    """,
)
def text_chunks(spark, sf):
    """Chunks of 128 words."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk", "words")).withColumn("chunk", F.col("chunk").cast("long"))


@query(
    "text_char_chunks",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
    c AS (SELECT doc_id, word, i, sum(len(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
    j AS (SELECT c.doc_id, c.i, greatest(c.i, coalesce(d.i, 0)) AS last FROM c ASOF LEFT JOIN c d ON c.doc_id = d.doc_id AND c.upto - len(c.word) - 1 + 129 >= d.upto),
    n AS (SELECT doc_id, list(last ORDER BY i) AS lasts FROM j GROUP BY 1),
    r(doc_id, chunk, i) AS (SELECT doc_id, 0, 1::BIGINT FROM n UNION ALL SELECT r.doc_id, chunk + 1, lasts[r.i] + 1 FROM r JOIN n ON n.doc_id = r.doc_id WHERE lasts[r.i] < len(lasts)),
    k AS (SELECT r.doc_id, chunk, r.i, lasts[r.i] AS last, len(ws[1]) > 128 AS over, ws FROM r JOIN n USING (doc_id) JOIN w USING (doc_id))
    SELECT doc_id, chunk + over::INT AS chunk, array_to_string(ws[i : last], ' ') AS words FROM k
    UNION ALL SELECT doc_id, 0, '' FROM w WHERE len(ws[1]) > 128
    """,
)
def text_char_chunks(spark, sf):
    """Greedy chunks of at most 128 characters, cut at words."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.char_chunks(F.col("text"))).alias("chunk", "words"))


@query(
    "numeric_basics",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS ms,
           CAST(trunc(l_quantity * 1000) AS BIGINT) / 1000.0 AS back,
           CAST(trunc(l_extendedprice * 25.0) AS BIGINT) AS frame, l_partkey / 25.0 AS sec,
           floor(abs(l_tax * 100 - 4) / 2) AS bin,
           (abs(l_tax - 0.04) + abs(l_discount - 0.05)) / 2 * CASE WHEN (l_tax - 0.04) + (l_discount - 0.05) < 0 THEN -1.0 ELSE 1.0 END AS signed,
           least(1.0, 30.0 / greatest(l_quantity, 20.0)) AS scale,
           round(degrees(l_discount), 6) AS deg, round(exp(-(l_quantity * l_quantity) / 200.0), 9) AS kernel,
           least(floor((l_discount * 8 + 0.1) * 3), 2) AS third
    FROM lineitem
    """,
)
def numeric_basics(spark, sf):
    """Unit changes, bins, signed means, kernels."""
    q, d, t, p = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.to_ms(p).alias("ms"),
        N.to_seconds(N.to_ms(q)).alias("back"),
        N.seconds_to_frame(p, 25, cut=True).alias("frame"),
        N.frame_to_seconds(F.col("l_partkey"), 25).alias("sec"),
        N.angle_bin(t * 100 - 4, 2).cast("double").alias("bin"),
        N.signed_mean(t - 0.04, d - 0.05).alias("signed"),
        N.resize_scale(q, F.lit(20.0), 30).alias("scale"),
        F.round(F.degrees(d), 6).alias("deg"),
        F.round(N.gaussian(q, 10), 9).alias("kernel"),
        N.third_of_frame(d * 8, F.lit(0.2)).cast("double").alias("third"),
    )


@query(
    "box_geometry",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 12 AS x2, l_discount * 100 + 9 AS y2,
                      l_quantity + l_tax * 100 AS u1, l_discount * 100 + 2 AS v1, l_quantity + l_tax * 100 + 10 AS u2, l_discount * 100 + 14 AS v2 FROM lineitem),
    i AS (SELECT *, greatest(0.0, least(x2, u2) - greatest(x1, u1)) * greatest(0.0, least(y2, v2) - greatest(y1, v1)) AS inter FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(inter / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inter), 6) AS iou,
           round(greatest(0.0, least(x2, u2) - greatest(x1, u1)) / (x2 - x1), 6) AS share,
           round(greatest(0.0, (x1 + x2) / 2 - greatest(x2 - x1, y2 - y1) / 2 * 1.4), 6) AS crop_x1,
           round(least(50.0, (x1 + x2) / 2 + greatest(x2 - x1, y2 - y1) / 2 * 1.4), 6) AS crop_x2,
           CAST(trunc(x1 / 64.0 * 640) AS INT) AS px
    FROM i
    """,
)
def box_geometry(spark, sf):
    """Intersection over union, shares, crops, pixel corners."""
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    a, b = (q, d, q + 12, d + 9), (q + t, d + 2, q + t + 10, d + 14)
    crop = N.square_crop(*a, F.lit(50.0), F.lit(50.0))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(N.iou(a, b), 6).alias("iou"),
        F.round(N.overlap_share(a[0], a[2], b[0], b[2]), 6).alias("share"),
        F.round(crop["x1"], 6).alias("crop_x1"),
        F.round(crop["x2"], 6).alias("crop_x2"),
        N.box_to_pixels(q / 64.0, d / 64.0, F.lit(0.1), F.lit(0.1), F.lit(640), F.lit(480))[0].alias("px"),
    )


@query(
    "frame_sampling",
    """
    WITH p AS (SELECT p_partkey, CAST(p_partkey % 90 AS INT) AS s, CAST(p_partkey % 90 + p_size AS INT) AS e, p_size AS n FROM part),
    f AS (SELECT p_partkey, 'resampled' AS kind, i AS pos, CASE WHEN k = 1 THEN 0 ELSE CAST(trunc(0.0 + i * (CAST(n - 1 AS DOUBLE)) / (k - 1)) AS INT) END AS frame
          FROM (SELECT *, CAST(trunc(n * 2.0 / 5.0) AS INT) AS k FROM p) q, generate_series(0, k - 1) g(i) WHERE k > 0
          UNION ALL SELECT p_partkey, 'one_second', i, i * 4 FROM p, generate_series(0, (n - 1) // 4) g(i)
          UNION ALL SELECT p_partkey, 'stride', i, s + 12 * i FROM p, generate_series(0, (e - s) // 12) g(i)
          UNION ALL SELECT p_partkey, 'spread5', i, CASE WHEN n + 1 <= 5 THEN s + i ELSE CAST(trunc(s + i * CAST(e - s AS DOUBLE) / 4) AS INT) END
                    FROM p, generate_series(0, least(n, 4)) g(i)
          UNION ALL SELECT p_partkey, 'capped', i, CASE WHEN (n - 1) // 2 + 1 > 8 THEN s + 2 * CAST(trunc(i * CAST((n - 1) // 2 AS DOUBLE) / 7) AS INT) ELSE s + 2 * i END
                    FROM p, generate_series(0, least((n - 1) // 2, 7)) g(i)
          UNION ALL SELECT p_partkey, 'clip6', i, CASE WHEN n < 6 THEN s + least(i, n - 1) ELSE s + i * greatest(n // 6, 1) END FROM p, generate_series(0, 5) g(i))
    SELECT p_partkey, kind, CAST(pos AS BIGINT) AS pos, CAST(frame AS BIGINT) AS frame FROM f
    """,
)
def frame_sampling(spark, sf):
    """Positions of sampled frames."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 90).cast("int").alias("s"), (F.col("p_partkey") % 90 + F.col("p_size")).cast("int").alias("e"), F.col("p_size").alias("n"))
    s, e, n = F.col("s"), F.col("e"), F.col("n")
    kinds = {
        "resampled": N.resampled_frames(n, F.lit(5.0), 2.0),
        "one_second": N.one_a_second(n, F.lit(4.7)),
        "stride": N.strided(s, e, F.lit(12)),
        "spread5": N.spread(s, e, 5),
        "capped": N.strided_capped(s, e, 8, 8),
        "clip6": N.clip_indices(N.strided(s, e - 1, F.lit(1)), 6),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("frames")) for k, v in kinds.items()])
    return p.select("p_partkey", F.explode(each).alias("k")).select("p_partkey", "k.kind", F.posexplode("k.frames").alias("pos", "frame")).select(
        "p_partkey", "kind", F.col("pos").cast("long").alias("pos"), F.col("frame").cast("long").alias("frame")
    )


@query("random_frame", "SELECT p_partkey, p_partkey + CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS BIGINT) % p_size AS frame FROM part")
def random_frame(spark, sf):
    """One frame a shot, picked by a hash of the shot, so that a repeat picks the same."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_partkey") + N.hash_index(F.col("p_partkey"), F.col("p_size"))).alias("frame"))


@query(
    "map_functions",
    """
    WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, f / n AS f_share, (f / n) + 0.0 AS pooled, CAST((f / n >= 0.3)::INT + (o / n >= 0.3)::INT + (p / n >= 0.3)::INT AS BIGINT) AS kept,
           CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END AS top,
           round(f / n * 1 + o / n * 2 + p / n * 3, 6) AS expected,
           (f > 0)::INT || '' || (o > 0)::INT || '' || (p > 0)::INT AS flags,
           f || ',' || o || ',' || p || ',-5,-5' AS padded
    FROM c
    """,
)
def map_functions(spark, sf):
    """Maps, argmax, expected class, padding."""
    counts = [F.count_if(F.col("o_orderstatus") == s) for s in "FOP"]
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array(*counts).alias("v"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("share", F.transform("v", lambda x: x / F.col("n"))).withColumn("m", F.map_from_arrays(F.array(*map(F.lit, "FOP")), "share"))
    return c.select(
        "o_custkey",
        C.get_or(F.col("m"), "F", 0.0).alias("f_share"),
        C.pooled(F.col("m"), ["F", "absent"]).alias("pooled"),
        F.size(C.at_least(F.col("m"), 0.3)).cast("long").alias("kept"),
        C.argmax(F.col("v"), list("FOP")).alias("top"),
        F.round(C.expected_class(F.col("share")), 6).alias("expected"),
        F.array_join(C.binarised(F.col("v")).cast("array<string>"), "").alias("flags"),
        F.array_join(C.padded_array(F.col("v").cast("array<double>"), 5, -5.0).cast("array<int>").cast("array<string>"), ",").alias("padded"),
    )


@query(
    "map_inversion",
    """
    SELECT 'REGION_' || r_regionkey AS code, r_name AS name, CAST(r_regionkey AS VARCHAR) AS key FROM region
    """,
)
def map_inversion(spark, sf):
    """A label map turned round and looked up."""
    r = table(spark, sf, "region")
    m = F.map_from_arrays(F.array(F.col("r_name")), F.array(F.concat(F.lit("REGION_"), F.col("r_regionkey").cast("string"))))
    return r.select(F.explode(C.inverted(m)).alias("code", "name"), F.col("r_regionkey").cast("string").alias("key"))


@query(
    "multi_hot_labels",
    """
    SELECT c_custkey, CAST(contains('_' || j || '_', '_BUILDING_') AS INT) || CAST(contains('_' || j || '_', '_MACHINERY_') AS INT) || CAST(contains('_' || j || '_', '_X_') AS INT) AS hot
    FROM (SELECT c_custkey, c_mktsegment || '_X' AS j FROM customer)
    """,
)
def multi_hot_labels(spark, sf):
    """Flags of the labels in a joined text."""
    j = F.concat("c_mktsegment", F.lit("_X"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(C.multi_hot(j, ["BUILDING", "MACHINERY", "X"]).cast("array<string>"), "").alias("hot"))


@query(
    "json_fields",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS out
    FROM events
    """,
)
def json_fields(spark, sf):
    """JSON read and written."""
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("p.k").alias("k"))).alias("out"))


@query(
    "dates_in_names",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, dayofweek(o_orderdate) + 1 AS dow, dayofweek(o_orderdate) IN (2, 4) AS tue_thu
    FROM orders
    """,
)
def dates_in_names(spark, sf):
    """The date in a file name, its weekday, Tuesdays and Thursdays."""
    name = F.concat(F.lit("TV-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-2020-4300.mp4"))
    d = T.date_in_name(name)
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d"), F.dayofweek(d).cast("long").alias("dow"), F.dayofweek(d).isin(3, 5).alias("tue_thu"))


@query(
    "vector_functions",
    """
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, list_max(v) AS top FROM e),
    s AS (SELECT *, list_sum(list_transform(v, lambda x: exp(x - top))) AS z FROM n)
    SELECT vec_id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS unit_first, round(exp(v[1] - top) / z, 8) AS soft_first,
           round(v[64], 6) AS last
    FROM s
    """,
)
def vector_functions(spark, sf):
    """Norms, unit vectors, softmax, last element."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(V.norm(e), 6).alias("norm"),
        F.round(F.get(V.l2_normalise(e), F.lit(0)), 6).alias("unit_first"),
        F.round(F.get(V.softmax(e), F.lit(0)), 8).alias("soft_first"),
        F.round(F.element_at(e, -1).cast("double"), 6).alias("last"),
    )


@query(
    "quality_filters",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 30 AS is_actor
    FROM lineitem WHERE l_discount >= 0.06 AND l_tax > 0.05 AND l_returnflag IN ('A', 'R')
    """,
)
def quality_filters(spark, sf):
    """Quality cuts that reach the scan, and a boolean column."""
    li = table(spark, sf, "lineitem")
    kept = li.where((F.col("l_discount") >= 0.06) & (F.col("l_tax") > 0.05) & F.col("l_returnflag").isin("A", "R"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") > 30).alias("is_actor"))


@query(
    "length_guards",
    """
    SELECT o_orderkey, CASE WHEN e > s THEN e - s END AS payload, e <> s AS keeps_shot, e > s AS keeps_turn
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey) AS e
          FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    """,
)
def length_guards(spark, sf):
    """Rows without length keep a null payload, or go."""
    from reelgrid.plans.adapters import intervals

    s, e = F.col("s"), F.col("e")
    return intervals(spark, sf).select(F.col("seg_id").alias("o_orderkey"), F.when(e > s, (e - s).cast("long")).alias("payload"), (e != s).alias("keeps_shot"), (e > s).alias("keeps_turn"))


@query(
    "merged_fields",
    """
    SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
    """,
)
def merged_fields(spark, sf):
    """P20: two records merged, the right side winning."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "left").select("c_custkey", F.coalesce("s_name", "c_name").alias("name"), F.coalesce("s_acctbal", "c_acctbal").alias("balance"))
