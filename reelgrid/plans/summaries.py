"""Aggregations, votes and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid.operators import aggregates as G
from reelgrid.operators import intervals as I
from reelgrid.plans import adapters as A
from reelgrid.plans.registry import query, table


@query(
    "majority_vote",
    """
    WITH f AS (SELECT l_orderkey, l_linenumber, string_agg(l_returnflag, '_' ORDER BY l_shipdate, l_returnflag) AS j FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem) GROUP BY 1, 2),
    v AS (SELECT l_orderkey, j, count(*) AS votes FROM f GROUP BY 1, 2)
    SELECT l_orderkey, j AS joined, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, j) AS rn FROM v) WHERE rn = 1
    """,
)
def majority_vote(spark, sf):
    """A3, A4: mode of composite labels with a fixed tie rule."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate").distinct()
    return G.composite_majority(li, ["l_orderkey"], "l_linenumber", "l_returnflag", "l_shipdate")


@query(
    "crop_mode",
    """
    SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') >= count(*) FILTER (WHERE l_linestatus = 'O') THEN 'F' ELSE 'O' END AS mode
    FROM lineitem GROUP BY 1
    """,
)
def crop_mode(spark, sf):
    """A4: mode over crops, the least on ties, as a built-in aggregate."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.mode("l_linestatus", True).alias("mode"))


@query(
    "topk_renormalised",
    """
    WITH s AS (SELECT o_custkey, o_orderpriority, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS s FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority, round(prob, 6) AS prob, rank FROM
    (SELECT *, s / sum(s) OVER (PARTITION BY o_custkey) AS prob, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderpriority) AS rank FROM s) WHERE rank <= 3
    """,
)
def topk_renormalised(spark, sf):
    """Sums by label, renormalised, top three."""
    o = table(spark, sf, "orders").withColumn("p", F.round(F.col("o_totalprice") * 100).cast("long"))
    top = G.top_renormalised(o, ["o_custkey"], "o_orderpriority", "p")
    return top.select("o_custkey", "o_orderpriority", F.round("prob", 6).alias("prob"), F.col("rank").cast("long").alias("rank"))


@query(
    "best_mean_label",
    """
    WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, l_returnflag, round(m, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m DESC, l_returnflag) AS rn FROM m) WHERE rn = 1
    """,
)
def best_mean_label(spark, sf):
    """Greatest mean over chunks."""
    return G.top_mean(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity").select("l_suppkey", "l_returnflag", F.round("prob", 6).alias("prob"))


@query(
    "top_chunks",
    """
    SELECT l_suppkey, l_extendedprice, l_returnflag, rank FROM (SELECT l_suppkey, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3
    """,
)
def top_chunks(spark, sf):
    """Top three chunks; labels may repeat."""
    top = G.top_chunks(table(spark, sf, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"])
    return top.select("l_suppkey", "l_extendedprice", "l_returnflag", F.col("rank").cast("long").alias("rank"))


@query(
    "class_shares",
    """
    SELECT source, count(*) FILTER (WHERE lang = 'en') / count(*) AS share_en, count(*) FILTER (WHERE lang = 'de') / count(*) AS share_de,
           count(*) FILTER (WHERE lang = 'fr') AS n_fr, count(*) FILTER (WHERE lang = 'es') AS n_es, count(*) FILTER (WHERE lang NOT IN ('fr', 'es')) AS n_X
    FROM documents GROUP BY source
    """,
)
def class_shares(spark, sf):
    """Shares and counts by class, others under X."""
    d = table(spark, sf, "documents")
    return G.proportions(d, ["source"], "lang", ["en", "de"]).join(G.count_vector(d, ["source"], "lang", ["fr", "es"]), "source")


@query(
    "presence_ratio",
    """
    SELECT l_suppkey, l_returnflag, count(DISTINCT l_linenumber) / 5 AS ratio FROM lineitem WHERE l_discount >= 0.07 GROUP BY ALL HAVING count(DISTINCT l_linenumber) / 5 >= 0.5
    """,
)
def presence_ratio(spark, sf):
    """Share of five samples, kept from a half."""
    return G.presence(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_linenumber", "l_discount", 0.07)


@query(
    "person_positions",
    f"""
    WITH p AS (SELECT l_orderkey, l_suppkey, least(floor(l_discount * 28), 2) AS bin, l_quantity FROM lineitem),
    q AS (SELECT l_orderkey, l_suppkey, count(*) AS n, count(*) FILTER (WHERE bin = 0) AS lft, count(*) FILTER (WHERE bin = 1) AS mid, count(*) FILTER (WHERE bin = 2) AS rgt, round(avg(l_quantity), 6) AS mean FROM p GROUP BY 1, 2)
    SELECT *, CAST(sum(n) OVER (PARTITION BY l_orderkey) AS BIGINT) AS shot_total FROM q
    """,
)
def person_positions(spark, sf):
    """Faces of a person in a shot by thirds of the frame, and the shot's total."""
    b = F.least(F.floor(F.col("l_discount") * 28), F.lit(2))
    p = table(spark, sf, "lineitem").withColumn("bin", b)
    per = p.groupBy("l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("bin") == i).alias(n) for i, n in enumerate(("lft", "mid", "rgt"))], F.round(F.avg("l_quantity"), 6).alias("mean")
    )
    return per.withColumn("shot_total", F.sum("n").over(Window.partitionBy("l_orderkey")))


@query(
    "active_speaker",
    """
    WITH f AS (SELECT l_orderkey AS turn, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 5 END AS cluster, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t FROM lineitem),
    c AS (SELECT turn, cluster, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT turn, cluster, first_seen, last_seen, n, round((last_seen - first_seen) / 1500.0, 6) AS active_ratio, (last_seen - first_seen) / 1500.0 > 0.5 AS active
    FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY (cluster IS NOT NULL) DESC, last_seen - first_seen DESC, first_seen DESC, cluster DESC) AS rn FROM c) WHERE rn = 1
    """,
)
def active_speaker(spark, sf):
    """The face visible longest in a turn, its ratio and extent."""
    f = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("turn"), F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 5 END").alias("cluster"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("t")
    )
    ratio = (F.col("last_seen") - F.col("first_seen")) / F.lit(1500.0)
    return G.longest_visible(f, ["turn"], "cluster", "t").withColumn("active_ratio", F.round(ratio, 6)).withColumn("active", ratio > 0.5)


@query(
    "track_means",
    """
    WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT label, i AS dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL
    """,
)
def track_means(spark, sf):
    """Mean embedding of a track."""
    m = G.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query(
    "pooled_features",
    """
    WITH x AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT label, i AS dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(max_by(x, vec_id), 6) AS last FROM x GROUP BY ALL
    """,
)
def pooled_features(spark, sf):
    """Mean, greatest and last value of each dimension."""
    p = G.pooled_vector(table(spark, sf, "embeddings"), ["label"], "embedding", "vec_id")
    return p.select("label", F.col("dim").cast("long").alias("dim"), *[F.round(c, 6).alias(c) for c in ("mean", "max", "last")])


@query(
    "speaking_tracks",
    """
    SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal >= 0) AS frames, count(*) FILTER (WHERE c_acctbal >= 0) / count(*) AS ratio, round(avg(c_acctbal), 4) AS mean, count(*) FILTER (WHERE c_acctbal >= 0) / count(*) > 0.6 AS is_speaking FROM customer GROUP BY 1
    """,
)
def speaking_tracks(spark, sf):
    """Speaking frames of a track."""
    return G.speaking(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal").withColumn("mean", F.round("mean", 4))


@query(
    "ragged_scores",
    """
    WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS pos, l_quantity AS x FROM lineitem),
    n AS (SELECT l_suppkey, max(pos) AS m, count(DISTINCT l_orderkey) AS k FROM l GROUP BY 1),
    g AS (SELECT l_suppkey, k, unnest(generate_series(0, m)) AS pos FROM n)
    SELECT g.l_suppkey, g.pos, round((coalesce(sum(x), 0) - 5.0 * (k - count(x))) / k, 6) AS mean FROM g LEFT JOIN l ON l.l_suppkey = g.l_suppkey AND l.pos = g.pos GROUP BY g.l_suppkey, g.pos, k
    """,
)
def ragged_scores(spark, sf):
    """Lists of unequal length padded and averaged."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    lists = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(v.alias("v"))
    return G.ragged_mean(lists, ["l_suppkey"], "v").select("l_suppkey", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query(
    "quantile80",
    """
    SELECT l_suppkey, round(quantile_cont(l_quantity, 0.8), 6) AS q80, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, quantile_disc(l_quantity, 0.5) AS lower_median, max(l_quantity) AS top FROM lineitem GROUP BY 1
    """,
)
def quantile80(spark, sf):
    """Interpolated and lower quantiles, by selection where a group is large."""
    from reelgrid.operators.quantiles import quantiles

    wanted = {"q80": ("l_quantity", 0.8, "linear"), "median": ("l_extendedprice", 0.5, "linear"), "lower_median": ("l_quantity", 0.5, "lower")}
    out = quantiles(table(spark, sf, "lineitem"), ["l_suppkey"], wanted, also={"top": F.max("l_quantity")})
    return out.select("l_suppkey", F.round("q80", 6).alias("q80"), F.round("median", 6).alias("median"), "lower_median", "top")


@query(
    "frame_pair_stats",
    """
    WITH e AS (SELECT vec_id // 25 AS shot, vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.shot, round(avg(list_dot_product(a.v, b.v)), 6) AS mean, round(quantile_disc(list_dot_product(a.v, b.v), 0.5), 6) AS median, round(max(list_dot_product(a.v, b.v)), 6) AS max
    FROM e a JOIN e b ON b.shot = a.shot + 1 GROUP BY 1
    """,
)
def frame_pair_stats(spark, sf):
    """All frame pairs of neighbouring shots of a bounded number of frames."""
    from reelgrid.functions.vectors import dot

    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("shot"), "embedding")
    b = e.select((F.col("shot") - 1).alias("shot"), F.col("embedding").alias("other"))
    s = e.join(b, "shot").withColumn("s", dot(F.col("embedding"), F.col("other")))
    return s.groupBy("shot").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s)"), 6).alias("median"), F.round(F.max("s"), 6).alias("max"))


@query(
    "interval_means",
    f"""
    WITH {A.INTERVALS}, {A.POINTS}
    SELECT v.video_id, seg_id, round(coalesce(avg(value), 0), 6) AS mean FROM intervals v LEFT JOIN points p ON p.video_id = v.video_id AND p.t BETWEEN v.s AND v.e GROUP BY ALL
    """,
)
def interval_means(spark, sf):
    """Mean in a closed interval, 0 where it is empty."""
    hits = I.point_join(A.points(spark, sf), A.intervals(spark, sf), "video_id", "t", "s", "e", 365)
    means = hits.groupBy("video_id", "seg_id").agg(F.avg("value").alias("m"))
    return A.intervals(spark, sf).select("video_id", "seg_id").join(means, ["video_id", "seg_id"], "left").select("video_id", "seg_id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"))


@query(
    "normalised_vectors",
    """
    WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN f + p > 0 THEN round(f / (f + p), 6) END AS f_share FROM c
    """,
)
def normalised_vectors(spark, sf):
    """Shares of the total, null where that is zero."""
    from reelgrid.functions.vectors import l1_normalise

    v = F.array(*[F.count_if(F.col("o_orderstatus") == s) for s in "FP"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(v.alias("v")).select("o_custkey", F.round(F.get(l1_normalise(F.col("v")), F.lit(0)), 6).alias("f_share"))


@query(
    "ensemble_vote",
    """
    WITH v AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, count(*) AS n, min(l_partkey) AS f FROM lineitem GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS rn FROM v)
    SELECT l_orderkey, CASE WHEN n / total >= 0.7 THEN label ELSE -1 END AS label, round(n / total, 6) AS confidence, CASE WHEN n / total >= 0.7 THEN ['anchor', 'reporter', 'guest'][label + 1] ELSE 'unsure' END AS role FROM t WHERE rn = 1
    """,
)
def ensemble_vote(spark, sf):
    """Majority of models with a confidence threshold, then names."""
    from reelgrid.functions.collections import lookup

    li = table(spark, sf, "lineitem").withColumn("label", F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"))
    v = G.ensemble_vote(li, ["l_orderkey"], "l_partkey", "label", 0.7)
    role = lookup({"0": "anchor", "1": "reporter", "2": "guest"}, F.col("label").cast("string"), "unsure")
    return v.select("l_orderkey", "label", F.round("confidence", 6).alias("confidence"), role.alias("role"))


@query("entity_first_mention", "SELECT p_type, p_name, min_by(p_partkey, p_partkey) AS qid FROM part GROUP BY 1, 2")
def entity_first_mention(spark, sf):
    """The first id of each label and type."""
    from reelgrid.operators.entities import first_seen

    return first_seen(table(spark, sf, "part").select("p_type", "p_name", F.col("p_partkey").alias("qid")), "p_name", "qid", ["qid"], ["p_type"])


@query(
    "annotation_stats",
    """
    SELECT coalesce(p_type, 'all') AS category, coalesce(p_brand, 'all') AS label, count(*) AS total, count(DISTINCT p_name) AS unique_names, grouping(p_type) + grouping(p_brand) AS level FROM part GROUP BY ROLLUP (p_type, p_brand)
    """,
)
def annotation_stats(spark, sf):
    """Totals and distinct labels by category and label, with subtotals."""
    return (
        table(spark, sf, "part")
        .rollup("p_type", "p_brand")
        .agg(F.count(F.lit(1)).alias("total"), F.count_distinct("p_name").alias("unique_names"), (F.grouping("p_type") + F.grouping("p_brand")).cast("long").alias("level"))
        .select(F.coalesce("p_type", F.lit("all")).alias("category"), F.coalesce("p_brand", F.lit("all")).alias("label"), "total", "unique_names", "level")
    )


@query(
    "heatmap_pivot",
    """
    SELECT event_type, count(*) FILTER (WHERE b = 1) AS bin_1, count(*) FILTER (WHERE b = 2) AS bin_2, count(*) FILTER (WHERE b = 3) AS bin_3
    FROM (SELECT event_type, ceil(k / 60) AS b FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS k FROM events) WHERE k > 0) GROUP BY 1
    """,
)
def heatmap_pivot(spark, sf):
    """Topic by right-closed bins of 60; a start of 0 falls out."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long") * 2).where("k > 0")
    p = G.pivot_counts(e, "event_type", F.ceil(F.col("k") / 60), [1, 2, 3])
    return p.select("event_type", *[F.col(str(i)).alias(f"bin_{i}") for i in (1, 2, 3)])


@query(
    "run_tallies",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed, count(*) AS total FROM orders GROUP BY 1",
)
def run_tallies(spark, sf):
    """Succeeded and failed runs."""
    from reelgrid.operators.incremental import tally

    return tally(table(spark, sf, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), "ok", ["o_orderpriority"])


@query(
    "cluster_samples",
    """
    WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), m AS (SELECT label, max(rn) AS n FROM r GROUP BY 1)
    SELECT r.label, vec_id, rn = n // 2 + 1 AS middle FROM r JOIN m USING (label) WHERE rn <= 25
    """,
)
def cluster_samples(spark, sf):
    """At most 25 samples a cluster, and its middle element."""
    w = Window.partitionBy("label")
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.row_number().over(w.orderBy("vec_id")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return e.where("rn <= 25").select("label", "vec_id", (F.col("rn") == F.floor(F.col("n") / 2) + 1).alias("middle"))


@query(
    "label_rows_to_vector",
    """
    SELECT o_custkey, max_by(o_orderpriority, s) AS top, max(CASE WHEN o_orderpriority = '1-URGENT' THEN s ELSE 0 END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN s ELSE 0 END) AS low
    FROM (SELECT o_custkey, o_orderpriority, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS s FROM orders GROUP BY 1, 2) GROUP BY 1
    """,
)
def label_rows_to_vector(spark, sf):
    """Rows of label and score to a top label and a fixed vector."""
    s = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("s"))
    at = lambda label: F.max(F.when(F.col("o_orderpriority") == label, F.col("s")).otherwise(F.lit(0)))
    return s.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "s").alias("top"), at("1-URGENT").alias("urgent"), at("5-LOW").alias("low"))


@query(
    "spaced_sample",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, rank FROM r WHERE rank IN (SELECT CAST(round_even(i * (n - 1) / 99, 0) AS BIGINT) FROM generate_series(0, 99) g(i))
    """,
)
def spaced_sample(spark, sf):
    """A hundred rows at evenly spaced ranks."""
    return G.evenly_spaced(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "rank")


@query(
    "first_videos",
    "SELECT o_custkey, min(o_orderkey) AS first_seen FROM orders GROUP BY 1 ORDER BY 2 LIMIT 20",
)
def first_videos(spark, sf):
    """The first twenty in order of appearance."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_seen")).orderBy("first_seen").limit(20)


@query(
    "set_operations",
    """
    SELECT 'all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'distinct', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier INTERSECT SELECT p_partkey FROM part)
    UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)
    """,
)
def set_operations(spark, sf):
    """Union all, union, intersection, difference."""
    c, s, p = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "part")
    nations = c.select(F.col("c_nationkey").alias("k")).unionByName(s.select(F.col("s_nationkey").alias("k")))
    ids = [x.select(F.col(k).alias("k")) for x, k in ((c, "c_custkey"), (s, "s_suppkey"), (p, "p_partkey"))]
    parts = {"all": nations, "distinct": nations.distinct(), "both": ids[0].intersect(ids[1]).intersect(ids[2]), "only": ids[0].exceptAll(ids[1]).distinct()}
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = n if out is None else out.unionByName(n)
    return out
