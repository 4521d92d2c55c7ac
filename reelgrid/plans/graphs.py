"""Graph, topic, tracking and ontology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import entities as E
from reelgrid.operators import graph as G
from reelgrid.operators import proximity, topics, tracking
from reelgrid.plans import adapters as A
from reelgrid.plans.registry import query, table


@query(
    "graph_nodes",
    f"""WITH {A.SHOTS} SELECT video_id, 'shot_' || idx AS id, 'shot' AS type, CAST(idx * 2.5 AS DOUBLE) AS start_time, CAST(idx * 2.5 + 2.25 AS DOUBLE) AS end_time, 'Shot ' || idx AS title FROM shots""",
)
def graph_nodes(spark, sf):
    """Interval nodes with times and titles."""
    s = A.shots(spark, sf)
    return G.interval_nodes(s, "video_id", "shot", "idx", F.col("idx") * 2.5, F.col("idx") * 2.5 + 2.25, F.concat(F.lit("Shot "), F.col("idx").cast("string")))


@query(
    "graph_edges",
    """
    WITH e AS (SELECT l_orderkey % 100 AS u, l_suppkey AS v, l_linenumber AS seq0, l_orderkey, l_partkey, l_quantity AS w FROM lineitem),
    p AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, w, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY l_orderkey DESC, seq0 DESC, l_partkey DESC, w DESC) AS rn FROM e)
    SELECT src, dst, w AS weight FROM p WHERE rn = 1
    """,
)
def graph_edges(spark, sf):
    """Undirected edges, the last insertion wins."""
    li = table(spark, sf, "lineitem")
    e = li.select((F.col("l_orderkey") % 100).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seq"))
    return G.upsert_edges(e, [], "seq").select("src", "dst", "weight")


@query(
    "label_edges",
    """
    SELECT o_custkey AS shot, o_orderpriority AS label, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS weight FROM orders GROUP BY 1, 2 HAVING avg(CAST(round(o_totalprice * 100) AS BIGINT)) > 25000000
    """,
)
def label_edges(spark, sf):
    """Edges to labels whose mean score exceeds a half."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("shot"), F.col("o_orderpriority").alias("label"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"))
    return G.thresholded_edges(o, ["shot"], "label", "score", 25_000_000)


@query(
    "entity_edges",
    """
    WITH m AS (SELECT l_suppkey AS video, l_orderkey AS turn, l_linenumber AS pos, l_partkey AS p, CASE WHEN l_returnflag = 'N' THEN 'unk' ELSE l_returnflag || l_linenumber END AS wd_label, 'text' || l_partkey AS text FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY video, wd_label ORDER BY turn, pos, p, text) AS rn FROM m)
    SELECT video, turn, pos, p, CASE WHEN wd_label = 'unk' THEN text ELSE wd_label END AS entity FROM r WHERE rn = 1 OR wd_label = 'unk'
    """,
)
def entity_edges(spark, sf):
    """The first mention of a linked entity, all mentions of unlinked ones."""
    m = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS video", "l_orderkey AS turn", "l_linenumber AS pos", "l_partkey AS p", "CASE WHEN l_returnflag = 'N' THEN 'unk' ELSE concat(l_returnflag, l_linenumber) END AS wd_label", "concat('text', l_partkey) AS text"
    )
    return G.entity_edges(m, "video", "wd_label", "text", ["turn", "pos", "p", "text"]).select("video", "turn", "pos", "p", "entity")


@query(
    "node_attributes",
    """
    SELECT c_custkey AS id, string_agg(k || '=' || v, ';' ORDER BY k) AS attrs FROM (
        SELECT o_custkey AS c_custkey, 'status/' || o_orderstatus AS k, CAST(count(*) AS VARCHAR) AS v FROM orders GROUP BY 1, 2
        UNION ALL SELECT c_custkey, 'segment/' || c_mktsegment, '1' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) GROUP BY 1
    """,
)
def node_attributes(spark, sf):
    """Flattened attribute maps merged on a node, absent features skipped."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.count(F.lit(1)).cast("string").alias("v"))
    a = G.attribute_map(o, ["id"], "status", "o_orderstatus", "v").withColumn("seq", F.lit(0))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", F.lit("1").alias("v"))
    b = G.attribute_map(c, ["id"], "segment", "c_mktsegment", "v").withColumn("seq", F.lit(1)).join(o.select("id").distinct(), "id", "left_semi")
    merged = G.upsert_nodes(a.unionByName(b), [], "seq")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return merged.select("id", text.alias("attrs"))


@query(
    "class_term_weights",
    r"""
    WITH w AS (SELECT source, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+'), lambda x: x NOT IN ('the', 'of', 'and')) AS ws FROM documents),
    t AS (SELECT source, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS term FROM w),
    c AS (SELECT source, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, sum(tf) AS f FROM c GROUP BY 1), a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM c GROUP BY source))
    SELECT source, term, tf, round(tf * ln(1 + a / f), 4) AS score FROM (SELECT c.*, f.f, a.a, row_number() OVER (PARTITION BY source ORDER BY tf * ln(1 + a / f) DESC, term) AS rank FROM c JOIN f USING (term), a) WHERE rank <= 15
    """,
)
def class_term_weights(spark, sf):
    """M2: class-based term weights over words and pairs, the best fifteen of each class."""
    d = table(spark, sf, "documents")
    counts = topics.term_counts(d, "source", "text", ["the", "of", "and"])
    top = topics.top_terms(topics.class_tfidf(counts, "source"), "source")
    return top.select("source", "term", "tf", F.round("score", 4).alias("score"))


@query(
    "topic_assignment",
    """
    WITH c AS (SELECT label AS topic, embedding::DOUBLE[] AS ce FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    s AS (SELECT vec_id, topic, list_cosine_similarity(embedding::DOUBLE[], ce) AS sim FROM embeddings, c)
    SELECT vec_id, topic, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rn FROM s) WHERE rn = 1
    """,
)
def topic_assignment(spark, sf):
    """Documents to the nearest of a fixed set of topic centres."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy(F.col("label").alias("topic")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return topics.assign_topics(e.select("vec_id", "embedding"), "embedding", first, "topic").withColumn("sim", F.round("sim", 6))


@query("topic_counts", "SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY 1")
def topic_counts(spark, sf):
    """M2: documents of each topic."""
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "near_vector_pairs",
    """
    SELECT a.label, a.vec_id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.75
    """,
)
def near_vector_pairs(spark, sf):
    """M1: pairs of a video within a cosine distance."""
    return proximity.near_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.75)


@query(
    "face_clusters",
    """
    WITH RECURSIVE d AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    e AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM d a JOIN d b ON a.label = b.label AND a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.75),
    r(a, b) AS (SELECT vec_id, vec_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS root, count(*) AS n FROM r GROUP BY 1),
    k AS (SELECT label, root, row_number() OVER (PARTITION BY label ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT label, root FROM c JOIN d USING (vec_id) WHERE n > 1))
    SELECT d.label, vec_id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM c JOIN d USING (vec_id) LEFT JOIN k ON k.label = d.label AND k.root = c.root AND c.n > 1
    """,
)
def face_clusters(spark, sf):
    """M1: density clusters of a video's vectors."""
    return tracking.cluster_vectors(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.75)


@query("reduced_face_clusters")
def reduced_face_clusters(spark, sf):
    """M1: clusters over the principal axes that hold 95 % of a video's variance; SQL has no such axes, a test recomputes them."""
    return tracking.cluster_reduced(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.5, 0.95)


@query("diverse_class_terms")
def diverse_class_terms(spark, sf):
    """M2: fifteen terms of each class by relevance (0.3) and difference (0.7); a fold, held against plain code in a test."""
    counts = topics.term_counts(table(spark, sf, "documents"), "source", "text", ["the", "of", "and"])
    return topics.diverse_terms(topics.class_tfidf(counts, "source"), "source", 0.7)


@query("face_tracks")
def face_tracks(spark, sf):
    """Greedy overlap tracks; sequential, so rows only."""
    li = table(spark, sf, "lineitem")
    f = li.select(
        F.col("l_suppkey").alias("shot"), F.unix_date(F.col("l_shipdate").cast("date")).alias("frame"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("face_id"),
        (F.col("l_quantity") / 10).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_quantity") / 10 + 8).alias("x2"), F.lit(8.0).alias("y2"),
    )
    return tracking.track_faces(f, ["shot"])


@query(
    "transitive_subclasses",
    """
    WITH e AS (SELECT p_partkey AS sub, p_partkey // 3 AS super FROM part WHERE p_partkey > 0),
    l1 AS (SELECT r_regionkey AS root, sub FROM region JOIN e ON super = r_regionkey), l2 AS (SELECT root, e.sub FROM l1 JOIN e ON e.super = l1.sub), l3 AS (SELECT root, e.sub FROM l2 JOIN e ON e.super = l2.sub)
    SELECT root, sub FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3
    """,
)
def transitive_subclasses(spark, sf):
    """Subclasses in one to three hops, distinct."""
    e = table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("sub"), F.floor(F.col("p_partkey") / 3).alias("super"))
    return E.transitive_subclasses(e, table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("root")), 3)


@query(
    "entity_facts",
    """
    SELECT c_custkey AS entity, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS finished, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    """,
)
def entity_facts(spark, sf):
    """Optional properties of entities from a table of triples."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("property"), F.col("o_orderkey").alias("object"))
    return E.entity_facts(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), t, {"finished": "F", "pending": "P"})
