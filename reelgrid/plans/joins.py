"""Joins: on time, by position, by lookup, semi, anti and cross."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid.functions import numeric as N
from reelgrid.functions.vectors import dot
from reelgrid.operators import intervals as I
from reelgrid.operators.quantiles import quantiles
from reelgrid.operators.topics import best_by_label, fixed_vectors
from reelgrid.plans import adapters as A
from reelgrid.plans.registry import query, table
from reelgrid.sources.staging import written


def _valid(spark, sf):
    return A.intervals(spark, sf).where("e > s")


@query(
    "frames_in_shots",
    f"""
    WITH {A.INTERVALS}, {A.POINTS}, v AS (SELECT * FROM intervals WHERE e > s)
    SELECT v.video_id, seg_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, min(t) AS first_t, max(t) AS last_t
    FROM v JOIN points p ON p.video_id = v.video_id AND p.t BETWEEN v.s AND v.e GROUP BY ALL
    """,
)
def frames_in_shots(spark, sf):
    """Points in closed intervals."""
    hits = I.point_join(A.points(spark, sf), _valid(spark, sf), "video_id", "t", "s", "e", 365)
    return hits.groupBy("video_id", "seg_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), F.min("t").cast("long").alias("first_t"), F.max("t").cast("long").alias("last_t")
    )


@query(
    "series_in_shots",
    f"""
    WITH {A.INTERVALS}, {A.POINTS}, v AS (SELECT * FROM intervals WHERE e > s), m AS (SELECT video_id, max(t) AS last_t FROM points GROUP BY 1)
    SELECT v.video_id, seg_id, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS middle
    FROM v JOIN points p ON p.video_id = v.video_id AND p.t > v.s AND p.t <= v.e JOIN m ON m.video_id = v.video_id AND p.t < m.last_t GROUP BY ALL
    """,
)
def series_in_shots(spark, sf):
    """Samples in (s, e] but for the last, mean and median."""
    p = A.points(spark, sf)
    last = F.max("t").over(Window.partitionBy("video_id"))
    p = p.withColumn("last_t", last).where("t < last_t").drop("last_t")
    hits = written(I.point_join(p, _valid(spark, sf), "video_id", "t", "s", "e", 365, "left_open").select("video_id", "seg_id", "value"), "samples")
    out = quantiles(hits, ["video_id", "seg_id"], {"middle": ("value", 0.5, "linear")}, also={"n": F.count(F.lit(1)), "mean": F.round(F.avg("value"), 6)})
    return out.withColumn("middle", F.round("middle", 6))


@query(
    "labels_inside_spans",
    f"""
    WITH {A.INTERVALS}, {A.POINTS} SELECT DISTINCT v.video_id, seg_id, label
    FROM intervals v JOIN points p ON p.video_id = v.video_id AND p.t > v.s AND p.t < v.e
    """,
)
def labels_inside_spans(spark, sf):
    """Distinct labels in open intervals."""
    return I.point_join(A.points(spark, sf), A.intervals(spark, sf), "video_id", "t", "s", "e", 365, "open").select("video_id", "seg_id", "label").distinct()


def _two_kinds(spark, sf):
    v = _valid(spark, sf)
    a = v.where("seg_id % 2 = 0").selectExpr("video_id", "seg_id AS a_id", "s AS s1", "e AS e1")
    b = v.where("seg_id % 2 = 1").selectExpr("video_id", "seg_id AS b_id", "s AS s2", "e AS e2")
    return I.overlap_join(a, b, "video_id", "s1", "e1", "s2", "e2", 365)


PAIRS = f"""WITH {A.INTERVALS}, v AS (SELECT * FROM intervals WHERE e > s),
    pairs AS (SELECT a.video_id, a.seg_id AS a_id, b.seg_id AS b_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2,
                     greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / (a.e - a.s) AS share
              FROM v a JOIN v b ON a.video_id = b.video_id AND a.seg_id % 2 = 0 AND b.seg_id % 2 = 1 AND NOT (a.e <= b.s OR a.s >= b.e))"""


@query("interval_overlap_edges", f"{PAIRS} SELECT video_id, a_id, b_id FROM pairs")
def interval_overlap_edges(spark, sf):
    """Overlapping intervals, each pair once."""
    return _two_kinds(spark, sf).select("video_id", "a_id", "b_id")


def _shares(spark, sf):
    return _two_kinds(spark, sf).withColumn("share", N.overlap_share(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


@query(
    "fractional_overlap_first",
    f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, a_id ORDER BY b_id) AS rn FROM pairs WHERE share > 0.7) SELECT video_id, a_id, b_id, round(share, 6) AS share FROM r WHERE rn = 1",
)
def fractional_overlap_first(spark, sf):
    """The first match that covers more than 0.7 of the source."""
    hits = _shares(spark, sf).where("share > 0.7")
    return I.first_match(hits, ["video_id", "a_id"], ["b_id"]).select("video_id", "a_id", "b_id", F.round("share", 6).alias("share"))


@query(
    "sentiment_overlap_avg",
    f"{PAIRS} SELECT video_id, a_id, count(*) AS n, round(avg(b_id % 7), 6) AS mean FROM pairs WHERE share >= 0.8 GROUP BY ALL",
)
def sentiment_overlap_avg(spark, sf):
    """All matches that cover at least 0.8 of the source, averaged."""
    return _shares(spark, sf).where("share >= 0.8").groupBy("video_id", "a_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b_id") % 7), 6).alias("mean"))


@query("shots_per_turn", f"{PAIRS} SELECT video_id, a_id, count(*) AS n_shots FROM pairs WHERE share > 0 GROUP BY ALL")
def shots_per_turn(spark, sf):
    """Overlapping shots counted for each turn."""
    return _shares(spark, sf).where("share > 0").groupBy("video_id", "a_id").agg(F.count(F.lit(1)).alias("n_shots"))


@query(
    "nearest_asof",
    """
    WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
    b AS (SELECT user_id, epoch_us(ts) AS bt, min(event_id) AS b_id FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    c AS (SELECT a.user_id, event_id, b_id, abs(bt - t) AS d, row_number() OVER (PARTITION BY a.user_id, event_id ORDER BY abs(bt - t), bt) AS rn
          FROM a JOIN b USING (user_id))
    SELECT a.user_id, a.event_id, CASE WHEN c.d <= 7200000000 THEN c.b_id END AS b_id
    FROM a LEFT JOIN c ON c.user_id = a.user_id AND c.event_id = a.event_id AND rn = 1
    """,
)
def nearest_asof(spark, sf):
    """Nearest in time, either side, within a tolerance."""
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'click'").select("user_id", "event_id", "t")
    b = e.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("bt")).agg(F.min("event_id").alias("b_id"))
    return I.nearest(a, b, "user_id", "t", "bt", ["b_id"], 7_200_000_000).select("user_id", "event_id", "b_id")


@query(
    "entity_linking",
    """
    WITH m AS (SELECT c_custkey AS id, c_custkey % 50 AS turn, CAST(c_nationkey * 4 AS INT) AS s, CAST(c_nationkey * 4 + 10 AS INT) AS e, c_name AS text FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
    w AS (SELECT s_suppkey AS q, s_suppkey % 50 AS turn, CAST(s_nationkey * 4 + s_suppkey % 5 - 2 AS INT) AS f, CAST(s_nationkey * 4 + s_suppkey % 5 + 7 AS INT) AS t, s_acctbal / 10000 AS rank FROM supplier),
    c AS (SELECT m.id, w.q, row_number() OVER (PARTITION BY m.id ORDER BY rank DESC, q) AS rn FROM m JOIN w ON w.turn = m.turn AND w.f >= m.s - 2 AND w.t <= m.e + 2 AND rank >= 1e-4)
    SELECT m.id, coalesce('Q' || c.q, CASE WHEN p.p_partkey IS NOT NULL THEN 'P' || p.p_partkey END, 'unk') AS wd_id,
           CASE WHEN c.q IS NOT NULL THEN 'wikifier' WHEN p.p_partkey IS NOT NULL THEN 'search' ELSE 'unk' END AS disambiguation
    FROM m LEFT JOIN c ON c.id = m.id AND rn = 1 LEFT JOIN part p ON p.p_partkey = m.id * 2
    """,
)
def entity_linking(spark, sf):
    """Mention inside a character range, best rank, else search, else unknown."""
    from reelgrid.operators.entities import link_mentions

    m = table(spark, sf, "customer").where("c_mktsegment <> 'HOUSEHOLD'").selectExpr("c_custkey AS id", "c_custkey % 50 AS turn", "c_nationkey * 4 AS start", "c_nationkey * 4 + 10 AS end", "c_name AS text", "'PER' AS type")
    w = table(spark, sf, "supplier").selectExpr(
        "concat('Q', s_suppkey) AS qid", "s_suppkey AS seq", "s_suppkey % 50 AS turn", "s_nationkey * 4 + s_suppkey % 5 - 2 AS ch_from", "s_nationkey * 4 + s_suppkey % 5 + 7 AS ch_to", "s_acctbal / 10000 AS page_rank"
    )
    found = table(spark, sf, "part").selectExpr("p_partkey AS hit", "concat('P', p_partkey) AS search_id")
    linked = link_mentions(m, w, found, F.col("id") * 2 == F.col("hit"), ["id"], ["turn"])
    return linked.select("id", "wd_id", "disambiguation")


@query(
    "entity_search",
    """
    WITH t AS (SELECT DISTINCT upper(' ' || p_type) AS text FROM part WHERE p_size > 10),
    g AS (SELECT p_partkey AS qid, p_retailprice AS rank, lower(p_type) AS key FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey, p_retailprice, lower(p_brand || ' ' || p_type) FROM part WHERE p_size % 2 = 0),
    r AS (SELECT text, qid, row_number() OVER (PARTITION BY text ORDER BY rank DESC, qid) AS hit FROM t JOIN g ON key = lower(trim(text, ' ')))
    SELECT * FROM r WHERE hit <= 3
    """,
)
def entity_search(spark, sf):
    """The three best entries of a gazetteer for each text, by label or alias in one language."""
    from reelgrid.operators.entities import search_entities

    p = table(spark, sf, "part")
    g = p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("de").alias("lang"), F.col("p_type").alias("label"), F.array(F.concat_ws(" ", "p_brand", "p_type"), F.upper("p_type")).alias("aliases"), F.col("p_retailprice").alias("rank"))
    found = search_entities(p.where("p_size > 10").select(F.upper(F.concat(F.lit(" "), "p_type")).alias("text")), "text", g, "en", 3)
    return found.select("text", "qid", F.col("hit").cast("long").alias("hit"))


@query(
    "topic_lookup",
    "SELECT c_custkey, coalesce(s_name, 'None') AS topic FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def topic_lookup(spark, sf):
    """Lookup with a default."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "s_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("topic"))
    return I.left_fusion(c, [(s, "s_suppkey", {"topic": "None"})]).select(F.col("s_suppkey").alias("c_custkey"), "topic")


@query(
    "slot_lookup",
    """
    SELECT n.n_nationkey, a.r_name AS start_slot, b.r_name AS end_slot
    FROM nation n JOIN region a ON a.r_regionkey = n.n_regionkey JOIN region b ON b.r_regionkey = n.n_nationkey % 5
    """,
)
def slot_lookup(spark, sf):
    """One dimension joined twice."""
    n, r = table(spark, sf, "nation"), F.broadcast(table(spark, sf, "region"))
    a = r.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("start_slot"))
    b = r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("end_slot"))
    return n.join(a, "n_regionkey").join(b, F.col("n_nationkey") % 5 == F.col("k")).select("n_nationkey", "start_slot", "end_slot")


@query(
    "face_fusion_left",
    """
    SELECT o_orderkey, coalesce(c_name, 'none') AS track, n_name AS cluster, coalesce(l.n, 0) AS speaking, coalesce(l.n, 0) > 3 AS is_speaking
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 7
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey
    """,
)
def face_fusion_left(spark, sf):
    """Detections with track, cluster and activity, each with its default."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS o_custkey", "c_name AS track", "c_nationkey")
    n = table(spark, sf, "nation").where("n_nationkey <> 7").selectExpr("n_nationkey AS c_nationkey", "n_name AS cluster")
    act = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("speaking"))
    fused = I.left_fusion(o, [(c, "o_custkey", {"track": "none"}), (n, "c_nationkey", {}), (act, "o_orderkey", {"speaking": 0})])
    return fused.select("o_orderkey", "track", "cluster", "speaking", (F.col("speaking") > 3).alias("is_speaking"))


@query(
    "count_checks",
    """
    SELECT o_orderstatus, count(*) AS a, count(o_custkey) AS b, count(DISTINCT o_orderkey) AS c, true AS ok FROM orders GROUP BY 1
    """,
)
def count_checks(spark, sf):
    """Counts that must agree."""
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("a"), F.count("o_custkey").alias("b"), F.count_distinct("o_orderkey").alias("c"))
    return I.checked_counts(o, ["a", "b", "c"])


@query(
    "positional_lists",
    """
    WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_type = 'click'),
    b AS (SELECT user_id, event_id AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_type = 'view')
    SELECT a.user_id, a.idx, a.event_id, b.other FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.idx = b.idx
    """,
)
def positional_lists(spark, sf):
    """Lists joined by position; the left survives."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    a = e.where("event_type = 'click'").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "event_id")
    b = e.where("event_type = 'view'").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("event_id").alias("other"))
    return I.positional_join(a, b, "user_id", strict=False)


@query(
    "prompt_scores",
    """
    WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT label, embedding::DOUBLE[] AS pe FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 4),
    s AS (SELECT f.vec_id, label, max(list_dot_product(e, pe)) AS best FROM f, p GROUP BY ALL)
    SELECT vec_id, label, round(best, 6) AS best, round(exp(best) / sum(exp(best)) OVER (PARTITION BY vec_id), 6) AS prob FROM s
    """,
)
def prompt_scores(spark, sf):
    """Every frame against a fixed set of prompts (four vectors a label), best per label, softmax over labels, all inside the row."""
    e = table(spark, sf, "embeddings")
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn <= 4")
    kind = e.schema["label"].dataType.simpleString()
    scored = e.select("vec_id", best_by_label(F.col("embedding"), fixed_vectors(first, "label", "embedding"), dot, kind).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x["best"]))
    each = scored.withColumn("total", total).select("vec_id", "total", F.inline("s"))
    return each.select("vec_id", "label", F.round("best", 6).alias("best"), F.round(F.exp("best") / F.col("total"), 6).alias("prob"))


@query("bin_grid", "SELECT CAST(l_discount * 100 AS BIGINT) // 3 AS bx, CAST(l_tax * 100 AS BIGINT) // 2 AS by_, count(*) AS n FROM lineitem GROUP BY ALL")
def bin_grid(spark, sf):
    """Rows of each pair of bins, which is one grouping."""
    cents = lambda c: F.floor(F.round(F.col(c) * 100))
    return table(spark, sf, "lineitem").groupBy(F.floor(cents("l_discount") / 3).alias("bx"), F.floor(cents("l_tax") / 2).alias("by_")).agg(F.count(F.lit(1)).alias("n"))


@query("selected_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def selected_semi(spark, sf):
    """Rows on a selection list."""
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("new_only_antijoin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def new_only_antijoin(spark, sf):
    """What isn't done yet."""
    from reelgrid.operators.incremental import pending

    done = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return pending(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query(
    "rule_cascade",
    """
    WITH b AS (SELECT o_custkey AS entity, o_orderkey AS seq, o_orderstatus AS cls, o_totalprice FROM orders),
    r AS (SELECT entity, seq, CASE WHEN cls = 'P' THEN 1 WHEN o_totalprice > 400000 THEN 2 WHEN o_totalprice < 50000 THEN 4 END AS rule FROM b),
    f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq, rule) AS rn FROM r WHERE rule IS NOT NULL)
    SELECT c_custkey AS entity, CASE rule WHEN 1 THEN 'EVENT' WHEN 2 THEN 'ORG' WHEN 4 THEN 'LOC' ELSE CASE WHEN len(regexp_extract_all(c_name, '\\S+')) > 1 THEN 'EPER' ELSE 'LPER' END END AS type
    FROM customer LEFT JOIN f ON entity = c_custkey AND rn = 1
    """.replace("\\\\", "\\"),
)
def rule_cascade(spark, sf):
    """Ordered rules over bindings, the first match types the entity, else names decide."""
    from reelgrid.operators.entities import first_rule, person_type

    b = table(spark, sf, "orders").selectExpr("o_custkey AS entity", "o_orderkey AS seq", "o_orderstatus AS cls", "o_totalprice AS price")
    rules = [(F.col("cls") == "P", "EVENT"), (F.col("price") > 400000, "ORG"), (F.lit(False), "PER"), (F.col("price") < 50000, "LOC")]
    typed = first_rule(b, "entity", "seq", rules)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_name")
    return c.join(typed, "entity", "left").select("entity", F.coalesce("rule_type", person_type(F.col("c_name"), F.lit("wikifier"))).alias("type"))


#: A gazetteer of the benchmark's items: pairs of neighbouring words name an item, words of eight letters or more are its aliases.
_WORDS = r"[\p{L}\p{N}]+"
_GAZETTEER = rf"""
    b AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM benchmark),
    g AS (SELECT qid, array_to_string(w[i : i + 1], ' ') AS name, CAST(len(w) AS DOUBLE) AS weight FROM b, unnest(generate_series(1, len(w) - 1)) x(i)
          UNION SELECT qid, x, len(w) FROM (SELECT qid, w, unnest(w) AS x FROM b) WHERE length(x) >= 8),
    h AS (SELECT name, qid, weight / sum(weight) OVER (PARTITION BY name) AS prior FROM g),
    n AS (SELECT name, qid, prior FROM h QUALIFY sum(-prior * log2(prior)) OVER (PARTITION BY name) <= 3),
    long AS (SELECT DISTINCT qid, name FROM g WHERE length(name) >= 10 AND name NOT LIKE '% %'),
    links AS (SELECT DISTINCT a.qid AS src, b.qid AS dst FROM long a JOIN long b ON a.name = b.name AND a.qid <> b.qid)"""

_ROUNDS = 4


def _ranks() -> str:
    """Rounds of page rank, one table each."""
    step = """r{i} AS (
        SELECT begin.doc_id, begin.qid, begin.v * (0.15 + 0.85 * coalesce(lost, 0)) + 0.85 * coalesce(moved, 0) AS v FROM begin
        LEFT JOIN (SELECT e.doc_id, e.dst AS qid, sum(r.v / deg.n) AS moved FROM edges e JOIN r{j} r ON r.doc_id = e.doc_id AND r.qid = e.src JOIN deg ON deg.doc_id = e.doc_id AND deg.src = e.src GROUP BY 1, 2) m
            ON m.doc_id = begin.doc_id AND m.qid = begin.qid
        LEFT JOIN (SELECT r.doc_id, sum(r.v) AS lost FROM r{j} r LEFT JOIN deg ON deg.doc_id = r.doc_id AND deg.src = r.qid WHERE deg.n IS NULL GROUP BY 1) l ON l.doc_id = begin.doc_id)"""
    return "r0 AS (SELECT * FROM begin), " + ", ".join(step.format(i=i + 1, j=i) for i in range(_ROUNDS))


@query(
    "text_annotations",
    rf"""
    WITH {_GAZETTEER},
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORDS}') AS w, [length(x) FOR x IN regexp_extract_all(text, '([^\p{{L}}\p{{N}}]*)([\p{{L}}\p{{N}}]+)', 1)] AS gap,
                 [length(x) FOR x IN regexp_extract_all(text, '{_WORDS}')] AS size FROM documents),
    p AS (SELECT doc_id, i, w[i] AS w, sum(gap[i] + size[i]) OVER (PARTITION BY doc_id ORDER BY i) AS stop, size[i] AS size FROM d, unnest(generate_series(1, len(w))) x(i)),
    q AS (SELECT doc_id, w, stop - size AS start, stop, w || ' ' || lead(w) OVER o AS pair, lead(stop) OVER o AS pair_stop FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    names AS (SELECT DISTINCT name FROM n),
    s AS (SELECT doc_id, name, start, stop FROM q JOIN names ON name = w UNION ALL SELECT doc_id, name, start, pair_stop FROM q JOIN names ON name = pair),
    c AS (SELECT doc_id, qid, sum(prior) AS v FROM s JOIN n USING (name) GROUP BY 1, 2),
    begin AS (SELECT doc_id, qid, v / sum(v) OVER (PARTITION BY doc_id) AS v FROM c),
    edges AS (SELECT a.doc_id, src, dst FROM begin a JOIN links ON src = a.qid JOIN begin z ON z.doc_id = a.doc_id AND z.qid = dst),
    deg AS (SELECT doc_id, src, count(*) AS n FROM edges GROUP BY 1, 2),
    {_ranks()}
    SELECT s.doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", s.name, n.qid, round(v, 6) AS page_rank
    FROM s JOIN n USING (name) JOIN r{_ROUNDS} r ON r.doc_id = s.doc_id AND r.qid = n.qid
    """,
)
def text_annotations(spark, sf):
    """The benchmark's items that whole documents may name, where, and their page rank in the document."""
    from reelgrid.operators.annotate import annotate

    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    long = F.array_distinct(F.filter("w", lambda x: F.length(x) >= 8))
    names = F.when(F.size("w") > 1, F.concat(pairs, long)).otherwise(long)
    g = b.select("qid", F.get(names, F.lit(0)).alias("label"), names.alias("aliases"), F.size("w").cast("double").alias("weight"))
    longer = b.select("qid", F.explode(F.array_distinct(F.filter("w", lambda x: F.length(x) >= 10))).alias("x"))
    links = longer.withColumnRenamed("qid", "src").join(longer.withColumnRenamed("qid", "dst"), "x").where("src <> dst").select("src", "dst").distinct()
    found = annotate(table(spark, sf, "documents"), "doc_id", "text", g, links, rounds=_ROUNDS)
    return found.select("doc_id", "start", "end", "name", "qid", F.round("page_rank", 6).alias("page_rank"))
