"""The benchmark tables seen as feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.plans.registry import table


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Speech segments from events: video_id, idx, start_us, end_us, speaker, text; times are whole microseconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(w) - 1).alias("idx"),
        start.alias("start_us"),
        (start + F.floor(F.col("value") * 600000000)).alias("end_us"),
        F.col("event_type").alias("speaker"),
        F.col("props").alias("text"),
    )


SEGMENTS = """segments AS (
    SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
           epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(value * 600000000) AS BIGINT) AS end_us,
           event_type AS speaker, props AS text
    FROM events)"""


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Shots from embeddings: video_id, idx, embedding."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(w) - 1).alias("idx"), "vec_id", "embedding")


SHOTS = """shots AS (
    SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id, embedding::DOUBLE[] AS e
    FROM embeddings)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals from orders and their lines, in days: video_id, seg_id, s, e. Some end before they start."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.unix_date(F.col("l_shipdate").cast("date"))).alias("e"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("seg_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("s"))
    return o.join(last, o.seg_id == last.l_orderkey).select("video_id", "seg_id", "s", "e")


INTERVALS = """intervals AS (
    SELECT o_custkey AS video_id, o_orderkey AS seg_id, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS s,
           (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey) - DATE '1970-01-01' AS e
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Timed samples from lines, in days: video_id (customer), t, value, label."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("video_id"), F.unix_date(F.col("l_shipdate").cast("date")).alias("t"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("label")
    )


POINTS = """points AS (
    SELECT o_custkey AS video_id, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t, l_quantity AS value, l_returnflag AS label
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
