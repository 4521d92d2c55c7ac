"""Property graphs as node and edge tables.

Nodes are (id, type, start_time, end_time, attrs); edges are undirected
(src, dst, weight, title) keyed by the unordered pair. Builders are pure
functions of DataFrames; ``upsert_nodes`` and ``upsert_edges`` give tables the
semantics of repeated insertion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name -> function (shots, turns, feature) -> (nodes, edges), for features that extend a graph.
PLUGINS: dict[str, Callable] = {}


def plugin(name: str):
    def add(f):
        PLUGINS[name] = f
        return f

    return add


def interval_nodes(df: DataFrame, by: str, kind: str, idx: str, start: Column, end: Column, title: Column) -> DataFrame:
    """A node for each interval, times rounded to two decimals."""
    return df.select(by, F.concat(F.lit(f"{kind}_"), F.col(idx).cast("string")).alias("id"), F.lit(kind).alias("type"), F.round(start, 2).alias("start_time"), F.round(end, 2).alias("end_time"), title.alias("title"))


def chain(nodes: DataFrame, by: str, order: Column) -> DataFrame:
    """Edges between consecutive nodes."""
    w = Window.partitionBy(by).orderBy(order)
    return nodes.select(by, F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where(F.col("dst").isNotNull())


def thresholded_edges(df: DataFrame, by: list[str], label: str, score: str, least: float, agg: str = "mean") -> DataFrame:
    """Edges from units to labels whose mean or median score exceeds ``least``."""
    pooled = F.median(score) if agg == "median" else F.avg(score)
    return df.groupBy(*by, label).agg(pooled.alias("weight")).where(F.col("weight") > least)


def entity_edges(mentions: DataFrame, by: str, label: str, text: str, order: list[str], unknown: str = "unk") -> DataFrame:
    """Edges from turns to entities: the first mention of a linked entity, and every mention of an unlinked one under its text."""
    w = Window.partitionBy(by, label).orderBy(*order)
    first = mentions.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | (F.col(label) == unknown)).drop("_r")
    return first.withColumn("entity", F.when(F.col(label) == unknown, F.col(text)).otherwise(F.col(label)))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The lesser end first."""
    return edges.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)})


def upsert_edges(edges: DataFrame, by: list[str], seq: str) -> DataFrame:
    """One edge a pair: the one inserted last replaces the others."""
    e = undirected(edges)
    keep = [c for c in e.columns if c not in (*by, "src", "dst")]
    last = e.groupBy(*by, "src", "dst").agg(F.max_by(F.struct(*keep), seq).alias("_e"))
    return last.select(*by, "src", "dst", *[F.col(f"_e.{c}").alias(c) for c in keep])


def upsert_nodes(nodes: DataFrame, by: list[str], seq: str, attrs: str = "attrs") -> DataFrame:
    """One node an id: attribute maps merged, later values winning."""
    entries = nodes.select(*by, "id", seq, F.explode(attrs).alias("key", "value"))
    last = entries.groupBy(*by, "id", "key").agg(F.max_by("value", seq).alias("value"))
    return last.groupBy(*by, "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(attrs))


def attribute_map(df: DataFrame, by: list[str], prefix: str, label: str, value: str) -> DataFrame:
    """Rows of label and value to one map of keys ``prefix/label``."""
    entry = F.struct(F.concat(F.lit(f"{prefix}/"), F.col(label)).alias("k"), F.col(value).alias("v"))
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("attrs"))


@plugin("labels")
def label_plugin(shots: DataFrame, turns: DataFrame, feature: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label nodes with edges to the shots they score over a half in."""
    edges = thresholded_edges(feature, ["video_id", "shot"], "label", "score", 0.5)
    nodes = edges.select("video_id", F.col("label").alias("id"), F.lit("label").alias("type")).distinct()
    return nodes, edges.select("video_id", F.concat(F.lit("shot_"), F.col("shot").cast("string")).alias("src"), F.col("label").alias("dst"), "weight")
