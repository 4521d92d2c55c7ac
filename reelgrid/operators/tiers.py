"""Annotation tiers: (video_id, tier, start_ms, end_ms, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.numeric import to_ms
from reelgrid.functions.text import after_colon, route_by_prefix, strip
from reelgrid.operators.aggregates import composite_majority
from reelgrid.operators.intervals import point_join


def tier(df: DataFrame, name: str, value: Column, start: str = "start", end: str = "end", forward: bool = True) -> DataFrame:
    """Intervals in seconds as annotations in whole milliseconds.

    After cutting to milliseconds, rows without length go; ``forward`` also
    drops rows that end before they start.
    """
    out = df.select("video_id", F.lit(name).alias("tier"), to_ms(F.col(start)).alias("start_ms"), to_ms(F.col(end)).alias("end_ms"), value.alias("value"))
    return out.where("start_ms < end_ms" if forward else "start_ms <> end_ms")


def shot_tier(shots: DataFrame) -> DataFrame:
    """Shots numbered from 0 among those that stay."""
    from pyspark.sql import Window

    kept = tier(shots, "shots", F.col("idx").cast("string"), forward=False).withColumn("_i", F.col("value").cast("long"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("_i")) - 1
    return kept.withColumn("value", n.cast("string")).drop("_i")


def turn_tiers(turns: DataFrame) -> DataFrame:
    return tier(turns, "speaker_turn", strip(F.col("speaker"))).unionByName(tier(turns, "transcript", strip(F.col("text"))))


def topic_tier(turns: DataFrame, topics: DataFrame) -> DataFrame:
    """topics(video_id, idx, topic); a turn without one has the value None."""
    return tier(turns.join(topics, ["video_id", "idx"], "left"), "topic", F.coalesce("topic", F.lit("None")))


def speaker_tiers(meta: DataFrame) -> DataFrame:
    out = tier(meta, "active_speaker", F.when(F.col("active"), "Yes").otherwise("No"))
    return out.unionByName(tier(meta, "speaker_role", F.col("role_l1"))).unionByName(tier(meta, "situation", F.col("situation")))


def majority_tier(shots: DataFrame, frames: DataFrame, name: str, width: float) -> DataFrame:
    """The majority over a shot's frames of their joined labels; None without a frame.

    frames(video_id, t, label_idx, label), label null where a frame has none.
    """
    hits = point_join(frames, shots.select("video_id", "idx", "start", "end"), "video_id", "t", "start", "end", width)
    vote = composite_majority(hits, ["video_id", "idx"], "t", "label", "label_idx")
    return tier(shots.join(vote, ["video_id", "idx"], "left"), name, F.coalesce("joined", F.lit("None")), forward=False)


def audio_tiers(rows: DataFrame, name: str) -> DataFrame:
    """rows(video_id, start, end, top3 array<struct<label, prob>>): labels, and probabilities with two decimals; null lists are empty."""
    top = F.coalesce("top3", F.array().cast("array<struct<label:string,prob:double>>"))
    labels = F.array_join(F.transform(top, lambda x: x["label"]), ", ")
    probs = F.array_join(F.transform(top, lambda x: F.round(x["prob"], 2).cast("string")), ", ")
    return tier(rows, f"{name}_clf", labels).unionByName(tier(rows, f"{name}_prob", probs))


#: Tier-name prefixes of manual annotation and their categories.
CATEGORIES = {"story": "story", "FEP": "FEP", "Strategy": "Strategy", "evaluative-talk": "evaluative-talk", "shots": "shots", "speaker_turn": "speaker_turn"}


def categorised(annotations: DataFrame) -> DataFrame:
    """Imported annotations with category and label; other tiers go. Shots and turns keep their value, others take the tier's."""
    c = route_by_prefix(F.col("tier"), CATEGORIES)
    label = F.when(c.isin("shots", "speaker_turn"), F.col("value")).otherwise(after_colon(F.col("tier")))
    return annotations.withColumn("category", c).where(F.col("category").isNotNull()).withColumn("label", label)


def annotation_statistics(annotations: DataFrame) -> DataFrame:
    """Totals by category and label, shots and turns left out."""
    return categorised(annotations).where(~F.col("category").isin("shots", "speaker_turn")).groupBy("category", "label").agg(F.count(F.lit(1)).alias("total"))
