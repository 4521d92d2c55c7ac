"""Streams give what the same functions give on the whole table."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from reelgrid.streaming import events as V

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def source(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    e.repartitionByRange(3, "ts").write.parquet(f"file://{tmp_path}/in")
    return e, V.stream(spark, f"file://{tmp_path}/in", e.schema.simpleString()[7:-1].replace(":", " "), 10)


def test_window_counts(spark, tmp_path):
    e, s = source(spark, tmp_path)
    at = lambda df: V.window_counts(V.with_event_time(df, "ts", "40 days"), "ts", "event_type", "value", "6 hours")
    run(at(s), "counts", "complete")
    assert spark.table("counts").count() == at(e).count()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == e.count()


def test_deduplicated(spark, tmp_path):
    e, s = source(spark, tmp_path)
    run(V.deduplicated(V.with_event_time(s.union(s), "ts", "40 days"), ["event_id"]), "once")
    assert spark.table("once").count() == e.count()


SEGMENT = "video_id long, idx long, start_us long, end_us long, speaker string, text string, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_online_turns_are_those_of_the_whole_table(spark, tmp_path, seed):
    """Segments arrive shuffled within ten minutes, a file a batch; a last row a day later closes each video."""
    from reelgrid.operators.sequences import speaker_turns

    pick, rows = random.Random(seed), []
    for video in (1, 2, 3):
        at = 1_700_000_000_000_000
        for i in range(120):
            at += pick.choice([0, 3_000, 20_000_000])
            rows.append((video, i, at, at + pick.choice([1_000, 5_000_000, 30_000_000]), pick.choice(["a", "a", "b", None]), pick.choice([" x y", "z", "", None])))
        rows.append((video, 120, at + 86_400_000_000, at + 86_400_000_001, "end", "end"))
        rows.append((video, 121, at + 2 * 86_400_000_000, at + 2 * 86_400_000_000 + 1, "after", "after"))
    whole = spark.createDataFrame([(*r, None) for r in rows], SEGMENT).withColumn("ts", F.timestamp_micros("start_us"))
    delayed = sorted(rows, key=lambda r: r[2] + pick.randrange(600_000_000))
    size, folder = 23, tmp_path / "in"
    for i in range(0, len(delayed), size):
        part = spark.createDataFrame([(*r, None) for r in delayed[i : i + size]], SEGMENT).withColumn("ts", F.timestamp_micros("start_us"))
        part.coalesce(1).write.mode("append").parquet(f"file://{folder}")
        time.sleep(0.05)
    s = V.stream(spark, f"file://{folder}", SEGMENT, 1)
    run(V.online_turns(s.withWatermark("ts", "11 minutes"), "ts"), f"turns{seed}")
    got = sorted(map(tuple, spark.table(f"turns{seed}").collect()), key=repr)
    want = speaker_turns(whole).select("video_id", "turn", "start", "end", "speaker", "text", "n_words").where("speaker IS NULL OR speaker NOT IN ('end', 'after')").collect()
    assert [r for r in got if r[4] != "end"] == sorted((tuple(r) for r in want), key=repr)
