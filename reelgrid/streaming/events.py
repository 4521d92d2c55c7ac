"""Structured Streaming over timed events.

Each function takes a streaming or a batch DataFrame and returns the same kind.
State is bounded by watermarks, or by the number of open turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream(spark, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A streaming read of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_event_time(df: DataFrame, t: str, late: str) -> DataFrame:
    """Zone-less times as timestamps, with a watermark."""
    return df.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def window_counts(df: DataFrame, t: str, by: str, value: str, length: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling or sliding windows."""
    w = F.window(t, length, slide) if slide else F.window(t, length)
    return df.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), by, "n", "total")


def sessions(df: DataFrame, t: str, by: str, gap: str) -> DataFrame:
    """Sessions closed by a gap."""
    return df.groupBy(F.session_window(t, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


TURN = "video_id long, turn int, start long, end long, speaker string, text string, n_words long"

#: The open turn of a video and what it needs to close, and the segments that may still be preceded.
TURN_STATE = "turn int, before long, first long, last long, speaker string, texts array<string>, n_words long, idx array<long>, starts array<long>, ends array<long>, speakers array<string>, words array<string>, counts array<long>"


def online_turns(segments: DataFrame, t: str, gap: int = 10_000) -> DataFrame:
    """The rows of ``speaker_turns`` as turns close, whatever order segments arrive in within the watermark on ``t``.

    segments(video_id, idx, start_us, end_us, speaker, text) with ``t``, the
    start as a timestamp that bears a watermark. A segment waits in its
    video's state until the watermark has passed its start, so none can come
    before it; then it joins the open turn or closes it. A turn is emitted when
    another speaker starts. The last turn of a video stays open, since more of
    it may come: a row that ends a stream, with a speaker of its own, closes
    it. Segments behind the watermark go. The state holds one turn
    and the segments of one watermark's delay.
    """
    rows = segments.select("video_id", "idx", "start_us", "end_us", "speaker", F.trim("text").alias("text"), F.coalesce(F.regexp_count(F.trim("text"), F.lit(r"\S+")), F.lit(-1)).cast("long").alias("n_words"), t)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, before, first, last, speaker, texts, n_words, *held = state.get if state.exists else (0, None, None, None, None, [], None, *([] for _ in range(6)))
        waiting = list(zip(*(list(x) for x in held), strict=True))
        texts = list(texts)
        if not state.hasTimedOut:
            for batch in batches:
                clean = batch.astype(object).where(batch.notna(), None)
                waiting += zip(clean["idx"], clean["start_us"], clean["end_us"], clean["speaker"], clean["text"], clean["n_words"], strict=True)
        waiting.sort(key=lambda r: (r[1], r[0]))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [r for r in waiting if r[1] < passed]
        waiting = waiting[len(ready) :]
        out = []
        for _, start, end, who, text, count in ready:
            if first is not None and who == speaker:
                last = end
            else:
                if first is not None:
                    begin = before + gap if before is not None and first - before <= gap else first
                    out.append((key[0], turn, begin, last, speaker, " ".join(texts), n_words))
                    turn, before = turn + 1, last
                first, last, speaker, texts, n_words = start, end, who, [], None
            if count >= 0:  # below zero without a text
                texts.append(text)
                n_words = (n_words or 0) + int(count)
        state.update((turn, before, first, last, speaker, texts, n_words, *([r[i] for r in waiting] for i in range(6))))
        if waiting:
            # The first that waits is due once the watermark has passed its millisecond.
            state.setTimeoutTimestamp(max(int(waiting[0][1]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        columns = ["video_id", "turn", "start", "end", "speaker", "text", "n_words"]
        made = pd.DataFrame(out, columns=columns, dtype=object)
        yield made.astype({"video_id": "int64", "turn": "int32", "start": "int64", "end": "int64", "n_words": "Int64"})

    return rows.groupBy("video_id").applyInPandasWithState(run, TURN, TURN_STATE, "append", "EventTimeTimeout")
