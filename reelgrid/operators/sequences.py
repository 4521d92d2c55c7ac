"""Islands, turns, spans and windows over ordered rows of a video."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.sources.staging import written


def islands(df: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """``df`` with ``island``: 0, 1, ... for runs of rows with one label; two nulls are one label."""
    w = Window.partitionBy(by).orderBy(*order)
    starts = F.when(F.row_number().over(w) == 1, 0).when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", starts).withColumn("island", F.sum("_c").over(running)).drop("_c")


def speaker_turns(segments: DataFrame, by="video_id", idx="idx", start="start_us", end="end_us", speaker="speaker", text="text", gap=10_000) -> DataFrame:
    """Turns of consecutive segments of one speaker, in order of start.

    A turn ends where its last segment ends, which may be earlier than another
    of its segments. A turn that starts ``gap`` or less after the turn before
    it ends, or earlier, starts ``gap`` after that end. Start may pass end;
    such turns stay. Times are whole units, by default microseconds.
    """
    runs = islands(segments, by, [start, idx], speaker)
    at = F.struct(start, idx)
    words = F.regexp_count(F.trim(text), F.lit(r"\S+"))
    turns = runs.groupBy(by, "island").agg(
        F.min(start).alias("_s"),
        F.max_by(end, at).alias("end"),
        F.min_by(speaker, at).alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, idx, F.trim(text).alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.sum(words).alias("n_words"),
    )
    w = Window.partitionBy(by).orderBy("island")
    before = F.lag("end").over(w)
    fixed = F.when(F.col("_s") - before <= gap, before + gap).otherwise(F.col("_s"))
    return turns.withColumn("start", fixed).select(by, F.col("island").alias("turn"), "start", "end", "speaker", "text", "n_words")


def speaker_turns_cut(segments: DataFrame, by="video_id", idx="idx", start="start_us", end="end_us", speaker="speaker", gap=10_000, unknown="Unknown") -> DataFrame:
    """Turns whose end is the latest of the first segment's end and the later segments' ends less ``gap``.

    Missing speakers are one speaker, ``unknown``. A turn that starts less
    than ``gap`` after the end before it starts ``gap`` after that end.
    """
    named = segments.withColumn("_sp", F.coalesce(speaker, F.lit(unknown)))
    runs = islands(named, by, [start, idx], "_sp")
    w = Window.partitionBy(by, "island").orderBy(start, idx)
    reach = runs.withColumn("_e", F.when(F.row_number().over(w) == 1, F.col(end)).otherwise(F.col(end) - gap))
    turns = reach.groupBy(by, "island").agg(F.min(start).alias("_s"), F.max("_e").alias("end"), F.min("_sp").alias("speaker"))
    before = F.lag("end").over(Window.partitionBy(by).orderBy("island"))
    fixed = F.when(F.col("_s") - before < gap, before + gap).otherwise(F.col("_s"))
    return turns.withColumn("start", fixed).select(by, F.col("island").alias("turn"), "start", "end", "speaker")


def speaker_turns_bridged(segments: DataFrame, by="video_id", idx="idx", start="start_us", end="end_us", speaker="speaker", bridge=3_000_000, margin=40_000) -> DataFrame:
    """Short pauses before the next segment are closed up to ``margin``, then neighbours of one speaker become one turn; rows keep their order."""
    w = Window.partitionBy(by).orderBy(idx)
    ahead = F.lead(start).over(w)
    closed = segments.withColumn("_e", F.when(ahead - F.col(end) < bridge, ahead - margin).otherwise(F.col(end)))
    runs = islands(closed, by, [idx], speaker)
    return runs.groupBy(by, "island").agg(F.min_by(start, idx).alias("start"), F.max_by("_e", idx).alias("end"), F.min_by(speaker, idx).alias("speaker")).withColumnRenamed("island", "turn")


def merged_labels(df: DataFrame, by: str, order: list[str], label: str, start: str, end: str) -> DataFrame:
    """Runs of one label: the first row's start and label, the last row's end."""
    at = F.struct(*order)
    return islands(df, by, order, label).groupBy(by, "island").agg(F.min_by(start, at).alias("start"), F.max_by(end, at).alias("end"), F.min_by(label, at).alias("label"), F.count(F.lit(1)).alias("n_rows"))


def transitions(df: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """Counts of (label, next label) over neighbouring rows."""
    nxt = F.lead(label).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("dst", nxt).where(F.col("dst").isNotNull()).groupBy(F.col(label).alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def spans(intervals: DataFrame, by: str, start: str, end: str, order: list[str], tolerance) -> DataFrame:
    """A timeline without gaps made from intervals in order of their end.

    One running end is kept, 0 at first. An interval that starts at it or less
    than ``tolerance`` after it is taken from there on, and to the next
    interval's start if that is less than the tolerance from its end, on
    either side. After a longer gap come a filler and the interval. Otherwise,
    and if the gap equals the tolerance, only the part after the running end is
    taken, if there is one.

    The fold runs over one video's intervals in an Arrow function, in linear time.
    """
    kind, key = intervals.schema[end].dataType.simpleString(), intervals.schema[by].dataType.simpleString()
    item = intervals.select(by, F.col(start).alias("s"), F.col(end).alias("e"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    names = [f"o{i}" for i in range(len(order))]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("e", *names, "s")])
        starts, ends = table["s"].to_pylist(), table["e"].to_pylist()
        at, out = 0, []
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            gap = s - at
            if 0 <= gap < tolerance:
                reached = starts[i + 1] if i + 1 < len(starts) and abs(starts[i + 1] - e) < tolerance else e
                out.append((at, reached))
            elif gap > tolerance:
                reached = e
                out += [(at, s), (s, e)]
            elif e > at:
                reached = e
                out.append((at, e))
            else:
                continue
            at = reached
        schema = table.schema
        cols = [pa.repeat(table[by][0], len(out)), pa.array(range(len(out)), pa.int32()), pa.array([s for s, _ in out], schema.field("e").type), pa.array([e for _, e in out], schema.field("e").type)]
        return pa.Table.from_arrays(cols, names=[by, "span", "start", "end"])

    return item.groupBy(by).applyInArrow(run, f"{by} {key}, span int, start {kind}, end {kind}")


def chain_edges(df: DataFrame, by: str, order: list[str], node: str) -> DataFrame:
    """(src, dst) of neighbouring rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(by, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where(F.col("dst").isNotNull())


def tumbling(turns: DataFrame, start: str, end: str, lengths: list, snap=None) -> DataFrame:
    """A row for each window of each length in each turn; the last is cut at the turn's end. Turns without length have none."""
    s = window_start(start, snap)
    each = F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length")
    rows = turns.where(F.col(end) > F.col(start)).select("*", each).withColumn("_s", s)
    n = F.ceil((F.col(end) - F.col("_s")) / F.col("length"))
    return rows.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("w_start", F.col("_s") + F.col("win") * F.col("length")).withColumn("w_end", F.least(F.col("w_start") + F.col("length"), F.col(end))).drop("_s")


def window_start(start: str, snap=None) -> Column:
    """Where a turn's first window starts."""
    return (F.floor(F.col(start) / snap) * snap) if snap else F.col(start)


def running_totals(asks: DataFrame, points: DataFrame, by: str, t: str, value: str, width: float) -> DataFrame:
    """``asks`` with ``n`` and ``total``, number and sum of the points of its key up to ``t``, and ``n_at`` and ``total_at``, of those just then.

    Points and asks share the columns ``by`` and ``t`` and stand in one order of
    time, cut into blocks of ``width``, each of which starts with the total of the blocks
    before it as a row of its own: one shuffle, and no task needs all rows of a key.
    Both sides are read twice.
    """
    block = F.floor(F.col(t) / F.lit(float(width))).alias("_b")
    own = [c for c in asks.columns if c not in (by, t)]
    p = points.where(F.col(by).isNotNull() & F.col(t).isNotNull() & F.col(value).isNotNull()).select(by, t, block, F.lit(1).cast("long").alias("n"), F.col(value).cast("double").alias("total"))
    a = asks.select(by, t, block, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(2).alias("_side"), *own)
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = p.unionByName(a.select(*p.columns)).groupBy(by, "_b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    past = totals.select(by, "_b", F.sum("n").over(before).alias("n"), F.sum("total").over(before).alias("total")).where("n > 0")
    first = past.select(by, F.lit(None).cast(asks.schema[t].dataType).alias(t), "_b", "n", "total", F.lit(0).alias("_side"))
    rows = a.unionByName(p.withColumn("_side", F.lit(1)), allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    upto = Window.partitionBy(by, "_b").orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    then = Window.partitionBy(by, "_b", t).orderBy("_side").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(w).alias(c + end) for w, end in ((upto, ""), (then, "_at")) for c in ("n", "total")]
    return rows.select(by, t, *own, "_side", *sums).where("_side = 2").drop("_side")


def _kind(*columns: tuple[DataFrame, str]) -> str:
    """Whole numbers are compared as such, all else as double."""
    return "long" if all(df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for df, c in columns) else "double"


def window_totals(windows: DataFrame, points: DataFrame, by: str, ids: list[str], start: str, end: str, t: str, value: str, width: float) -> DataFrame:
    """(by, ids, n, total): number and sum of the points in each closed window [start, end], which ``by`` and ``ids`` name.

    A window's total is the running total at its end less the one just before
    its start, so a point counts once however many windows it lies in and a
    window costs two rows, however long it is. Null values and times don't
    count; a window without a point has 0 and 0. Windows of a null key have none.
    Values that aren't whole carry the rounding of a key's running total.
    """
    kind = _kind((windows, start), (windows, end), (points, t))
    p = written(points.select(by, F.col(t).cast(kind).alias("_t"), F.col(value).alias("_v")), "points")
    ends = F.explode(F.array(F.struct(F.col(start).cast(kind).alias("t"), F.lit(True).alias("s")), F.struct(F.col(end).cast(kind).alias("t"), F.lit(False).alias("s")))).alias("_e")
    asks = written(windows.select(by, *ids, start, end), "windows").select(by, F.struct(*ids).alias("_w"), ends).select(by, F.col("_e.t").alias("_t"), F.col("_e.s").alias("_s"), "_w")
    run = running_totals(asks, p, by, "_t", "_v", width)
    part = lambda c: F.when(F.col("_s"), F.coalesce(f"{c}_at", F.lit(0)) - F.col(c)).otherwise(F.col(c))
    return run.select(by, "_w.*", part("n").alias("_n"), part("total").alias("_v")).groupBy(by, *ids).agg(F.sum("_n").alias("n"), F.sum("_v").alias("total"))


def pooled_windows(turns: DataFrame, points: DataFrame, by: str, idx: str, start: str, end: str, t: str, value: str, lengths: list, snap, width: float, quantile: float = 0.8) -> DataFrame:
    """(by, idx, length, n_windows, mean, quantile): the means of ``value`` in the windows of ``tumbling``, pooled over each turn.

    Means come from running totals (``running_totals``). Between two windows of
    whole times there is one row, which ends one and starts the next; a turn's rows
    meet once, and its windows are made of them in its row. Windows without a
    point count as zero. Rows of one ``by`` and ``idx`` share their windows' points.
    """
    kind = _kind((turns, start), (turns, end), (points, t))
    p = written(points.select(by, F.col(t).cast(kind).alias("_t"), F.col(value).alias("_v")), "points")
    long_turns = written(turns.where(F.col(end) > F.col(start)).select(by, F.col(idx).alias("_i"), window_start(start, snap).alias("_s"), F.col(end).alias("_e")), "turns")
    s, e = F.col("_s"), F.col("_e")

    def edges(number, length):
        at = lambda t, j, starts, ends: F.struct(F.lit(number).alias("l"), j.alias("j"), t.cast(kind).alias("t"), F.lit(starts).alias("s"), F.lit(ends).alias("e"))
        n = F.ceil((e - s) / length)
        if kind == "long" and isinstance(length, int):
            inner = F.when(n > 1, F.transform(F.sequence(F.lit(1).cast("long"), n - 1), lambda j: at(s + j * length, j, True, True)))
            outer = F.array(at(s, F.lit(0).cast("long"), True, False), at(e, n, False, True))
            return F.concat(outer, F.coalesce(inner, F.filter(outer, lambda _: F.lit(False))))
        windows = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.flatten(F.transform(windows, lambda j: F.array(at(s + j * length, j, True, False), at(F.least(s + j * length + length, e), j + 1, False, True))))

    asks = long_turns.select(by, "_i", F.explode(F.concat(*[edges(i, x) for i, x in enumerate(lengths)])).alias("_x")).select(by, "_i", F.col("_x.t").alias("_t"), F.struct("_x.l", "_x.j", "_x.s", "_x.e").alias("_x"))
    run = running_totals(asks, p, by, "_t", "_v", width)
    starts, ends = (lambda c: F.when(F.col("_x.s"), F.col(c) - F.col(f"{c}_at"))), (lambda c: F.when(F.col("_x.e"), F.col(c)))
    edge = F.struct("_x.l", "_x.j", starts("n").alias("sn"), starts("total").alias("sv"), ends("n").alias("en"), ends("total").alias("ev"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("l"), F.lit(x).alias("length")) for i, x in enumerate(lengths)])).alias("_l")
    rows = run.select(by, "_i", edge.alias("_x")).groupBy(by, "_i").agg(F.array_sort(F.collect_list("_x")).alias("_x")).select(by, "_i", each, "_x")
    side = lambda c: F.filter("_x", lambda x: (x["l"] == F.col("_l.l")) & x[c].isNotNull()).alias(f"_{c}")
    rows = rows.select(by, "_i", F.col("_l.length").alias("length"), side("sn"), side("en"))
    rows = rows.select("*", F.element_at("_en", -1)["j"].alias("_n"))
    total = lambda c, at, x: F.aggregate(F.filter(c, lambda y: y["j"] == at), F.lit(0.0), lambda done, y: done + y[x].cast("double"))
    parted = lambda j, x: F.when(F.size("_en") == F.col("_n"), (F.get("_en", j)["e" + x] - F.get("_sn", j)["s" + x]).cast("double")).otherwise(total("_en", j + 1, "e" + x) - total("_sn", j, "s" + x))
    means = F.transform(F.sequence(F.lit(0).cast("int"), F.col("_n").cast("int") - 1), lambda j: F.struct(parted(j, "n").alias("n"), parted(j, "v").alias("v")))
    rows = rows.select(by, "_i", "length", means.alias("_m"))
    rows = rows.select(by, "_i", "length", F.array_sort(F.transform("_m", lambda x: F.when(x["n"] > 0, x["v"] / x["n"]).otherwise(F.lit(0.0)))).alias("_m"))
    place = (F.size("_m") - 1) * F.lit(float(quantile))
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    between = F.when(low == high, F.get("_m", low)).otherwise((high - place) * F.get("_m", low) + (place - low) * F.get("_m", high))
    mean = F.aggregate("_m", F.lit(0.0), lambda done, x: done + x) / F.size("_m")
    return rows.select(by, F.col("_i").alias(idx), "length", F.size("_m").cast("long").alias("n_windows"), mean.alias("mean"), between.alias("quantile"))


def fixed_chunks(df: DataFrame, start: str, end: str, length, rest: bool) -> DataFrame:
    """Chunks of one length. ``rest`` keeps the last, shorter one; without it a longer row loses it, and a short row is one chunk."""
    span = F.col(end) - F.col(start)
    n = F.ceil(span / length) if rest else F.greatest(F.floor(span / length), F.lit(1))
    rows = df.where(span > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return rows.withColumn("c_start", F.col(start) + F.col("chunk") * length).withColumn("c_end", F.least(F.col("c_start") + length, F.col(end)))


#: Events farther than so many bandwidths add less than 2e-15 of one event's greatest share.
FAR = 8.25


def density(grid: DataFrame, events: DataFrame, by: str, t: str, at: str, bandwidth: float) -> DataFrame:
    """Gaussian density of ``events.at`` at each ``grid.t``, scaled to 0..1 in each video; null where it is constant.

    A grid point meets the events within ``FAR`` bandwidths, by cells of that
    width of which an event enters three; what is left out is below the
    rounding of the sum. Videos without an event have no rows.
    """
    cell = lambda x: F.floor(x / F.lit(float(FAR * bandwidth)))
    e = events.where(F.col(at).isNotNull()).select(F.col(by).alias("_k"), F.col(at).cast("double").alias("_at"))
    totals = e.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    near = e.groupBy("_k", "_at").agg(F.count(F.lit(1)).alias("_m")).select("*", F.explode(F.array(*[cell(F.col("_at")) + i for i in (-1, 0, 1)])).alias("_c"))
    points = grid.select(by, t).distinct().withColumn("_g", cell(F.col(t)))
    x = (F.col(t) - F.col("_at")) / F.lit(float(bandwidth))
    sums = points.join(near, (F.col(by) == F.col("_k")) & (F.col("_g") == F.col("_c")), "left").groupBy(by, t).agg(F.coalesce(F.sum(F.exp(-(x * x) / 2) * F.col("_m")), F.lit(0.0)).alias("_s"))
    y = sums.join(totals, F.col(by) == F.col("_k")).select(by, t, (F.col("_s") / F.col("_n") / (bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("_y"))
    w = Window.partitionBy(by)
    low, high = F.min("_y").over(w), F.max("_y").over(w)
    return y.select(by, t, F.try_divide(F.col("_y") - low, high - low).alias("y"))


def moving_average(df: DataFrame, by: str, order: str, value: str, reach: int = 2) -> DataFrame:
    """Centred mean, cut at the edges."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("smooth", F.avg(value).over(w))


def median_filter(df: DataFrame, by: str, order: str, value: str, kernel: int = 13) -> DataFrame:
    """Running median; beyond the edges values count as zero."""
    reach = kernel // 2
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)
    near = F.collect_list(F.col(value).cast("double")).over(w)
    full = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(near)))
    return df.withColumn("filtered", F.get(F.array_sort(full), F.lit(reach)))


def interpolated(df: DataFrame, by: str, t: str, values: list[str]) -> DataFrame:
    """A row for each whole t between the first and the last observed; values between are linear.

    Each observation opens the gap up to the next one: one window over the
    observations, no join and no window over the rows that are made. Rows
    without a first value are not observations. Rows that were ``dealt`` by
    ``by`` stay where they are, so a task is bounded by its observations.
    """
    ahead = F.lead(F.struct(t, *values)).over(Window.partitionBy(by).orderBy(t))
    pairs = df.where(F.col(values[0]).isNotNull()).select(by, F.struct(t, *values).alias("_p"), ahead.alias("_n"))
    at = F.when(F.col(f"_n.{t}") > F.col(f"_p.{t}"), F.sequence(F.col(f"_p.{t}"), F.col(f"_n.{t}") - 1)).otherwise(F.array(F.col(f"_p.{t}")))
    gap = F.col(f"_n.{t}") - F.col(f"_p.{t}")
    fill = lambda c: F.when((F.col("_n").isNull()) | (gap == 0), F.col(f"_p.{c}")).otherwise(F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * (F.col(t) - F.col(f"_p.{t}")) / gap)
    return pairs.select(by, F.explode(at).alias(t), "_p", "_n").select(by, t, *[fill(c).alias(c) for c in values])


def run_ranges(df: DataFrame, by: str, order: str, score: str, threshold: float) -> DataFrame:
    """Ranges of rows whose score doesn't exceed the threshold, between those that do: scenes between cuts."""
    w = Window.partitionBy(by).orderBy(order)
    cut = (F.col(score) > threshold).cast("int")
    begins = F.when((cut == 0) & (F.coalesce(F.lag(cut).over(w), F.lit(1)) == 1), 1).otherwise(0)
    runs = df.withColumn("_c", cut).withColumn("_b", begins).withColumn("scene", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.where("_c = 0").groupBy(by, "scene").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def full_batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows with their batch of ``size``; the last batch goes unless full."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by, "batch"))).where(F.col("_n") == size).drop("_n")
