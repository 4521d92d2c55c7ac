"""Joins on time.

A plain theta join on intervals plans as a nested loop. These joins put
intervals into buckets and join on (key, level, bucket), so they are ordinary
hash or sort-merge joins that adaptive execution can split; the exact
condition is part of the join. A level's buckets are ``STEP`` times as wide as
those of the level below, and an interval lies on the level of its length, in
``STEP`` + 1 buckets at most, however long it is. A point asks one bucket on
each level that occurs. A width near the usual interval length keeps most
intervals on level 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.dealing import dealt

#: Named conditions of a point t in [s, e].
INSIDE = {
    "closed": lambda t, s, e: (t >= s) & (t <= e),
    "open": lambda t, s, e: (t > s) & (t < e),
    "left_open": lambda t, s, e: (t > s) & (t <= e),
    "right_open": lambda t, s, e: (t >= s) & (t < e),
}


def bucket_width(intervals: DataFrame, s: str, e: str) -> float:
    """The median length of the intervals that have one, at least one unit: one small aggregate."""
    got = intervals.where(F.col(e) > F.col(s)).agg(F.percentile_approx(F.col(e) - F.col(s), 0.5)).first()[0]
    return max(1.0, float(got or 1.0))


#: Buckets of one level under a bucket of the next.
STEP = 16


def _level(s: Column, e: Column, width: float) -> Column:
    """The level on which an interval spans ``STEP`` buckets or fewer; 0 where it has no length."""
    ratio = (e - s) / F.lit(float(width * STEP))
    return F.when(ratio > 1, F.ceil(F.log(float(STEP), ratio))).otherwise(F.lit(0)).cast("int")


def levels_in_use(intervals: DataFrame, s: str, e: str, width: float) -> list[int]:
    """The levels that occur, ascending: one small aggregate, a few numbers whatever the table."""
    return sorted(r[0] for r in intervals.select(_level(F.col(s), F.col(e), width)).distinct().collect()) or [0]


def _at(x: Column, width: float, level: int) -> Column:
    return F.floor(x / F.lit(float(width * STEP**level)))


def spread(intervals: DataFrame, s: str, e: str, width: float, levels: list[int], upward: bool = False) -> DataFrame:
    """Intervals with own level ``_own``, once for each bucket ``_b`` = (l, b) of that level, or ``upward`` of that one and all above."""
    own, a, z = _level(F.col(s), F.col(e), width), F.col(s), F.col(e)

    def buckets(level):
        at = F.when(z >= a, F.sequence(_at(a, width, level), _at(z, width, level))).otherwise(F.array(_at(a, width, level)))
        return F.transform(at, lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))

    none = F.array().cast("array<struct<l:int,b:bigint>>")
    on = [F.when((own <= m) if upward else (own == m), buckets(m)).otherwise(none) for m in levels]
    return intervals.withColumn("_own", own).withColumn("_b", F.explode(F.concat(*on)))


def point_join(points: DataFrame, intervals: DataFrame, key: str, t: str, s: str, e: str, width: float, ends: str = "closed", how: str = "inner", n_rows: int | None = None) -> DataFrame:
    """Each point with the intervals of its key that it lies in. Apart from ``key`` the sides share no column.

    ``how`` is "inner", or "left" to keep intervals without a point, as
    "right" keeps points without an interval. Null times match nothing.
    With ``n_rows``, the number of points or more, an inner join is dealt to as
    many tasks as these rows need, and the buckets it met in stay as ``_bl`` and ``_bb``.
    """
    if how == "left":
        hits = point_join(points, intervals.select(key, s, e).distinct(), key, t, s, e, width, ends)
        return intervals.join(hits, [key, s, e], "left")
    levels = levels_in_use(intervals, s, e, width)
    if how == "right" and len(levels) > 1:
        hits = point_join(points.select(key, t).distinct(), intervals, key, t, s, e, width, ends)
        return points.join(hits, [key, t], "left").select(*points.columns, *[c for c in intervals.columns if c != key])
    wide = spread(intervals, s, e, width, levels).withColumnRenamed(key, "_k").withColumnsRenamed({"_b": "_c"}).drop("_own")
    asks = [F.struct(F.lit(m).alias("l"), _at(F.col(t), width, m).alias("b")) for m in levels]
    placed = points.withColumn("_b", asks[0] if len(levels) == 1 else F.explode(F.array(*asks)))
    if n_rows is not None and how == "inner":
        flat = lambda df, b: df.select("*", F.col(f"{b}.l").alias(f"{b}l"), F.col(f"{b}.b").alias(f"{b}b")).drop(b)
        level = len(levels) > 1  # one level is a constant, which Spark leaves out of the join's keys
        placed, wide = dealt(flat(placed, "_b"), n_rows, key, *["_bl"] * level, "_bb"), dealt(flat(wide, "_c"), n_rows, "_k", *["_cl"] * level, "_cb")
        same = (placed[key] == wide["_k"]) & (F.col("_bl") == F.col("_cl")) & (F.col("_bb") == F.col("_cb"))
        return placed.join(wide, same & INSIDE[ends](F.col(t), F.col(s), F.col(e))).drop("_cl", "_cb", "_k")
    same = (placed[key] == wide["_k"]) & (F.col("_b.l") == F.col("_c.l")) & (F.col("_b.b") == F.col("_c.b"))
    return placed.join(wide, same & INSIDE[ends](F.col(t), F.col(s), F.col(e)), "left" if how == "right" else "inner").drop("_b", "_c", "_k")


def overlap_join(left: DataFrame, right: DataFrame, key: str, s1: str, e1: str, s2: str, e2: str, width: float) -> DataFrame:
    """Pairs of intervals with one key that overlap: not (e1 <= s2 or s1 >= e2).

    Each pair is emitted once, on the level of the longer one and in the
    bucket of the later start. Intervals that end before they start match only
    under the condition as written.
    """
    levels = sorted({*levels_in_use(left, s1, e1, width), *levels_in_use(right, s2, e2, width)})
    a = spread(left, s1, e1, width, levels, upward=True).withColumnRenamed("_own", "_l1")
    b = spread(right, s2, e2, width, levels, upward=True).withColumnsRenamed({key: "_k", "_own": "_l2", "_b": "_c"})
    start = F.greatest(F.col(s1), F.col(s2))
    later = F.coalesce(*[F.when(F.col("_b.l") == m, _at(start, width, m)) for m in levels])
    same = (a[key] == b["_k"]) & (F.col("_b.l") == F.col("_c.l")) & (F.col("_b.b") == F.col("_c.b"))
    once = (F.col("_b.l") == F.greatest("_l1", "_l2")) & (F.col("_b.b") == later)
    return a.join(b, same & once & ~((F.col(e1) <= F.col(s2)) | (F.col(s1) >= F.col(e2)))).drop("_b", "_c", "_k", "_l1", "_l2")


def nearest(left: DataFrame, right: DataFrame, key: str, t1: str, t2: str, payload: list[str], tolerance: float | None = None) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` nearest in time, the earlier on ties; null beyond the tolerance.

    One union and one sort by (key, time): no pair is formed. Rows of a key
    share a window.
    """
    cols = [F.col(c) for c in payload]
    own = [c for c in left.columns if c not in (key, t1)]
    mark = F.struct(F.col("_t").alias("t"), *cols)
    a = left.select(F.col(key), F.col(t1).alias("_t"), F.lit(1).alias("_side"), F.struct(*map(F.col, own)).alias("_row"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload])
    b = right.select(F.col(key), F.col(t2).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *payload)
    seen = F.when(F.col("_side") == 0, mark)
    order = [F.col("_t"), F.col("_side")]
    back = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_p", F.last(seen, True).over(back)).withColumn("_n", F.last(seen, True).over(ahead)).where("_side = 1")
    dp, dn = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    pick = F.when(dn.isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    if tolerance is not None:
        pick = F.when(F.abs(pick["t"] - F.col("_t")) <= tolerance, pick)
    return both.withColumn("_m", pick).select(key, F.col("_t").alias(t1), *[F.col(f"_row.{c}").alias(c) for c in own], F.col("_m.t").alias(t2), *[F.col(f"_m.{c}").alias(c) for c in payload])


def first_match(matches: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each group, the first in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def left_fusion(left: DataFrame, parts: list[tuple[DataFrame, str | list[str], dict]]) -> DataFrame:
    """Left joins of side tables by key, absent values replaced by each part's defaults; a key's last row wins elsewhere."""
    out = left
    for part, on, defaults in parts:
        out = out.join(part, on, "left")
        if defaults:
            out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out


def checked_counts(counts: DataFrame, columns: list[str]) -> DataFrame:
    """``counts`` with ``ok``; a consumer may ``assert_true`` on it: the columns of a row agree."""
    first = F.col(columns[0])
    agree = F.lit(True)
    for c in columns[1:]:
        agree = agree & first.eqNullSafe(F.col(c))
    return counts.withColumn("ok", agree)


def positional_join(left: DataFrame, right: DataFrame, key: str, idx: str = "idx", strict: bool = True) -> DataFrame:
    """Rows at one position together. Strict keeps positions that both have; else rows of ``left`` survive."""
    return left.join(right, [key, idx], "inner" if strict else "left")
