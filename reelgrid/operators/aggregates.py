"""Votes, top lists, pooled vectors and other grouped summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.dealing import dealt


def majority(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label of each group, the least on ties, and its count."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("votes"), label)).alias(label), F.max("votes").alias("votes"))


def composite_majority(df: DataFrame, unit: list[str], member: str, label: str, order: str) -> DataFrame:
    """Majority over frames of their labels joined by underscores; a frame without a label votes for the empty text."""
    frames = df.groupBy(*unit, member).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, label))), lambda x: x[label]), "_").alias("joined"))
    return majority(frames, unit, "joined")


def ensemble_vote(df: DataFrame, by: list[str], model: str, label: str, confidence: float, unsure=-1) -> DataFrame:
    """The label of most models, the one met first on ties; ``unsure`` below the confidence."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.min(model).alias("first"))
    top = n.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), "first")).alias(label), F.max("n").alias("n"), F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return top.select(*by, F.when(share >= confidence, F.col(label)).otherwise(F.lit(unsure)).alias(label), share.alias("confidence"))


def top_renormalised(df: DataFrame, by: list[str], label: str, prob: str, k: int = 3) -> DataFrame:
    """Probabilities summed over chunks by label, divided by their total; the k greatest, labels ascending on ties."""
    s = df.groupBy(*by, label).agg(F.sum(prob).alias("_s"))
    w = Window.partitionBy(*by)
    ranked = s.withColumn("prob", F.try_divide(F.col("_s"), F.sum("_s").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.col("_s").desc(), label)))
    return ranked.where(F.col("rank") <= k).drop("_s")


def top_mean(df: DataFrame, by: list[str], label: str, prob: str) -> DataFrame:
    """The label with the greatest mean probability, and that mean."""
    m = df.groupBy(*by, label).agg(F.avg(prob).alias("_m"))
    return m.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("_m"), label)).alias(label), F.max("_m").alias("prob"))


def top_chunks(df: DataFrame, by: list[str], order: list, k: int = 3) -> DataFrame:
    """The first k rows of each group in order; labels may repeat."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def proportions(df: DataFrame, by: list[str], label: str, classes: list) -> DataFrame:
    """A column a class: its share of the group's rows."""
    return df.groupBy(*by).agg(*[(F.count_if(F.col(label) == c) / F.count(F.lit(1))).alias(f"share_{c}") for c in classes])


def count_vector(df: DataFrame, by: list[str], label: str, classes: list, other: str = "X") -> DataFrame:
    """A column a class with its count; labels outside the classes count as ``other``."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes], F.count_if(~F.col(label).isin(*classes)).alias(f"n_{other}"))


def presence(df: DataFrame, by: list[str], label: str, sample: str, score: str, least_score: float, samples: int = 5, least_ratio: float = 0.5) -> DataFrame:
    """Labels seen with a sufficient score in enough of a fixed number of samples; the divisor stays when fewer were taken."""
    seen = df.where(F.col(score) >= least_score).groupBy(*by, label).agg((F.count_distinct(sample) / samples).alias("ratio"))
    return seen.where(F.col("ratio") >= least_ratio)


def mean_vector(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """The element-wise mean of each group's vectors; null vectors don't count. Sums meet element by element, so no group is held whole."""
    x = df.where(F.col(vec).isNotNull()).select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("_i", "_x"))
    means = x.groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias(vec))


def pooled_vector(df: DataFrame, by: list[str], vec: str, order: str) -> DataFrame:
    """Long form of mean, greatest and last value of each dimension."""
    x = df.select(*by, order, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "_x"))
    return x.groupBy(*by, "dim").agg(F.avg("_x").alias("mean"), F.max("_x").alias("max"), F.max_by("_x", order).alias("last"))


def longest_visible(df: DataFrame, by: list[str], cluster: str, t: str, n_rows: int | None = None, on: list[str] = (), within: list[str] = ()) -> DataFrame:
    """Of each group the cluster seen over the longest time, the later one to appear on ties, with its extent.

    Rows without a cluster count only where a group has no other. With
    ``n_rows``, groups are summed up ``within`` the columns that rows lie by, then dealt by ``on``,
    some of ``by``, to as many tasks as these rows need.
    """
    c = df.groupBy(*by, cluster, *within).agg(F.min(t).alias("first_seen"), F.max(t).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    if n_rows is not None:
        parts = dealt(c.drop(*within), n_rows, *(on or by))
        c = parts.groupBy(*by, cluster).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))
    rank = F.struct(F.col(cluster).isNotNull(), (F.col("last_seen") - F.col("first_seen")), "first_seen", cluster)
    pick = lambda x: F.max_by(x, rank).alias(x)
    return c.groupBy(*by).agg(pick(cluster), pick("first_seen"), pick("last_seen"), pick("n"))


def speaking(df: DataFrame, by: list[str], score: str, least_ratio: float = 0.6) -> DataFrame:
    """Frames scored zero or more, their ratio, the mean score, and whether the ratio passes."""
    ratio = F.count_if(F.col(score) >= 0) / F.count(score)
    return df.groupBy(*by).agg(F.count_if(F.col(score) >= 0).alias("frames"), ratio.alias("ratio"), F.avg(score).alias("mean"), (ratio > least_ratio).alias("is_speaking"))


def ragged_mean(df: DataFrame, by: list[str], values: str, pad: float = -5.0) -> DataFrame:
    """Mean of lists position by position, short lists padded."""
    size = Window.partitionBy(*by)
    full = df.withColumn("_n", F.max(F.size(values)).over(size)).withColumn("_v", F.concat(F.col(values), F.array_repeat(F.lit(pad), F.col("_n") - F.size(values))))
    return full.select(*by, F.posexplode("_v").alias("pos", "_x")).groupBy(*by, "pos").agg(F.avg("_x").alias("mean"))


def pivot_counts(df: DataFrame, row: str, col, columns: list, name: str = "bin") -> DataFrame:
    """Counts of rows by fixed columns, absent ones 0."""
    out = df.withColumn(name, col).groupBy(row).pivot(name, columns).count()
    return out.fillna(0)


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Number of edge ends at each node; a loop counts twice."""
    ends = edges.select(F.col(src).alias("node")).union(edges.select(dst))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


#: Ranges that a global order is cut into.
RANGES = 256


def evenly_spaced(df: DataFrame, order: list[str], n: int, by: list[str] = ()) -> DataFrame:
    """At most ``n`` rows of each group at evenly spaced ranks in ``order``, ends included.

    The order is cut into ranges at rows that a hash picks, ``RANGES`` at most
    whatever the table's size. A row's range depends on its values alone, so the
    counts of the ranges and the ranks inside them agree however often the
    table is read and however it is partitioned. No task sees all rows of a
    group; ranges without a wanted rank are dropped before they are sorted.
    """
    place = [*by, *order]
    picked = df.select(*place).orderBy(F.xxhash64(*place), *place).limit(RANGES).orderBy(*place).collect()
    kinds = [df.schema[c].dataType for c in place]
    edge = lambda r: F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(place, r, kinds, strict=True)])
    here = F.struct(*[F.col(c) for c in place])
    part = F.size(F.filter(F.array(*map(edge, picked)), lambda e: e < here)) if picked else F.lit(0)
    placed = df.withColumn("_part", part)
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    sums = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(group))
    rank_of = lambda i: F.bround(i * (F.col("_total") - 1) / F.lit(max(1, n - 1)), 0).cast("long")
    everything = F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)
    ranks = F.when(F.col("_total") <= n, everything).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), rank_of))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    wanted = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_before", inside.alias("_wanted")).where(F.size("_wanted") > 0)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    ranked = placed.join(wanted, same).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)
    return ranked.where(F.array_contains("_wanted", F.col("_r"))).withColumn("rank", F.col("_r")).select(*df.columns, "rank")
