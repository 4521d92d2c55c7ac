"""Exact quantiles of groups of any size, by selection.

``percentile`` holds a group's distinct values in one task. Here groups of few
rows take that way; in a larger group the wanted ranks are narrowed down in
rounds: mergeable sketches give splitters between two bounds, one count of the
rows at and between the splitters tells where the rank lies, and what lies
elsewhere is not looked at again. The counts are exact, so the sketches only
decide how fast a round narrows, never what is found. A splitter is a region of
its own, so each round takes at least its splitters' copies away and heavy ties
end the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.sources.staging import written

#: Splitters of a round, and the accuracy of the sketch that they come from.
SPLITTERS, ACCURACY = 64, 2000

#: A group's rows that one task may order.
HELD = 1_000_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def ranked_values(rows: DataFrame, wanted: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """(keys, rank, x): the value at each 0-based rank of wanted(keys, rank, n) among a group's ``n`` rows(keys, x) in ascending order.

    ``x`` is never null or NaN and ranks are below ``n``. ``wanted`` holds few rows a group.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    named = lambda df: df.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    none = F.lit(None).cast("double")
    open_ = written(named(wanted).select(*names, "rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("before"), F.col("n").cast("long").alias("m")), "ranks")
    found = []
    between = (F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))
    near = lambda asked: rows.join(asked, _same(keys, names) & between).drop(*keys)
    at = [*names, "rank"]
    while not (large := open_.where(F.col("m") > held)).isEmpty():
        cuts = F.percentile_approx("x", [i / SPLITTERS for i in range(SPLITTERS + 1)], ACCURACY)
        splits = written(near(large).groupBy(*at, "lo", "hi", "before").agg(F.array_sort(F.array_distinct(cuts)).alias("cuts")), "splits")
        below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        # Region 2i lies below splitter i and region 2i + 1 is the splitter.
        region = 2 * below + F.coalesce(F.get("cuts", below) == F.col("x"), F.lit(False)).cast("int")
        sizes = near(splits).withColumn("region", region).groupBy(*at, "region").agg(F.count(F.lit(1)).alias("m"))
        past = F.coalesce(F.sum("m").over(Window.partitionBy(*at).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spots = sizes.withColumn("past", past).withColumnsRenamed({c: f"_s{c}" for c in at})
        here = splits.join(spots, _same(at, [f"_s{c}" for c in at]))
        into = F.col("rank") - F.col("before")
        spot = (F.col("region") / 2).cast("int")
        step = here.where((into >= F.col("past")) & (into < F.col("past") + F.col("m")))
        is_cut = F.col("region") % 2 == 1
        step = step.select(
            *at, F.when(is_cut, F.get("cuts", spot)).alias("x"), F.coalesce(F.when(spot > 0, F.get("cuts", spot - 1)), "lo").alias("lo"),
            F.coalesce(F.get("cuts", spot), "hi").alias("hi"), (F.col("before") + F.col("past")).alias("before"), "m",
        )
        step = written(step, "steps")
        found.append(step.where("x IS NOT NULL").select(*at, "x"))
        open_ = written(open_.where(F.col("m") <= held).unionByName(step.where("x IS NULL").drop("x")), "ranks")
    place = F.row_number().over(Window.partitionBy(*at).orderBy("x")) - 1
    out = near(open_).withColumn("_at", place).where(F.col("_at") == F.col("rank") - F.col("before")).select(*at, "x")
    for part in found:
        out = out.unionByName(part)
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float, str]], held: int = HELD, also: dict[str, Column] | None = None) -> DataFrame:
    """(by, names, also): exact quantiles of each group, as {name: (column, q, kind)}.

    The ``linear`` kind interpolates between the neighbouring ranks, as
    ``percentile`` does; the ``lower`` kind is the least value that a share of
    ``q`` of the rows doesn't exceed, as ``percentile_disc`` is. Nulls and NaN
    don't count; a group without any other value has null. Null keys are one
    group. Values are compared as doubles. ``also`` names other aggregates of each
    group. ``df`` is read twice, and once more for each round of a large group.
    """
    columns = sorted({c for c, _, _ in wanted.values()})
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    rows = df.select("*", *[x[c].alias(f"_x{i}") for i, c in enumerate(columns)])
    number = {c: i for i, c in enumerate(columns)}
    sizes = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"_x{i}").alias(f"_n{i}") for i in number.values()], *[a.alias(name) for name, a in (also or {}).items()]), "sizes")
    names = [f"_k{i}" for i in range(len(by))]
    large = sizes.where(F.col("_n") > held)

    def direct(c: str, q: float, kind: str) -> Column:
        return F.percentile(f"_x{number[c]}", q) if kind == "linear" else F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY _x{number[c]})")

    pooled = lambda some: some.groupBy(*by).agg(*[direct(*w).alias(name) for name, w in wanted.items()])
    def with_others(out: DataFrame) -> DataFrame:
        if not also:
            return out
        others = sizes.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], *also)
        return out.join(others, _same(by, names)).select(*by, *wanted, *also)

    if large.isEmpty():
        return with_others(pooled(rows))
    out = pooled(rows.join(large.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)]), _same(by, names), "left_anti"))
    top = large.select(*by)
    for name, (c, q, kind) in wanted.items():
        n = F.col(f"_n{number[c]}")
        place = (n - 1) * F.lit(float(q)) if kind == "linear" else F.greatest(F.ceil(n * F.lit(float(q))) - 1, F.lit(0))
        low = F.floor(place).cast("long")
        ask = large.where(n > 0).select(*by, F.explode(F.array_distinct(F.array(low, F.least(low + 1, n - 1)))).alias("rank"), n.alias("n"), low.alias("_low"), (place - low).alias("_part"))
        values = ranked_values(rows.select(*by, F.col(f"_x{number[c]}").alias("x")).where("x IS NOT NULL"), ask.select(*by, "rank", "n"), by, held)
        values = values.select(*[F.col(g).alias(k) for g, k in zip(by, names, strict=True)], F.col("rank").alias("_r"), "x")
        both = ask.join(values, _same([*by, "rank"], [*names, "_r"])).groupBy(*by)
        lower, upper = F.min("x"), F.max("x")
        got = both.agg((lower + (upper - lower) * F.max("_part") if kind == "linear" else lower).alias(name))
        top = top.join(got.withColumnsRenamed(dict(zip(by, names, strict=True))), _same(by, names), "left").drop(*names)
    return with_others(out.unionByName(top))
