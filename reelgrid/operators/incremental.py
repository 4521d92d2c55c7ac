"""Incremental runs: what is left to do, writes of finished parts, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(requested: DataFrame, done: DataFrame, keys: list[str], rewrite: bool = False) -> DataFrame:
    """Requested rows whose keys aren't done; all of them to rewrite."""
    return requested if rewrite else requested.join(done.select(*keys), keys, "left_anti")


def write_parts(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def tally(runs: DataFrame, ok: str, by: list[str]) -> DataFrame:
    """Succeeded, failed and all runs."""
    return runs.groupBy(*by).agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), F.count(F.lit(1)).alias("total"))
