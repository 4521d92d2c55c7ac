"""Rows dealt to as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task where a row becomes many or meets many.
ROWS = 100_000


def dealt(df: DataFrame, n_rows: int, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` by hash of ``by`` in partitions of about ``rows`` (``ROWS``) of its ``n_rows``, which adaptive execution leaves as they are.

    Adaptive execution joins partitions by the bytes that were shuffled, which
    say little where rows are made after the shuffle: a task would then grow with the table.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-n_rows // (rows or ROWS))), *by)
