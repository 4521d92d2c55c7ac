"""A folder that driver and executors share, for tables that a query writes and reads back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


#: Folders handed out in this session, which go when its Python ends, or by ``sweep``.
_left: list[tuple[SparkSession, str]] = []


def sweep() -> None:
    """Delete what was staged so far. Results that were not saved elsewhere can't be read afterwards."""
    while _left:
        spark, path = _left.pop()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep_at_exit() -> None:
    # The JVM may be gone by now; then nothing is left to ask.
    with suppress(Exception):
        sweep()


def staging(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reelgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/staging/{uuid.uuid4().hex}"
    _left.append((spark, folder))
    return f"{folder}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new staging path and read back, so that what made it runs once."""
    path = staging(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
