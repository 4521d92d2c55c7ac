"""What the operators share: tables in the shared folder, size-checked broadcasts, the word rule."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"

#: A side is broadcast only if its rows, measured beforehand, come to this many bytes at most.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local, as in tests, a temporary folder is made and
    recorded in the session; on a cluster the executors couldn't read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="reelgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of written tables, one list for each open scope.
_scopes: list[list] = []
#: Paths of tables written outside any scope, which go when the session's Python ends, or by ``sweep``.
_left: list[tuple] = []


@contextmanager
def scratch():
    """Tables that are written inside go when the block ends, but for those written with ``outer``."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def sweep() -> None:
    """Delete the tables written so far outside any scope. Results that were not saved elsewhere can't be read afterwards."""
    while _left:
        _delete(*_left.pop())


@atexit.register
def _sweep_at_exit() -> None:
    # The JVM may be gone by now; then nothing is left to ask.
    with suppress(Exception):
        sweep()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This cuts the lineage: a lost executor costs the tasks that read the table
    again, never the work that made it. ``outer`` hands the table to the scope
    around the innermost one; without a scope it stays until the session's
    Python ends or ``sweep`` is called, since a result may be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    if len(_scopes) > outer:
        _scopes[-1 - outer].append((spark, path))
    else:
        _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    _delete(df.sparkSession, df.written_path)


def keyed_rows(docs: DataFrame, id_col: str, uid: str) -> DataFrame:
    """``docs`` with a long ``uid`` unique to each row, the same at every reading.

    Unique integer ids serve as they are. Only if an id is null or repeats is
    the table written once more, with a number for each row.
    """
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int"):
        n = docs.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n"))
        if not n.where("n > 1 OR i IS NULL").limit(1).count():
            return docs.withColumn(uid, F.col(id_col).cast("long"))
    return written(docs.withColumn(uid, F.monotonically_increasing_id()), "documents", outer=True)


def small_side(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit`` bytes, else unchanged.

    ``df`` must be cheap to count (a written table). Unchanged means a shuffled
    join, whose skewed partitions adaptive execution splits.
    """
    fits = df.count() * row_bytes <= (BROADCAST_BYTES if limit is None else limit)
    return F.broadcast(df) if fits else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand workers so many rows at once. The setting stays in the session, as results are made after the caller has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def in_sample(id_col: str, chance):
    """True for a share ``chance`` (number or column) of all ids, by 62 bits of a fixed hash; false for null ids."""
    return F.col(id_col).isNotNull() & (F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2) < (F.lit(2.0**62) * chance).cast("long"))


def in_pieces(batches, rows: int = 500, most: int = 8 << 20):
    """Arrow batches cut to ``rows`` rows and, beyond one row, ``most`` bytes of text: what Python holds of them stays small."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
            end = min(b.num_rows, at + rows, max(at + 1, fits))
            yield b.slice(at, end - at)
            at = end


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks: added columns never clash with the input's own."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
