"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside the groups.

Everything on the path is a DataFrame expression. Texts are hashed where they
are read; only 16-byte hashes, ids and lengths are shuffled. Whole texts travel
only for rows whose hash occurs twice, and only as (hash, text) pairs that the
map side has already folded, so a text with millions of copies is one row a
task. A group is accepted once its texts prove byte-equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import BLANKS, keyed_rows, scratch, small_side, text_or_empty, unused, written


def normalised(text: Column) -> Column:
    """``text`` without any character of ``[\\x20\\x09-\\x0D]``."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", hash128=content_hash, uid_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row_uid, id_col, keep_id, group_size, kept, text_sha256.

    row_uid is ``uid_col`` if given, a long unique to each row; else it is made
    here and tells rows of this result apart only.

    Texts are equal when their normalised forms are. Of equal texts the row with
    the most code points in its original text stays, then the smallest id.
    ``hash128`` maps a normalised text to its grouping hash. Equal hashes of
    different texts are told apart: the SHA-256 is part of the group's key, and
    each group's bytes are compared.

    Null text counts as empty; null ids sort last. Of rows that repeat an id and
    a text, one stays. An empty table gives an empty result. Other columns are
    not read, so their names can't clash. Texts of any length are hashed whole.
    """
    norm = normalised(text_or_empty(text_col))
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    texts = docs.select(uid.alias("row_uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("raw"), norm.alias("norm"))
    digests = written(
        texts.select(
            "row_uid",
            "id",
            F.char_length("raw").cast("long").alias("n_chars"),
            hash128(F.col("norm")).alias("h"),
            F.unhex(F.sha2("norm", 256)).alias("sha"),
        ),
        "digests",
    )
    best = F.struct((-F.col("n_chars")).alias("len"), F.col("id").isNull().alias("no_id"), "id", "row_uid")
    groups = written(
        digests.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best")).where("size > 1"),
        "groups",
    )
    _compare_bytes(texts, groups, hash128)
    chosen = small_side(groups.select("h", "sha", "size", F.col("best.id").alias("best_id"), F.col("best.row_uid").alias("best_uid")), 96)
    return digests.join(chosen, ["h", "sha"], "left").select(
        "row_uid",
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best_uid") == F.col("row_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _compare_bytes(texts: DataFrame, groups: DataFrame, hash128) -> None:
    """Compare the bytes inside each group of two or more; a difference stops the job rather than merge texts."""
    keys = small_side(groups.select("h", "sha"), 64)
    rows = texts.select(hash128(F.col("norm")).alias("h"), "norm")
    suspects = rows.join(small_side(groups.select("h").distinct(), 32), "h", "left_semi")
    distinct = suspects.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"))
    per_group = distinct.select("h", F.unhex(F.sha2("norm", 256)).alias("sha")).join(keys, ["h", "sha"], "left_semi").groupBy("h", "sha").agg(F.count(F.lit(1)).alias("texts"))
    if per_group.where("texts > 1").limit(1).count():
        raise RuntimeError("different texts share both hashes; give exact_dedup another hash128")


def without_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    The row that stays is the one that ``exact_dedup`` keeps: most code points,
    then the smallest id, a null id last; of rows alike in both one stays. Null
    text counts as empty. An empty table gives an empty result; columns of any
    name keep their values.
    """
    uid = unused(docs, "row_uid")
    with scratch():
        rows = keyed_rows(docs, id_col, uid)
        gone = written(exact_dedup(rows, id_col, text_col, uid_col=uid).where(~F.col("kept")).select(F.col("row_uid").alias(uid)), "copies", outer=True)
    return rows.join(small_side(gone, 8), uid, "left_anti").drop(uid)


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("row_uid")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
               FROM documents),
    r AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
          FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """
}
