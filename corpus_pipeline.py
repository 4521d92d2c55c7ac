"""The corpus pipeline: stages over documents, each written and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import exact_dedup, language, neardup, packing, pii
from reelgrid.llm.common import small_batches, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification by output codes; documents without a letter or with an ambiguous language go.

    So null and empty texts go. Texts of any length are read whole; tied
    codewords are ambiguous; repeated rows are judged alike. Without a language
    to learn from all rows stay; an empty table gives an empty one.
    """
    small_batches(spark)
    return language.keep_identified(docs, language.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest original stays, then the smallest id, a null id last.

    Null text counts as empty; of rows alike in text and id one stays; texts
    of any length are hashed whole; an empty table gives an empty one.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over shingles of five words, similarity 0.8 or more; the smallest id of each group stays, a null id last.

    Null texts and texts without a word are one group; of rows that repeat an
    id one stays; texts of any length are compared whole; an empty table gives
    an empty one.
    """
    small_batches(spark)
    return neardup.without_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data by skip-chain field; what is found is replaced by its kind, and n_chars follows the new text.

    Null and empty texts stay as they are, repeated rows are changed alike, of
    spans that touch the same characters the earlier one counts, texts of any
    length are searched whole; an empty table gives an empty one.
    """
    small_batches(spark)
    return pii.redacted(docs, pii.learn(docs), length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens, a row for each piece.

    Null and empty texts are one piece of their end mark; texts of any length
    are cut into full windows first; repeated rows are packed each for itself;
    an empty table gives no piece.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express SimHash groups or the field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
