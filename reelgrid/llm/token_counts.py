"""Token counts: whole vocabulary tokens are counted directly, only other pre-tokens are merged.

Which vocabulary strings encode alone as one token is proved when a worker
loads the vocabulary: each is cut by the pre-token pattern and merged. A scan
without a shuffle; a worker holds one vocabulary and a cache of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.bpe import default_vocab, token_count
from reelgrid.llm.common import in_pieces, text_or_empty


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text", vocab: str | None = None, limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Counts are those of the ``tokenizers`` library for the file ``vocab``
    without added special tokens; special strings inside a text count as it
    counts them. Null text counts as empty; null and repeated ids pass through;
    an empty table gives an empty result. Other columns are not read. Texts are
    never cut or padded.
    """
    path = vocab or default_vocab()

    def count(batches):
        n = token_count(path)
        for b in in_pieces(batches):
            tokens = [n(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_counts": op5_token_counts}
