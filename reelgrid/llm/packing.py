"""Packing: best-fit decreasing over a segment tree of remaining capacities.

One scan tokenizes each document, cuts it into full windows and a remainder,
and writes a row of numbers for each piece. The pieces are dealt by a hash of
their place, and of their row in the written table so that repeated rows part,
into groups of a bounded number of pieces; each group is packed on its own, so
a lost executor repeats one group. With tens of thousands of pieces in a group
the windows left open weigh nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.bpe import default_vocab, token_ids
from reelgrid.llm.common import in_pieces, text_or_empty, written

#: Pieces in a packing group, about.
GROUP_PIECES = 20_000


class OpenWindows:
    """Open windows by remaining capacity; the tightest that holds a piece is found in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, window: int) -> None:
        self.stacks[left].append(window)
        at = left + self.size
        while at and not self.tree[at]:
            self.tree[at] = True
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with ``need`` left, or None."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and not (at % 2 == 0 and self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        left = at - self.size
        window = self.stacks[left].pop()
        if not self.stacks[left]:
            self.tree[at] = False
            while at > 1:
                at >>= 1
                self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]
        return left, window


def best_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of one length keep their order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = opened.take(n)
        if found is None:
            found, made = (capacity, made), made + 1
        left, window[i] = found
        offset[i] = capacity - left
        if left > n:
            opened.put(left - n, int(window[i]))
    return window, offset


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", vocab: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens: each document's ids and ``end_id``, cut into full windows and a remainder."""
    path = vocab or default_vocab()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        ids_of = token_ids(path)
        for b in in_pieces(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = ids_of(text) + end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    row.append(i)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + capacity)]))
                    total.append(n)
            cols = [b.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, id_col="doc_id", text_col="text", vocab: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset.

    A document is its token ids, then ``end_id``; a null or empty text is that
    id alone. Overlong documents are first cut into full windows. Null and
    repeated ids are packed like others, one document a row; an empty table
    gives an empty result; other columns are not read. Offsets in a sequence
    run from 0 without a gap. Sequence ids are unique, not dense.
    """
    table = written(pieces(docs, id_col, text_col, vocab, capacity, end_id), "pieces")
    groups = max(1, -(-table.count() // GROUP_PIECES))
    kind = table.schema[id_col].dataType.simpleString()
    dealt = table.withColumnRenamed(id_col, "id").withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def place(key, rows):
        rows = rows.drop_columns("part").sort_by([(c, "ascending") for c in ("id", "start", "ids_crc32", "doc_tokens")])
        window, offset = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + window)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("part").applyInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def op4_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_packing": op4_packing}
