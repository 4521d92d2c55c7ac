"""SimHash near-dedup by multi-index hashing.

A fingerprint's two 32-bit halves are indexed. Two fingerprints with at most
two differing bits differ in at most one bit of the upper half, or in none of
the lower; so each fingerprint fetches the Hamming ball of radius one of its
upper half, and its lower half as it is, and the fetched pairs are verified on
all 64 bits. A pair whose upper halves differ in one bit is fetched from the
side that lacks the bit, a pair with equal halves from the lesser side: half
of each ball is enough.

Only distinct fingerprints take part: copies meet in one row beforehand. A half
shared by more than ``HOT`` distinct fingerprints isn't paired; each of those
fingerprints looks up its whole ball of radius two among all fingerprints,
2,080 exact keys, so no bucket gives pairs in the square of its size and no
link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, scratch, small_side, text_or_empty, written
from reelgrid.llm.components import components

#: Distinct fingerprints with one half in common, above which balls are looked up whole.
HOT = 512

#: For each byte position and value, the eight bits.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
PLACES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, width: int) -> bytes:
    """XXH64 (seed 42, big-endian) of each word shingle, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return b""
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, 42) for s in shingles])


def fingerprint(text: str, width: int = 3) -> bytes:
    """Eight bytes, big-endian: each bit that over half of the shingle hashes have."""
    raw = shingle_hashes(text, width)
    if not raw:
        return bytes(8)
    n = len(raw) // 8
    counts = np.bincount((np.frombuffer(raw, np.uint8).reshape(n, 8) + PLACES).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((2 * (counts @ BITS) > n).ravel()).tobytes()


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row as a signed long."""

    def run(batches):
        for b in in_pieces(batches):
            raw = b"".join([fingerprint(t, width) for t in b.column("text").to_pylist()])
            fp = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def near_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): pairs of the distinct fingerprints ``nodes.fp`` with one or two differing bits, some twice."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    low_key = lower + F.lit(1 << 32)  # above the keys of the upper half
    entries = nodes.select("fp", F.explode(F.array(upper, low_key)).alias("key"))
    crowded = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    absent = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0)
    flips = F.transform(absent, lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    probes = nodes.select(F.col("fp").alias("u"), F.explode(F.concat(F.array(upper, low_key), flips)).alias("key"))
    table = entries.select(F.col("fp").alias("v"), F.col("key").alias("held"))
    some_crowded = crowded.limit(1).count() > 0
    if some_crowded:
        table = table.join(small_side(crowded.withColumnRenamed("key", "held"), 8), "held", "left_anti")
    own = (F.shiftrightunsigned("u", 32) == F.shiftrightunsigned("v", 32)) | (F.col("key") >= 1 << 32)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    links = probes.join(table, (F.col("key") == F.col("held")) & near & (~own | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("v"))).select("u", "v")
    if not some_crowded:
        return links
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    masks = bits + [a ^ b for a, b in combinations(bits, 2)]
    centres = entries.join(small_side(crowded, 8), "key", "left_semi").select("fp").distinct()
    ball = centres.select("fp", F.explode(F.lit(masks)).alias("mask")).select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("mask")).alias("v"))
    return links.union(ball.join(nodes.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v"))


def near_components(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 3) -> DataFrame:
    """id_col, fp long, fingerprint (hex), component_id for each row of ``docs``.

    Texts are lower-cased in A-Z and cut at ``[\\x20\\x09-\\x0D]``; the bits of
    the fingerprint are those that over half of the word shingles' XXH64 have.
    Rows whose fingerprints differ in two bits or fewer are linked;
    component_id is the least id that links reach. With fewer words than
    ``width`` the whole sequence is the shingle; null, empty and blank texts
    have fingerprint zero and are linked like any other. Null ids take part and
    are never a component_id unless a component has no other. Repeated rows
    share a component. An empty table gives an empty result; other columns are
    not read.
    """
    with scratch():
        fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints", outer=True)
        nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
        roots = components(near_links(nodes), "u", "v")
        placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        placed = written(placed.select("fp", "root", "least_id"), "placed")
        least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = written(placed.join(least, "root").select("fp", "component_id"), "named", outer=True)
    return fps.join(small_side(named, 24), "fp").select(
        F.col("id").alias(id_col), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op6_simhash(spark, sf_dir):
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")


QUERIES = {"op6_simhash": op6_simhash}
