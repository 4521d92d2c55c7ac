"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k least distinct 64-bit shingle hashes of a text. Sketches of
parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, text_or_empty
from reelgrid.llm.line_dedup import NO_ID, mixed

K = 128
WIDTH = 5
#: Rows of a bucket of neighbouring ids, about, until there are so many buckets; then buckets grow, read row by row.
BUCKET_ROWS, MOST_BUCKETS = 4_000, 20_000
#: Places drawn for each bucket's edge.
PICKS = 16
#: One odd factor for each place in a shingle.
FACTORS = mixed(np.arange(64, dtype=np.uint64), 1) | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes, sorted, of the word shingles of ``text`` in lower case A-Z; fewer words give one shingle, none give none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    width = min(width, len(w))
    n = len(w) - width + 1
    with np.errstate(over="ignore"):
        total = sum((w[i : i + n] * FACTORS[i] for i in range(width)), np.zeros(n, np.uint64))
    return np.unique(mixed(total, width))


def sketch(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    return shingles(text, width)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the texts together."""
    return np.unique(np.concatenate(sketches))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all shingles of both; 1 for two empty texts."""
    both = merge(a, b, k=k)
    return float(len(np.intersect1d(np.intersect1d(both, a, True), b, True)) / len(both)) if len(both) else 1.0


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k) / distinct_count(a, k))


def encoded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decoded(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id_col, fingerprint, n_distinct for each row of ``docs``.

    Null text counts as empty; a text without a word has the empty fingerprint
    and no shingle; null and repeated ids and repeated rows pass through; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        for b in in_pieces(batches):
            own = [sketch(t, k, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([encoded(s) for s in own], pa.string()), pa.array([distinct_count(s, k) for s in own], pa.float64())], ["id", "fingerprint", "n_distinct"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string, n_distinct double").withColumnRenamed("id", id_col)


def merged_sketches(sketched: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """key (JSON of ``by``), fingerprint: the sketch of all documents of each group.

    Partial merges on the map side keep at most ``k`` hashes a group and task.
    A null fingerprint counts as empty; nulls in ``by`` are groups of their
    own; repeated rows change nothing; an empty table gives an empty result.
    """

    def partial(batches):
        held: dict = {}
        for b in in_pieces(batches):
            for key, s in zip(b.column("key").to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
                new = decoded(s or "")
                held[key] = merge(held[key], new, k=k) if key in held else new[:k]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([encoded(s) for s in held.values()], pa.string())], ["key", "fingerprint"])

    keyed = sketched.select(F.to_json(F.struct(*by)).alias("key"), "fingerprint")
    schema = "key string, fingerprint string"
    once = keyed.mapInArrow(partial, schema)
    return once.repartition("key").mapInArrow(partial, schema)


def _cuts(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most ``MOST_BUCKETS`` places (key, mix) that part ``rows`` into ranges of about ``BUCKET_ROWS`` or more, from a sample drawn by hash."""
    parts = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    if parts == 1:
        return []
    chance = min(1.0, parts * PICKS / n)
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("key", "mix"), 2) < F.lit(int(2.0**62 * chance))).select("key", "mix").limit(4 * parts * PICKS).collect()
    places = sorted((r["key"], r["mix"]) for r in drawn)
    return sorted({places[i * len(places) // parts] for i in range(1, parts)}) if places else []


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, mix, id, text) with their bucket of neighbours, and the first rows of each bucket also, marked ``halo``, in the bucket before it.

    Buckets are ranges of (key, mix), so rows of one key part too. What reaches
    the driver is a bounded number of places and one row a bucket. The first
    bucket in descending order follows the last.
    """
    cuts = _cuts(rows, rows.count())
    group = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + group] for i in range(0, len(cuts), group)]
    before = lambda c: (c["k"] < F.col("key")) | ((c["k"] == F.col("key")) & (c["m"] < F.col("mix")))
    below = lambda keys, mixes: F.size(F.filter(F.arrays_zip(keys.alias("k"), mixes.alias("m")), before))
    if cuts:
        lit = lambda values, kind: F.lit(values).cast(kind)
        at = below(lit([c[0][0] for c in chunks], "array<bigint>"), lit([c[0][1] for c in chunks], "array<bigint>"))
        own = F.greatest(at, F.lit(1))
        inside = below(*[F.element_at(lit([[x[i] for x in c] for c in chunks], "array<array<bigint>>"), own) for i in range(2)])
        bucket = F.when(at == 0, 0).otherwise((at - 1) * group + inside)
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    tops = sorted((r["bucket"], *r["top"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("key", "mix")).alias("top")).collect())
    halo = rows.sparkSession.createDataFrame([(k, m, tops[(i + 1) % len(tops)][0]) for i, (_, k, m) in enumerate(tops)], "key long, mix long, above long")
    # One row a bucket, and buckets are bounded in number.
    placed = rows.join(F.broadcast(halo), ["key", "mix"], "left")
    place = lambda b, h: F.struct(b.alias("bucket"), F.lit(h).alias("halo"))
    both = F.when(F.col("above").isNull(), F.array(place(F.col("bucket"), False))).otherwise(F.array(place(F.col("bucket"), False), place(F.col("above"), True)))
    spread = placed.select("key", "mix", "id", "text", F.explode(both).alias("at")).select("id", "text", "key", "mix", "at.*")
    return spread.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "halo", F.col("key").desc(), F.col("mix").desc(), "text")


def edited_likeness(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited form, and the likeness to that and to the next document.

    The edited text is the text with its last third, floor(n/3) code points,
    replaced by as many first code points (or all) of the next document in
    descending order of ids; after the last comes the first. Null text counts
    as empty; null ids come last; rows that share an id are ordered by a hash of
    their text; a lone row follows itself; an empty table gives an empty result. Ids are
    integers. Other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("mix"), F.col(id_col).alias("id"), text.alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not rows.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def run(batches):
        last = None
        for b in in_pieces(batches):
            out = []
            for i, text, bucket, halo in zip(*(b.column(c).to_pylist() for c in ("id", "text", "bucket", "halo")), strict=True):
                now = (i, text, sketch(text, k, width), bucket, halo)
                if last and not last[4] and last[3] == bucket:
                    out.append(_compared(last, now, k, width))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field("id").type), *(pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), 1))], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _bucketed(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _compared(row, after, k, width):
    i, text, own = row[:3]
    third = len(text) // 3
    edited = text[: len(text) - third] + after[1][:third]
    changed = own if edited == text else sketch(edited, k, width)
    return i, len(text), hashlib.sha256(edited.encode()).hexdigest(), encoded(own), encoded(changed), resemblance(own, changed, k), resemblance(own, after[2], k)


def op8_fingerprints(spark, sf_dir):
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
