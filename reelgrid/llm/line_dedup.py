"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of repeated lines.

One scan emits a 128-bit hash for each distinct long line of a document; the
map side folds them, so a line of every document is one row a task. Hashes of
lines found in enough documents are dealt into shards of a bounded number of
keys, and each shard becomes a minimal perfect hash with arrays of
fingerprints, document counts and keepers. If all arrays together stay under a
measured bound they are broadcast and a second scan rewrites the documents
without moving them. Beyond the bound the line hashes travel to their shards,
hot shards being replicated, and only drop decisions travel back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import BLANKS, BROADCAST_BYTES, in_pieces, text_or_empty, written

#: Keys in a shard, about.
SHARD_KEYS = 250_000
#: Probes that one task takes for a shard, about.
SHARD_PROBES = 500_000
#: Bytes of array a key: fingerprint, count, keeper, and under four bits of hash.
KEY_BYTES = 21
LEVELS = 24
NO_ID = -(2**63)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over ``keys`` and ``seed``."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Distinct keys to 0..n-1. Each level is a bit array twice its keys; a key whose bit collides goes a level deeper."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.placed = 0
        rest = keys
        while len(rest) and len(self.bits) < LEVELS:
            m = max(64, -(-2 * len(rest) // 64) * 64)
            at = (mixed(rest, len(self.bits)) % np.uint64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            words = once.reshape(-1, 64).sum(axis=1)
            self.bits.append(np.packbits(once))
            self.ranks.append(self.placed + np.concatenate([[0], np.cumsum(words)[:-1]]))
            self.placed += int(words.sum())
            rest = rest[~once[at]]
        self.rest = rest

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it. Foreign keys may get any slot: compare fingerprints."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = (mixed(keys[todo], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            where = at[hit]
            word = bits.reshape(-1, 8)[where >> 6]
            before = np.unpackbits(word, axis=1) if len(word) else np.zeros((0, 64), np.uint8)
            mask = np.arange(64) < (where & 63)[:, None]
            out[todo[hit]] = ranks[where >> 6] + (before * mask).sum(axis=1)
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class LineShard:
    """A minimal perfect hash with the arrays it indexes. Keys of equal upper halves, should they occur, stay in a dict."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, count: np.ndarray, keep: np.ndarray):
        self.mph = MinimalPerfectHash(hi)
        slot = self.mph.index(hi)
        inside = ~np.isin(hi, self.mph.rest)
        n = self.mph.placed
        self.fingerprint, self.count, self.keep = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.int64)
        for array, values in ((self.fingerprint, lo), (self.count, count), (self.keep, keep)):
            array[slot[inside]] = values[inside]
        self.more = {(int(h), int(x)): (int(c), int(k)) for h, x, c, k in zip(hi[~inside], lo[~inside], count[~inside], keep[~inside], strict=True)}

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, keeper) of each line hash; 0 documents where the line isn't in the table."""
        slot = self.mph.index(hi)
        found = slot >= 0
        found[found] = self.fingerprint[slot[found]] == lo[found]
        count, keep = np.zeros(len(hi), np.int64), np.full(len(hi), NO_ID, np.int64)
        count[found], keep[found] = self.count[slot[found]], self.keep[slot[found]]
        for i in np.flatnonzero(~found) if self.more else ():
            count[i], keep[i] = self.more.get((int(hi[i]), int(lo[i])), (0, NO_ID))
        return count, keep


def line_hashes(lines: list[str], min_chars: int) -> list[bytes]:
    """For each line the 16-byte hash of its key, empty where the key is short."""
    out = []
    for line in lines:
        key = line.strip(BLANKS)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else b"")
    return out


def halves(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _emit(min_chars: int):
    """Batches of (id, text) to one row for each document and distinct long line."""

    def run(batches):
        for b in in_pieces(batches):
            hashes, docs = [], []
            for i, text in zip(_ids(b.column("id")).tolist(), b.column("text").to_pylist(), strict=True):
                own = set(line_hashes(text.split("\n"), min_chars)) - {b""}
                hashes += own
                docs += [i] * len(own)
            h = halves(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64())], ["hi", "lo", "id"])

    return run


def _rewrite(min_chars: int, lookup):
    """Batches to (id, n_lines, n_dropped, text). ``lookup(ids, hashes, batch, rows)`` says which hashed lines go."""

    def run(batches):
        for b in in_pieces(batches):
            ids = _ids(b.column("id"))
            split = [t.split("\n") for t in b.column("text").to_pylist()]
            hashed = [line_hashes(lines, min_chars) for lines in split]
            rows = np.repeat(np.arange(len(ids)), [len(h) for h in hashed])
            long = np.array([bool(x) for h in hashed for x in h], bool)
            goes = np.zeros(len(rows), bool)
            if long.any():
                goes[long] = lookup(ids[rows[long]], halves([x for h in hashed for x in h if x]), b, rows[long])
            kept, dropped, at = [], [], 0
            for lines in split:
                mark = goes[at : at + len(lines)]
                at += len(lines)
                dropped.append(int(mark.sum()))
                kept.append("\n".join([x for x, gone in zip(lines, mark.tolist(), strict=True) if not gone]) if dropped[-1] else "\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(x) for x in split], pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_lines", "n_dropped", "text"],
            )

    return run


def _probe_shards(shards: list[LineShard], ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    goes = np.zeros(len(h), bool)
    part = (h[:, 0] % np.uint64(len(shards))).astype(np.int64)
    for s in np.unique(part).tolist():
        at = np.flatnonzero(part == s)
        count, keep = shards[s].probe(h[at, 0], h[at, 1])
        goes[at] = (count > 0) & (keep != ids[at])
    return goes


def line_dedup(docs: DataFrame, id_col="doc_id", text_col="text", min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, n_lines, n_dropped, text for each row of ``docs``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in
    lower case. Keys of ``min_chars`` code points or more found in ``min_docs``
    rows or more lose their lines everywhere but under the largest id holding
    them. Null and empty texts are one empty line. Ids are integers; null ids
    count as smaller than any other. Rows that repeat an id decide alike. An
    empty table gives an empty result; other columns are not read. Lines and
    texts of any length are read whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    probes = rows.mapInArrow(_emit(min_chars), "hi long, lo long, id long")
    counted = probes.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    keys = written(counted.where(F.col("n") >= min_docs), "lines")
    n = keys.count()
    shards = max(1, -(-n // SHARD_KEYS))
    result = f"id {kind}, n_lines long, n_dropped long, text string"
    if n * KEY_BYTES <= broadcast_bytes:
        arrays = [(np.asarray(x, np.int64).view(np.uint64) if i < 2 else np.asarray(x)) for i, x in enumerate(keys.toArrow().columns)] if n else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)]
        part = arrays[0] % np.uint64(shards)
        table = spark.sparkContext.broadcast([LineShard(*[a[part == np.uint64(s)] for a in arrays]) for s in range(shards)])
        return rows.mapInArrow(_rewrite(min_chars, lambda ids, h, b, at: _probe_shards(table.value, ids, h)), result).withColumnRenamed("id", id_col)
    drops = _routed(keys, probes, shards)
    joined = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))).join(drops, "key", "left").select("id", "text", "drops")

    def listed(ids, h, b, at):
        own = b.column("drops").to_pylist()
        sets = {i: set(own[i] or ()) for i in np.unique(at).tolist()}
        return np.array([x.tobytes() in sets[i] for i, x in zip(at.tolist(), h.astype(">u8"), strict=True)], bool)

    return joined.mapInArrow(_rewrite(min_chars, listed), result).withColumnRenamed("id", id_col)


def _routed(keys: DataFrame, probes: DataFrame, shards: int) -> DataFrame:
    """(key, drops): for each id the hashes of the lines it loses, found by sending line hashes to the shards."""
    of_shard = F.pmod(F.shiftrightunsigned("hi", 1), F.lit(shards)).alias("shard")
    load = written(probes.groupBy(of_shard).agg(F.count(F.lit(1)).alias("probes")), "load")
    load = load.select("shard", F.ceil(F.col("probes") / SHARD_PROBES).cast("int").alias("copies"))
    left = probes.withColumn("shard", of_shard).join(load, "shard").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies"))).drop("copies")
    right = keys.withColumn("shard", of_shard).join(load, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1))).drop("copies")

    def probe(lines, table):
        unsigned = lambda t, c: t[c].to_numpy().view(np.uint64)
        shard = LineShard(unsigned(table, "hi"), unsigned(table, "lo"), table["n"].to_numpy(), table["keep"].to_numpy())
        count, keep = shard.probe(unsigned(lines, "hi"), unsigned(lines, "lo"))
        gone = (count > 0) & (keep != lines["id"].to_numpy())
        h = np.stack([unsigned(lines, "hi")[gone], unsigned(lines, "lo")[gone]], axis=1).astype(">u8")
        return pa.table({"key": pa.array(lines["id"].to_numpy()[gone]), "line": pa.array([x.tobytes() for x in h], pa.binary())})

    found = left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInArrow(probe, "key long, line binary")
    return found.groupBy("key").agg(F.collect_set("line").alias("drops"))


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT k.doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id <> r.keep) AS n_dropped,
           sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL OR k.doc_id = r.keep), '')) AS kept_sha256
    FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id
    """
}
