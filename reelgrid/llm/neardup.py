"""Near duplicates by similarity of word shingles: SimHash candidates from multi-index hashing, then an exact check.

A node is a distinct set of shingles, named by the least uid of its rows; a
128-bit hash of the whole set tells sets apart. The words of its SimHash after
the first also hold the segments of the index. The width of a segment follows
the logarithm of the number of rows, and the number of segments follows from
the recall that is asked for at the similarity threshold. Each segment fetches
its Hamming ball of radius one; a pair is fetched from the side that lacks the
differing bit. Sets of ``SHORT`` shingles at most, whose bits differ by other
odds, also have keys of their own: so many of their rarest shingles that two
similar sets share one.

Fetched pairs are verified on 128 bits inside the join, then on ``WIDE`` words
more, within limits that lose about ``LOSS`` of the pairs at the threshold, and
what passes by the Jaccard similarity of the whole shingle sets. Wide words and
sets are made only for the nodes of fetched pairs.

Groups cost about their size, not its square. First the holders of each key
with more than ``CROWDED`` of them are compared with one leader: the holder
that is most at home in crowded keys, so the middle of its group. What is
linked falls into components. Nodes that are near each other by the leaders,
linked or not, form families; the nodes of families of over ``BUSY`` are busy,
and so is, in ``TOUCHES`` rounds, what has one of them in its balls. Pairs of
busy nodes are compared only between different components: the node of the
smaller one asks, in keys where a larger one is held, and all words are tested
inside the join. The index gives the pairs of all other nodes, and of what the
last round added. No link between components is lost.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, keyed_rows, scratch, small_side, text_or_empty, unused, written
from reelgrid.llm.components import components
from reelgrid.llm.line_dedup import mixed
from reelgrid.llm.simhash import BITS, PLACES
from reelgrid.llm.sketches import shingles

WIDTH, SIMILARITY, RECALL, CROWDED, BUSY, TOUCHES = 5, 0.8, 0.99, 4, 16, 2
#: A key of a segment is held by about two to the power of this, by chance.
OCCUPANCY = 4
#: Words whose segments find leaders.
LED_WORDS = 4
#: Segments that are looked at to emit a busy pair once.
ONCE = 32
#: Words of 64 bits of the wide distance test, the first not among them.
WIDE = 63
#: Sets of so many shingles at most also meet by their rarest shingles.
SHORT = 36
#: Share of the pairs at the threshold that one test of the bits may lose.
LOSS = 1e-5
#: Keys from here on are shingles, keys below are segments: their number above ``SEGMENT_BITS`` bits.
SHINGLE, SEGMENT_BITS = 1 << 61, 48
#: Mixing with seed 100 after adding so many strides is mixing with the seeds that follow.
STRIDE = np.uint64(0x9E3779B97F4A7C15)
#: Marks a node's own key, where pairs are fetched from one side only.
OWN = 1 << 62


def exact_odds(a: int, b: int, c: int) -> float:
    """Chance that a bit differs between sets with ``c`` shingles in common and ``a`` and ``b`` of their own."""
    coins = lambda n: np.array([math.comb(n, i) for i in range(n + 1)]) / 2.0**n
    above = lambda n: np.array([coins(n)[2 * (x + np.arange(n + 1)) > c + n].sum() for x in range(c + 1)])
    u, v = above(a), above(b)
    return float((coins(c) * (u * (1 - v) + v * (1 - u))).sum())


@lru_cache(maxsize=64)
def bit_odds(similarity: float, short: bool = False) -> float:
    """Greatest chance that a bit differs between sets of at least this Jaccard similarity; ``short``: of ``SHORT`` at most."""
    unions = range(2, SHORT + 1) if short else range(SHORT + 1, SHORT + 41)
    exact = [exact_odds(a, d - a, n - d) for n in unions for d in [int((1 - similarity) * n + 1e-9)] for a in range((d + 1) // 2, d + 1)]
    return max(exact) if short else max(*exact, math.acos(2 * similarity / (1 + similarity)) / math.pi)


def layout(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, segments) for so many rows."""
    p = bit_odds(similarity)
    width = min(SEGMENT_BITS, max(12, math.ceil(math.log2(max(2, rows))) - OCCUPANCY))
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - hit))
    return width, segments


@lru_cache(maxsize=64)
def greatest_distance(bits: int, similarity: float = SIMILARITY, short: bool = False) -> int:
    """So many of ``bits`` differ at most, but for ``LOSS`` of the pairs of the similarity."""
    p, d, over = bit_odds(similarity, short), -1, 1.0
    ways = lambda d: math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1)
    while over > LOSS:
        d += 1
        over -= math.exp(ways(d) + d * math.log(p) + (bits - d) * math.log(1 - p))
    return d


def _limit(bits: int, similarity: float, short):
    """The greatest distance, where the column ``short`` tells pairs of short sets."""
    return F.when(short, greatest_distance(bits, similarity, True)).otherwise(greatest_distance(bits, similarity))


def _near(similarity: float, by_shingle):
    """The test on 128 bits, of columns that start with ``u`` and ``v``."""
    first, second = (F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in ("fp", "c0"))
    return (first <= _limit(64, similarity, by_shingle)) & (first + second <= _limit(128, similarity, by_shingle))


def _near_words(similarity: float, by_shingle):
    """The test on the first word and the ``LED_WORDS`` that every node has."""
    apart = sum((F.bit_count(F.col("u_words")[i].bitwiseXOR(F.col("v_words")[i])) for i in range(LED_WORDS)), F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp"))))
    return apart <= _limit(64 * (1 + LED_WORDS), similarity, by_shingle)


def _near_wide(similarity: float):
    """The test on the wide words."""
    apart = sum((F.bit_count(F.col("u_wide")[i].bitwiseXOR(F.col("v_wide")[i])) for i in range(WIDE)), F.lit(0))
    return apart <= _limit(64 * WIDE, similarity, F.col("u_short") & F.col("v_short"))


def fingerprint_words(own: np.ndarray, first: int, last: int) -> bytes:
    """The 64-bit words ``first`` to ``last`` (not included) of the fingerprint of a set of shingles; zeros where a text has none."""
    n = len(own)
    if not n:
        return bytes(8 * (last - first))
    out, step = [], max(1, (1 << 16) // n)
    for at in range(first, last, step):
        number = np.arange(at, min(last, at + step), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mixed(own[None] + (number * STRIDE)[:, None], 100)
        if at == 0:
            h[0] = own
        places = h.astype(">u8").view(np.uint8).reshape(len(h), n, 8) + PLACES + 2048 * np.arange(len(h))[:, None, None]
        counts = np.bincount(places.ravel(), minlength=2048 * len(h)).reshape(-1, 256)
        out.append(np.packbits((2 * (counts @ BITS) > n).ravel()).tobytes())
    return b"".join(out)


def segment_keys(words: Column, width: int, segments: int) -> Column:
    """A key for each segment of an array of fingerprint words: its number above its bits."""
    per, mask = 64 // width, F.lit((1 << width) - 1)
    bits = lambda j: F.shiftrightunsigned(words[j // per], j % per * width).bitwiseAND(mask)
    return F.array(*[bits(j).bitwiseOR(F.lit(j << SEGMENT_BITS)) for j in range(segments)])


def prefix_size(n, similarity: float):
    """So many of the least of ``n`` shingles, in any one order, that two sets of the similarity share one."""
    return n - F.ceil(similarity * n - F.lit(1e-9)).cast("int") + 1


def _words(raw: list[bytes], count: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), count)


def _fingerprints(rows: DataFrame, words: int, shingle: int) -> DataFrame:
    """uid, hash of the set, first word, the ``words`` words after it, and the shingles of short sets."""

    def run(batches):
        for b in in_pieces(batches):
            sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
            w = _words([fingerprint_words(s, 0, 1 + words) for s in sets], 1 + words).view(np.int64)
            few = pa.array([s.view(np.int64).tolist() if len(s) <= SHORT else None for s in sets], pa.list_(pa.int64()))
            names = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("uid"), names, pa.array(np.ascontiguousarray(w[:, 0])), pa.array(list(w[:, 1:]), pa.list_(pa.int64())), few], ["uid", "set", "fp", "words", "few"])

    return rows.mapInArrow(run, "uid long, set binary, fp long, words array<bigint>, few array<bigint>")


def _features(rows: DataFrame, used: DataFrame, shingle: int) -> DataFrame:
    """uid, wide words, short, and the shingle set of each row whose uid is in ``used``."""

    def run(batches):
        for b in in_pieces(batches):
            sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
            wide = pa.array(list(_words([fingerprint_words(s, 1, 1 + WIDE) for s in sets], WIDE).view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("uid"), wide, pa.array([len(s) <= SHORT for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["uid", "wide", "short", "shingles"])

    return rows.join(small_side(used, 8), "uid", "left_semi").select("uid", "text").mapInArrow(run, "uid long, wide array<bigint>, short boolean, shingles array<bigint>")


def _side(table: DataFrame, name: str, *cols: str) -> DataFrame:
    return table.select(F.col("uid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])


def _ends(*pairs: DataFrame) -> DataFrame:
    """The distinct nodes of tables of pairs."""
    both = [p.select(F.col(c).alias("uid")) for p in pairs for c in ("u", "v")]
    out = both[0]
    for p in both[1:]:
        out = out.union(p)
    return out.distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _still_near(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """The pairs that pass the wide test."""
    both = pairs.join(_side(features, "u", "wide", "short"), "u").join(_side(features, "v", "wide", "short"), "v")
    return both.where(_near_wide(similarity)).select("u", "v")


def _alike(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """The pairs of a written table whose shingle sets, compared whole, reach the similarity."""
    features = features.join(small_side(written(_ends(pairs), "ends"), 8), "uid", "left_semi")
    both = pairs.join(_side(features, "u", "shingles"), "u").join(_side(features, "v", "shingles"), "v")
    common, sizes = F.size(F.array_intersect("u_shingles", "v_shingles")), F.size("u_shingles") + F.size("v_shingles")
    return both.where(common >= similarity * (sizes - common)).select("u", "v")


def _short_keys(nodes: DataFrame, similarity: float) -> DataFrame:
    """(uid, more): for short sets, the keys of their rarest shingles that another short set has too."""
    has = written(nodes.where(F.size("few") > 0).select("uid", F.size("few").alias("n"), F.explode("few").alias("x")), "few")
    counts = has.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = has.join(counts, "x").groupBy("uid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("by"))
    least = F.filter(F.slice("by", 1, prefix_size(F.col("n"), similarity)), lambda s: s["df"] > 1)
    keys = F.transform(least, lambda s: s["x"].bitwiseAND(F.lit(SHINGLE - 1)).bitwiseOR(F.lit(SHINGLE)))
    return ranked.select("uid", keys.alias("more")).where(F.size("more") > 0)


def _led(nodes: DataFrame, rows: DataFrame, similarity: float, shingle: int, crowded: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Pairs of holders of crowded keys with their leaders: (features of their nodes, near pairs, links); None if no key is crowded."""
    entries = nodes.select("uid", "fp", "c0", F.explode("leading").alias("key"))
    counts = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded), "crowded")
    if not counts.limit(1).count():
        return None
    held = written(entries.join(small_side(counts, 16), "key"), "held")
    home = written(held.groupBy("uid").agg(F.sum("n").alias("home")), "home")
    first = F.max_by(F.struct(F.col("uid").alias("v"), F.col("fp").alias("v_fp"), F.col("c0").alias("v_c0")), F.struct("home", -F.col("uid")))
    leaders = written(held.join(small_side(home, 16), "uid").groupBy("key").agg(first.alias("l")).select("key", "l.*"), "leaders")
    asking = held.select("key", F.col("uid").alias("u"), F.col("fp").alias("u_fp"), F.col("c0").alias("u_c0"))
    stars = asking.join(small_side(leaders, 32), "key").where(_near(similarity, F.col("key") >= SHINGLE) & (F.col("u") != F.col("v")))
    stars = written(_ordered(stars), "stars")
    features = written(_features(rows, written(_ends(stars), "ends"), shingle), "features")
    near = written(_still_near(stars, features, similarity), "near")
    return features, near, written(_alike(near, features, similarity), "links")


def _probes(keys, width: int, busy):
    """The keys that a node asks for: its own, and those of its balls; of pairs between nodes that aren't busy, one side asks."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    places, segments = F.sequence(F.lit(0), F.lit(width - 1)), F.filter(keys, lambda k: k < SHINGLE)
    balls = F.flatten(F.transform(segments, lambda k: F.transform(places, lambda i: k.bitwiseXOR(one(i)))))
    upper = F.flatten(F.transform(segments, lambda k: F.transform(F.filter(places, lambda i: k.bitwiseAND(one(i)) == 0), lambda i: k.bitwiseOR(one(i)))))
    return F.when(busy, F.concat(keys, balls)).otherwise(F.concat(F.transform(keys, lambda k: k.bitwiseOR(F.lit(OWN))), upper))


def _touched(plain: DataFrame, asking: DataFrame, width: int, similarity: float) -> DataFrame:
    """The nodes of ``plain`` that ``asking`` have in their balls, near on all words that nodes have; no pair is made."""
    own = lambda name: [F.col("fp").alias(f"{name}_fp"), F.slice("words", 1, LED_WORDS).alias(f"{name}_words")]
    table = plain.select(F.col("uid").alias("v"), *own("v"), F.explode("keys").alias("held"))
    probes = written(asking.select(*own("u"), F.explode(_probes(F.col("keys"), width, F.lit(True))).alias("k")), "probes")
    return table.join(small_side(probes, 24 + 16 * LED_WORDS), (F.col("k") == F.col("held")) & _near_words(similarity, F.col("held") >= SHINGLE), "left_semi").select(F.col("v").alias("uid")).distinct()


def _across_index(plain: DataFrame, late: DataFrame | None, width: int, similarity: float) -> DataFrame:
    """Pairs that the index fetches and 128 bits let pass: of ``plain`` nodes, and of these with ``late`` ones."""
    side = lambda t, all_around: t.select(F.col("uid").alias("u"), F.col("fp").alias("u_fp"), F.col("c0").alias("u_c0"), F.explode(_probes(F.col("keys"), width, F.lit(all_around))).alias("k"))
    table = plain.select(F.col("uid").alias("v"), F.col("fp").alias("v_fp"), F.col("c0").alias("v_c0"), F.explode("keys").alias("held"))
    probes = side(plain, False) if late is None else side(plain, False).union(side(late, True))
    key, is_own = F.col("k").bitwiseAND(F.lit(OWN - 1)), F.col("k") >= OWN
    near = _near(similarity, F.col("held") >= SHINGLE) & (F.col("u") != F.col("v")) & (~is_own | (F.col("u") < F.col("v")))
    return probes.join(table, (key == F.col("held")) & near).select("u", "v")


def _first_meeting(width: int, segments: int):
    """True where no segment before that of ``key`` is within one bit: a pair that meets in several comes out of one."""
    per, number = 64 // width, F.shiftright("key", SEGMENT_BITS)
    earlier = F.lit(False)
    for j in range(min(segments - 1, ONCE)):
        mask = ((1 << width) - 1) << (j % per * width)
        apart = F.col("u_wide")[j // per].bitwiseXOR(F.col("v_wide")[j // per]).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        earlier = earlier | ((number > j) & (F.bit_count(apart) <= 1))
    return (F.col("key") >= SHINGLE) | ~earlier


def _across_busy(placed: DataFrame, sizes: DataFrame, features: DataFrame, width: int, segments: int, similarity: float) -> DataFrame:
    """Pairs of busy nodes of different components that pass the wide test; the node of the smaller component asks."""
    rooted = placed.join(small_side(sizes, 16), "root", "left")
    rank = F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.col("root"))
    busy = written(rooted.select("uid", "fp", "c0", "keys", rank.alias("rank")).join(features.select("uid", "wide", "short"), "uid"), "busy")
    whole = lambda t, name, keys: t.select(F.col("uid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("rank", "fp", "c0", "wide", "short")], F.explode(keys).alias("key"))
    held = whole(busy, "v", F.col("keys"))
    top = written(held.groupBy("key").agg(F.max("v_rank").alias("top")), "top")
    balls = busy.select("uid", "rank", F.explode(_probes(F.col("keys"), width, F.lit(True))).alias("key"))
    larger = small_side(top.withColumnRenamed("key", "at"), 32)
    # A node's list is its balls at most.
    asks = balls.join(larger, (F.col("key") == F.col("at")) & (F.col("top") > F.col("rank")), "left_semi").groupBy("uid").agg(F.collect_list("key").alias("asked"))
    asks = written(asks, "asks")
    # Dealt evenly before the lists open: a few nodes ask for most of a crowded key.
    dealt = busy.join(small_side(asks, 1024), "uid").repartition(min(20_000, 1 + asks.count() // 32), "uid")
    asking, held = whole(dealt, "u", F.col("asked")), small_side(written(held, "held"), 8 * (WIDE + 16))
    fits = (F.col("v_rank") > F.col("u_rank")) & _near(similarity, F.col("key") >= SHINGLE) & _near_wide(similarity) & _first_meeting(width, segments)
    return asking.join(held, "key").where(fits).select("u", "v")


def near_groups(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDTH, recall: float = RECALL, crowded: int = CROWDED, busy: int = BUSY) -> DataFrame:
    """(uid, root) for each of ``rows`` (uid long, text string not null); rows of one root are one group."""
    n = rows.count()
    width, segments = layout(n, similarity, recall)
    # The last word holds no segment, so that chance matches of a segment don't favour it.
    words = max(LED_WORDS, 1 - (-segments // (64 // width)))
    fps = written(_fingerprints(rows, words, shingle), "fingerprints")
    least = fps.groupBy("set").agg(F.min("uid").alias("node"))
    named = written(fps.select("uid", "set").join(least, "set").select("uid", "node"), "named")
    twins = named.where("uid <> node").select("uid")
    nodes = written(fps.join(small_side(twins, 8), "uid", "left_anti").drop("set"), "nodes")
    more = written(_short_keys(nodes, similarity), "more")
    every = F.coalesce("more", F.array().cast("array<bigint>"))
    # Leaders are found by wider segments, so that what shares a key is rarely chance.
    lead = min(SEGMENT_BITS, max(16, math.ceil(math.log2(max(2, n)))))
    keys, leading = segment_keys(F.col("words"), width, segments), segment_keys(F.col("words"), lead, LED_WORDS * (64 // lead))
    nodes = nodes.join(small_side(more, 96), "uid", "left").select("uid", "fp", F.element_at("words", -1).alias("c0"), "words", F.concat(keys, every).alias("keys"), F.concat(leading, every).alias("leading"))
    led = _led(nodes, rows, similarity, shingle, crowded)
    plain, late = nodes, None
    if led:
        features, close, links = led
        roots = written(components(links), "roots")
        families = written(components(close), "families")
        large = written(families.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).select("root"), "large")
        crowd = written(families.join(small_side(large, 8), "root", "left_semi").select(F.col("node").alias("uid")), "crowd")
        new = crowd
        for _ in range(TOUCHES):
            plain = nodes.join(small_side(crowd, 8), "uid", "left_anti")
            late = nodes.join(small_side(new, 8), "uid", "left_semi")
            new = written(_touched(plain, late, width, similarity), "touched")
            crowd = written(crowd.union(new), "crowd")
        plain = nodes.join(small_side(crowd, 8), "uid", "left_anti")
        late = nodes.join(small_side(new, 8), "uid", "left_semi")
    pairs = written(_ordered(_across_index(plain, late, width, similarity)), "pairs")
    if led:
        apart = _rooted(_rooted(pairs, "u", roots, "u_root"), "v", roots, "v_root").where("u_root <> v_root").select("u", "v")
        pairs = written(apart, "pairs")
        more = _ends(pairs).union(crowd).distinct().join(small_side(features.select("uid"), 8), "uid", "left_anti")
        features = features.union(written(_features(rows, written(more, "ends"), shingle), "features"))
        sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
        placed = _rooted(nodes.join(small_side(crowd, 8), "uid", "left_semi"), "uid", roots)
        wide = written(_ordered(_across_busy(placed, sizes, features, width, segments, similarity)), "wide")
        near = _still_near(pairs, features, similarity).union(wide)
    else:
        features = written(_features(rows, written(_ends(pairs), "ends"), shingle), "features")
        near = _still_near(pairs, features, similarity)
    links = written(_alike(written(near, "near"), features, similarity), "links")
    if led:
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)
    return _rooted(named, "node", written(components(links), "roots")).select("uid", "root")


def _rooted(df: DataFrame, node: str, roots: DataFrame, name: str = "root") -> DataFrame:
    """``df`` with the root of its node, which is the node itself where nothing links it."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias(name))
    return df.join(small_side(known, 16), node, "left").withColumn(name, F.coalesce(name, node))


def without_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY, shingle: int = WIDTH) -> DataFrame:
    """``docs`` with all its columns, the row of the smallest id of each group of near duplicates.

    Rows are linked when the Jaccard similarity of their sets of word shingles
    reaches ``similarity``; a group is what links reach. Null text counts as
    empty; rows without a word form one group; null ids are kept last. Of rows
    that repeat an id one stays. An empty table gives an empty result.
    """
    uid = unused(docs, "row_uid")
    with scratch():
        kept = keyed_rows(docs, id_col, uid)
        rows = kept.select(F.col(uid).alias("uid"), text_or_empty(text_col).alias("text"))
        groups = written(near_groups(rows, similarity, shingle), "groups")
        several = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "several")
        members = groups.join(small_side(several, 8), "root", "left_semi").join(kept.select(F.col(uid).alias("uid"), F.col(id_col).alias("id")), "uid")
        members = written(members, "members")
        best = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("best")).select("root", F.col("best.uid").alias("best"))
        gone = written(members.join(small_side(written(best, "best"), 16), "root").where("uid <> best").select(F.col("uid").alias(uid)), "gone", outer=True)
    return kept.join(small_side(gone, 8), uid, "left_anti").drop(uid)
