"""Near-dedup by SetSketch registers.

A register holds floor(1 - log_b of the least of its exponential hash values
of a set), cut to a fixed range. Registers of a union are the greater of the
parts' registers, so sketches merge, and equal registers tell of similar sets.
With a base near 1 two registers agree about as often as the sets' Jaccard
similarity says.

Groups of registers are bands; nodes, which are distinct shingle sets, meet
where a band agrees. How many registers make a band follows from the number of
rows, so that few strangers meet, and how many bands there are follows from the
recall asked for at the threshold. What meets is estimated jointly by
likelihood inside the join: with sizes known, the registers that are greater on
either side and equal ones give a likelihood of the similarity, which is
concave, so its slope at a limit tells on which side the estimate lies. The
limit loses about ``LOSS`` of the pairs at the threshold. What passes is
verified on the whole shingle sets.

Groups cost about their size. The holders of a band's value are compared with
one leader first, the holder most at home in shared values. After that only
holders outside their value's largest component are compared, with another
leader in each of ``STARS`` rounds, and at last with all holders of other
components. Pairs inside a component are never needed, and none across
components is left out. Shingles that ``RARE`` of these holders have at most
bound a pair's similarity exactly: without one in common the intersection is
among the frequent ones, and pairs with some in common are listed by them. So a
text that is edited too far to be linked with its group asks nobody.
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
from reelgrid.llm.sketches import shingles

WIDTH, SIMILARITY, RECALL, REGISTERS, STARS = 5, 0.8, 0.9999, 512, 1
#: Base, rate and greatest value of the registers: sets of up to 10**27 elements.
BASE, RATE, MOST = 1.001, 20.0, 2**16 - 1
#: Share of the pairs at the threshold that the test of bits or the likelihood may lose.
LOSS = 1e-5
#: Registers of unrelated texts agree about as often as this, and so many strangers may meet in a band.
CHANCE, STRANGERS = 0.03, 1 / 16
#: Holders of a shingle that is rare among the nodes that are compared at last.
RARE = 16
#: Elements that are hashed at once.
STEP = 128


@lru_cache(maxsize=8)
def _factors(m: int) -> np.ndarray:
    """An odd factor for each register."""
    return (mixed(np.arange(m, dtype=np.uint64), 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, of which the upper halves count; zeros for an empty set."""
    if not len(elements):
        return np.zeros(m, np.int32)
    least, high = np.full(m, 2**32 - 1, np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(high), STEP):
            np.minimum(least, (high[at : at + STEP, None] * _factors(m)).min(axis=0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, MOST).astype(np.int32)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum.reduce(sketches)


def cardinality(sketch: np.ndarray) -> float:
    """Estimated number of elements."""
    if not sketch.any():
        return 0.0
    powers = np.sum(BASE ** -sketch.astype(np.float64))
    return float(len(sketch) * (1 - 1 / BASE) / (RATE * math.log(BASE) * powers))


def _greater(x):
    """Chance that a register of one side is greater, where ``x`` is the share of the union that only this side has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: float | None = None, n_b: float | None = None) -> float:
    """The similarity of greatest likelihood, given both sketches and sizes, which are estimated if not given."""
    n_a, n_b = (cardinality(s) if n is None else n for s, n in ((a, n_a), (b, n_b)))
    if not n_a or not n_b:
        return float(n_a == n_b)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = int((a > b).sum()), int((a < b).sum())
    low, high = 0.0, min(u / v, v / u)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if _slope(mid, u, v, more, less, len(a) - more - less, np.log, lambda x: x) >= 0 else (low, mid)
    return (low + high) / 2


def _slope(j, u, v, more, less, equal, log, lit):
    """Slope in the similarity ``j`` of the likelihood of these counts of registers. Works on numbers and on columns."""
    c = (BASE - 1) / BASE
    x, y = u - v * j, v - u * j
    p, q = -log(1 - x * c) / math.log(BASE), -log(1 - y * c) / math.log(BASE)
    dp, dq = -v * c / (1 - x * c) / math.log(BASE), -u * c / (1 - y * c) / math.log(BASE)
    tiny = lit(1e-12)
    return more * dp / (p + tiny) + less * dq / (q + tiny) - equal * (dp + dq) / (1 - p - q + tiny)


def layout(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(registers of a band, bands) for so many rows."""
    wide = max(2, math.ceil(math.log(max(2, rows) / STRANGERS) / -math.log(CHANCE)))
    return wide, math.ceil(math.log(1 - recall) / math.log(1 - similarity**wide))


@lru_cache(maxsize=64)
def fewest(n: int, p: float) -> int:
    """Of ``n`` trials that hold by chance ``p``, fewer than this hold in about ``LOSS`` of all cases."""
    k, below = 0, 0.0
    ways = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    while True:
        below += math.exp(ways(k) + k * math.log(p) + (n - k) * math.log(1 - p))
        if below > LOSS:
            return k
        k += 1


def _parity(sketches: np.ndarray) -> np.ndarray:
    """The lowest bits of the registers, 64 in a word."""
    return np.packbits((sketches & 1).astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64)


def _sketched(rows: DataFrame, shingle: int, m: int) -> DataFrame:
    """uid, hash of the set, its size, registers and their lowest bits."""

    def run(batches):
        for b in in_pieces(batches):
            sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
            regs = np.stack([registers(s, m) for s in sets])
            cols = [b.column("uid"), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array(list((regs - 2**15).astype(np.int16)), pa.list_(pa.int16())), pa.array(list(_parity(regs)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "set", "n", "regs", "bits"])

    return rows.mapInArrow(run, "uid long, set binary, n long, regs array<smallint>, bits array<bigint>")


def band_keys(regs: Column, wide: int, bands: int) -> Column:
    return F.array(*[F.xxhash64(F.slice(regs, 1 + wide * j, wide), F.lit(j)) for j in range(bands)])


def _first_meeting(wide: int) -> Column:
    """True where no band before ``band`` agrees: a pair that meets in several comes out of one."""
    part = lambda side, j: F.slice(side, j * wide + 1, wide)
    earlier = F.filter(F.sequence(F.lit(0), F.col("band")), lambda j: j < F.col("band"))
    return ~F.exists(earlier, lambda j: part(F.col("u_regs"), j) == part(F.col("v_regs"), j))


def close(m: int, similarity: float, common: bool = False) -> Column:
    """True for pairs (columns that start with u_ and v_) whose sizes and lowest bits allow the similarity.

    ``common``: columns u_common and v_common hold the number of shingles that may be in the intersection.
    """
    top, total = math.floor(100 * similarity), F.col("u_n") + F.col("v_n")
    sizes = 100 * F.least("u_n", "v_n") >= top * F.greatest("u_n", "v_n")
    if common:
        sizes = sizes & ((100 + top) * F.least("u_common", "v_common") >= top * total)
    apart = sum((F.bit_count(F.col("u_bits")[i].bitwiseXOR(F.col("v_bits")[i])) for i in range(m // 64)), F.lit(0))
    # Of registers that differ, half differ in the lowest bit.
    return sizes & (apart <= m - fewest(m, (1 + similarity) / 2))


def likely(m: int, similarity: float) -> Column:
    """True for pairs whose estimate of greatest likelihood may belong to the similarity or more."""
    step, total = F.lit(1 << 20), F.col("u_n") + F.col("v_n")
    codes = F.aggregate(F.zip_with("u_regs", "v_regs", lambda a, b: F.when(a > b, step).when(a < b, F.lit(1)).otherwise(F.lit(0))), F.lit(0), lambda t, x: t + x)
    limit = fewest(m, similarity) / m

    def passes(code):
        more, less = F.floor(code / step), code % step
        return _slope(limit, F.col("u_n") / total, F.col("v_n") / total, more, less, m - more - less, F.log, F.lit) >= 0

    # Bound once: the code stands in the slope several times.
    return F.transform(F.array(codes), passes)[0]


def _side(table: DataFrame, name: str, *cols: str) -> DataFrame:
    return table.select(F.col("uid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("uid")).union(pairs.select("v")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


PAYLOAD = ("n", "bits", "regs")
#: Sides with registers are broadcast up to so many bytes only.
WIDE_BYTES = 4 << 20


class _Verifier:
    """Estimates pairs and verifies them; shingle sets are made once a node, when it is first needed."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, shingle: int, m: int, similarity: float):
        self.rows, self.nodes, self.shingle, self.m, self.similarity = rows, nodes, shingle, m, similarity
        self.sets: DataFrame | None = None

    def wide(self, table: DataFrame) -> DataFrame:
        return small_side(table, 2 * self.m + self.m // 8 + 64, WIDE_BYTES)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of a written table of pairs (u < v) those that reach the similarity: bits first, then registers, then the sets."""
        for cols, test in ((("n", "bits"), close), (("n", "regs"), likely)):
            ends = written(_ends(pairs), "ends")
            held = written(self.nodes.join(small_side(ends, 8), "uid", "left_semi").select("uid", *cols), "payload")
            fits = small_side(held, 2 * self.m if "regs" in cols else self.m // 8 + 32, WIDE_BYTES)
            both = pairs.join(_side(fits, "u", *cols), "u")
            near = both.join(_side(fits, "w", *cols).withColumnsRenamed({f"w_{c}": f"v_{c}" for c in cols}), (F.col("v") == F.col("w")) & test(self.m, self.similarity))
            pairs = written(near.select("u", "v"), test.__name__)
        return self.verified(pairs)

    def sets_of(self, uids: DataFrame) -> DataFrame:
        """(uid, shingles) of a written table of nodes."""
        fresh = uids if self.sets is None else written(uids.join(small_side(self.sets.select("uid"), 8), "uid", "left_anti"), "ends")
        if self.sets is None or fresh.limit(1).count():
            made = written(self._shingle_sets(fresh), "sets")
            self.sets = made if self.sets is None else self.sets.union(made)
        return self.sets.join(small_side(uids, 8), "uid", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of a written table of pairs those whose whole shingle sets reach the similarity."""
        known = self.sets_of(written(_ends(pairs), "ends"))
        both = pairs.join(_side(known, "u", "shingles"), "u").join(_side(known, "v", "shingles"), "v")
        common, sizes = F.size(F.array_intersect("u_shingles", "v_shingles")), F.size("u_shingles") + F.size("v_shingles")
        return written(both.where(common >= self.similarity * (sizes - common) - 1e-9).select("u", "v"), "links")

    def frequent(self, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of a written table of nodes (uid, n, common) of those that can be linked with another of them, and (x, uid) of their rare shingles.

        common counts a node's shingles that more than ``RARE`` of these nodes have; rare ones have two holders or more.
        """
        each = self.sets_of(uids).select("uid", F.explode("shingles").alias("x"))
        held = each.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid")).where(F.col("c") <= RARE)
        held = written(held, "held")
        rare = written(each.join(small_side(held.where("c > 1").select("x"), 8), "x", "left_semi"), "rare")
        few = held.where("c = 1").groupBy("uid").agg(F.count(F.lit(1)).alias("own")), rare.groupBy("uid").agg(F.count(F.lit(1)).alias("shared"))
        sizes = self.nodes.join(small_side(uids, 8), "uid", "left_semi").select("uid", "n")
        for part in few:
            sizes = sizes.join(small_side(written(part, "few"), 16), "uid", "left")
        known = sizes.na.fill(0).select("uid", "n", (F.col("n") - F.col("own") - F.col("shared")).alias("common"), "shared")
        able = known.where(100 * (F.col("common") + F.col("shared")) >= math.floor(100 * self.similarity) * F.col("n")).select("uid", "n", "common")
        able = written(able, "able")
        return able, rare.join(small_side(able.select("uid"), 8), "uid", "left_semi")

    def by_rare(self, rare: DataFrame, able: DataFrame, roots: DataFrame) -> DataFrame:
        """(u, v): pairs in different components with rare shingles in common, and with them enough to be linked."""
        known = able.join(small_side(roots.withColumnRenamed("node", "uid"), 16), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        whole = written(rare.join(small_side(written(known, "known"), 32), "uid"), "whole")
        side = lambda name: whole.select(F.col("x").alias(f"{name}_x"), F.col("uid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "common", "root")])
        both = side("u").join(side("v"), (F.col("u_x") == F.col("v_x")) & (F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")))
        shared = both.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("u_n", "v_n", "u_common", "v_common")])
        top = math.floor(100 * self.similarity)
        enough = (100 + top) * (F.least("u_common", "v_common") + F.col("shared")) >= top * (F.col("u_n") + F.col("v_n"))
        return shared.where(enough).select("u", "v")

    def _shingle_sets(self, ends: DataFrame) -> DataFrame:
        shingle = self.shingle

        def run(batches):
            for b in in_pieces(batches):
                yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([shingles(t, shingle).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], ["uid", "shingles"])

        return self.rows.join(small_side(ends, 8), "uid", "left_semi").select("uid", "text").mapInArrow(run, "uid long, shingles array<bigint>")


def _placed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, uid, root, size) of the holders of values (key, band, uid) that more than one component holds."""
    sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    known = written(roots.join(small_side(sizes, 16), "root").select(F.col("node").alias("uid"), "root", "size"), "known")
    # A node has a row for each band at most.
    nodes = entries.groupBy("uid").agg(F.collect_list(F.struct("key", "band")).alias("at"))
    nodes = nodes.join(small_side(known, 24), "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"), "at")
    placed = written(nodes, "nodes").select("uid", "root", "size", F.inline("at"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return written(placed.join(small_side(written(mixed_keys, "mixed"), 8), "key", "left_semi"), "placed")


def near_groups(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDTH, recall: float = RECALL, m: int = REGISTERS, stars: int = STARS) -> DataFrame:
    """(uid, n, root) for each of ``rows`` (uid long, text string not null): size of the set, and a name of its group.

    Rows without a word have n 0 and are alone.
    """
    wide, bands = layout(rows.count(), similarity, recall)
    m = 64 * -(-max(m, wide * bands) // 64)
    sketched = written(_sketched(rows, shingle, m), "sketches")
    sets = sketched.where("n > 0").groupBy("set").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sets = written(sets.select("set", "node"), "copied")
    named = written(sketched.where("n > 0").join(small_side(sets, 40), "set", "left").select("uid", "n", F.coalesce("node", "uid").alias("node")), "named")
    twins = written(named.where("uid <> node").select("uid"), "twins")
    nodes = sketched.where("n > 0").join(small_side(twins, 8), "uid", "left_anti")

    entries = nodes.select("uid", F.posexplode(band_keys(F.col("regs"), wide, bands)).alias("band", "key"))
    shared = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shared")
    held = written(entries.join(small_side(shared, 16), "key"), "held")
    by_node = held.groupBy("uid").agg(F.sum("holders").alias("home"), F.collect_list(F.struct("key", "band", "holders")).alias("at"))
    at_home = written(by_node, "home").select("uid", "home", F.inline("at"))
    leaders = written(at_home.groupBy("key").agg(F.max_by("uid", F.struct("home", -F.col("uid"))).alias("leader")), "leaders")
    to_leader = at_home.select("key", "uid").join(small_side(leaders.withColumnRenamed("key", "of"), 16), (F.col("key") == F.col("of")) & (F.col("uid") != F.col("leader")))
    to_leader = to_leader.select(F.col("uid").alias("u"), F.col("leader").alias("v"))

    check = _Verifier(rows, nodes, shingle, m, similarity)
    tried = written(_ordered(to_leader), "tried")
    roots = written(components(check.links(tried)), "roots")
    # Two holders have been compared.
    placed = _placed(at_home.where("holders > 2").select("key", "band", "uid"), roots)
    able, rare = check.frequent(written(placed.select("uid").distinct(), "ends"))
    placed = placed.join(small_side(able.select("uid"), 8), "uid", "left_semi")
    for turn in range(stars + 1):
        if not placed.limit(1).count():
            break
        across = turn == stars
        pairs = _across(placed, able, check, wide).union(check.by_rare(rare, able, roots)) if across else _other_leaders(placed, turn)
        pairs = written(_ordered(pairs).join(small_side(tried, 16), ["u", "v"], "left_anti"), "across" if across else "tried")
        found = check.verified(pairs) if across else check.links(pairs)
        if found.limit(1).count():
            roots = written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found)), "roots")
        if not across:
            tried = tried.union(pairs)
            placed = _placed(placed.select("key", "band", "uid"), roots)
    grouped = named.join(small_side(roots, 16), "node", "left").select("uid", "n", F.coalesce("root", "node").alias("root"))
    return grouped.union(sketched.where("n = 0").select("uid", "n", F.col("uid").alias("root")))


def _other_leaders(placed: DataFrame, turn: int) -> DataFrame:
    """(u, v): holders outside the largest component of their value, with a holder inside that the turn picks."""
    top = written(placed.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top")).select("key", F.col("top.root").alias("top")), "top")
    ranked = placed.join(small_side(top, 16), "key")
    inside = ranked.where("root = top").groupBy("key").agg(F.min_by("uid", F.xxhash64("uid", "key", F.lit(turn))).alias("v"))
    inside = written(inside, "leaders")
    return ranked.where("root <> top").select("key", F.col("uid").alias("u")).join(small_side(inside, 16), "key").select("u", "v")


def _across(placed: DataFrame, able: DataFrame, check: _Verifier, wide: int) -> DataFrame:
    """(u, v): holders of one value in different components whose estimate passes and whose frequent shingles are enough; the one of the smaller component asks."""
    uids = written(placed.select("uid").distinct(), "ends")
    able = able.join(small_side(uids, 8), "uid", "left_semi")
    payload = written(check.nodes.join(small_side(written(able.select("uid", "common"), "able"), 16), "uid").select("uid", "common", *PAYLOAD), "payload")
    whole = written(placed.select("key", "band", "uid", F.struct("size", "root").alias("rank")).join(check.wide(payload), "uid"), "whole")
    top = written(whole.groupBy("key").agg(F.max("rank").alias("top")), "top")
    cols = ("rank", "common", *PAYLOAD)
    asks = whole.join(small_side(top, 32), "key").where(F.col("rank") < F.col("top")).select("key", "band", F.col("uid").alias("u"), *[F.col(c).alias(f"u_{c}") for c in cols])
    asks = written(asks, "asks")
    held = whole.select(F.col("key").alias("at"), F.col("uid").alias("v"), *[F.col(c).alias(f"v_{c}") for c in cols])
    fits = (F.col("key") == F.col("at")) & (F.col("u_rank") < F.col("v_rank")) & close(check.m, check.similarity, common=True) & likely(check.m, check.similarity) & _first_meeting(wide)
    return held.join(check.wide(asks), fits).select("u", "v")


def near_components(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY, shingle: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """id_col, n_shingles long, component_id, kept for each row of ``docs``.

    Texts are lower-cased in A-Z and cut at ``[\\x20\\x09-\\x0D]``. A row's set
    holds its distinct shingles of ``shingle`` words; with fewer words the whole
    sequence is one. Rows are linked when the Jaccard similarity of their sets
    reaches ``similarity``; component_id is the least id that links reach, and
    the row of that id is kept. Null, empty and blank texts have no shingle and
    are alone, each with its own id. Null ids take part and name a component
    only if it has no other; rows that repeat an id are kept together. Texts of
    any length are read whole. An empty table gives an empty result; other
    columns are not read.
    """
    uid = unused(docs, "row_uid")
    with scratch():
        keyed = keyed_rows(docs, id_col, uid)
        rows = keyed.select(F.col(uid).alias("uid"), text_or_empty(text_col).alias("text"))
        groups = written(near_groups(rows, similarity, shingle, recall), "groups")
        several = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("root"), "several")
        ids = keyed.select(F.col(uid).alias("uid"), F.col(id_col).alias("id"))
        members = written(groups.join(small_side(several, 8), "root", "left_semi").join(ids, "uid"), "members")
        least = written(members.groupBy("root").agg(F.min("id").alias("least")), "least")
        out = ids.join(groups, "uid").join(small_side(least.withColumn("found", F.lit(True)), 24), "root", "left")
        component = F.when(F.col("found"), F.col("least")).otherwise(F.col("id"))
        out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
        return written(out.withColumnRenamed("id", id_col), "components", outer=True)


def without_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY, shingle: int = WIDTH) -> DataFrame:
    """``docs`` with all its columns, without rows whose component holds a lesser id; rows without an id or a word stay."""
    least = near_components(docs, id_col, text_col, similarity, shingle).where(~F.col("kept")).select(F.col(id_col)).distinct()
    return docs.join(small_side(least, 16), id_col, "left_anti")


def op13_setsketch(spark, sf_dir):
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


QUERIES = {"op13_setsketch": op13_setsketch}
