"""Vector code compression: a product quantiser in whole numbers, fitted by Yinyang Lloyd rounds.

A vector is cut into equal parts; each part position has a codebook. The
entries of a codebook are clustered once into groups. Beside its code a part
keeps one lower bound for each group: no entry of the group, but for its own,
is nearer. After a round a bound shrinks by the group's greatest drift, and
only groups whose bound no longer exceeds the distance to the part's own entry
are scanned. Scans compare squared distances as integers with the lower index
first, so bounds, which are rounded down, decide what is read and never what
is chosen.

Codes and bounds are a written table between rounds. Of the vectors only sums
by part and entry reach the driver, a number fixed by the parameters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, scratch, small_side, written

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 16, 64, 2, 6, 256
#: Rows that are compared at once.
ROWS = 2_000
#: Bounds are taken lower by this share and this much, which is more than their rounding.
SLACK = 1e-5


@dataclass(frozen=True)
class Books:
    """Codebooks: ``entries`` is parts x entries x positions, ``group`` names each entry's group."""

    entries: np.ndarray
    group: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for, in the scale of the input."""
        picks = bytes.fromhex(code)
        return [(v + 0.5) / SCALE for j, e in enumerate(picks) for v in self.entries[j, e].tolist()]


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """For each part a group number of each entry, by a few Lloyd rounds over the entries themselves."""
    out = np.zeros(entries.shape[:2], np.int64)
    for j, book in enumerate(entries.astype(np.float64) if entries.shape[1] else ()):
        centres = book[: max(1, min(groups, len(book)))].copy()
        for _ in range(rounds):
            out[j] = ((book[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for g in range(len(centres)):
                if (out[j] == g).any():
                    centres[g] = book[out[j] == g].mean(axis=0)
    return out


def _nearest_other(distances: np.ndarray, pick: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The least distance of each row to an entry other than ``pick``, infinite without one."""
    squared = np.where(entries[None] == pick[:, None], np.inf, distances.astype(np.float64))
    return np.sqrt(squared.min(axis=1))


def assign(x: np.ndarray, books: Books, code: np.ndarray | None = None, bounds: np.ndarray | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, bounds, squared distances, entries scanned) of rows ``x`` (rows x parts x positions).

    ``code`` and ``bounds`` are those of the round before, ``drift`` is the
    greatest move of each part's groups since. Without them all is scanned.
    """
    n, parts, _ = x.shape
    n_groups = int(books.group.max()) + 1
    new_code, new_bounds, best = np.zeros((n, parts), np.int64), np.full((n, parts, n_groups), np.inf, np.float32), np.zeros((n, parts), np.int64)
    scanned = 0
    for j in range(parts):
        book, group, part = books.entries[j], books.group[j], x[:, j]
        fresh = code is None
        own = np.zeros(n, np.int64) if fresh else code[:, j].astype(np.int64)
        own_distance = ((part - book[own]) ** 2).sum(axis=1)
        least, pick = own_distance.copy(), own.copy()
        lower = np.zeros((n, n_groups)) if fresh else bounds[:, j].astype(np.float64) * (1 - SLACK) - SLACK - drift[j][None] * (1 + SLACK)
        look = lower <= np.sqrt(own_distance.astype(np.float64))[:, None]
        found = []
        for g in range(n_groups):
            rows, entries = np.flatnonzero(look[:, g]), np.flatnonzero(group == g)
            if not len(rows) or not len(entries):
                found.append(None)
                continue
            scanned += len(rows) * len(entries)
            distances = ((part[rows][:, None] - book[entries][None]) ** 2).sum(axis=2)
            d = distances.min(axis=1)
            e = entries[distances.argmin(axis=1)]
            better = (d < least[rows]) | ((d == least[rows]) & (e < pick[rows]))
            least[rows[better]], pick[rows[better]] = d[better], e[better]
            found.append((rows, entries, distances))
        for g, got in enumerate(found):
            # An entry that is left counts among the others of its group from now on.
            left = (group[own] == g) & (pick != own)
            lower[left, g] = np.minimum(lower[left, g], np.sqrt(own_distance[left].astype(np.float64)))
            if got is not None:
                rows, entries, distances = got
                lower[rows, g] = _nearest_other(distances, pick[rows], entries)
        new_code[:, j], best[:, j] = pick, least
        new_bounds[:, j] = np.nextafter(np.maximum(lower, 0).astype(np.float32), np.float32(-1))
    return new_code, new_bounds, best, scanned


def _whole(vec: Column, dims: int) -> Column:
    """floor(256 * x) of each component, filled with zeros to ``dims``; held within what squared distances can sum up exactly."""
    most = 2**27
    x = F.transform(vec, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), v)) * SCALE))).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x)))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _coded(rows: DataFrame, books: Books, drift: np.ndarray | None, state: bool) -> DataFrame:
    """``rows`` (id, label, x and, from the second round on, code and bounds) with new code, bounds and error."""
    parts, kinds = len(books.entries), {f.name: f.dataType.simpleString() for f in rows.schema}
    first = "code" not in rows.columns

    def run(batches):
        for b in in_pieces(batches, ROWS):
            x = _matrix(b.column("x"), parts)
            code = bounds = None
            if not first:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
                bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.float32).reshape(len(x), parts, -1)
            code, bounds, best, _ = assign(x, books, code, bounds, drift)
            got = [pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())]
            got.append(pa.array([r.tobytes() for r in bounds], pa.binary()) if state else pa.array(best.sum(axis=1)))
            kept = [b.column(c) for c in (("id", "label", "x") if state else ("id", "label"))]
            yield pa.RecordBatch.from_arrays([*kept, *got], ["id", "label", *(["x", "code", "bounds"] if state else ["code", "error"])])

    head = f"id {kinds['id']}, label {kinds['label']}, "
    return rows.mapInArrow(run, head + ("x array<bigint>, code binary, bounds binary" if state else "code binary, error long"))


def _sums(state: DataFrame, parts: int, entries: int) -> list:
    """(part, entry, position, sum, count) over all rows; each task folds its own first."""

    def run(batches):
        total = count = None
        for b in in_pieces(batches, ROWS):
            x = _matrix(b.column("x"), parts)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            if total is None:
                total, count = np.zeros((parts, entries, x.shape[2]), np.int64), np.zeros((parts, entries), np.int64)
            for j in range(parts):
                np.add.at(total[j], code[:, j], x[:, j])
                count[j] += np.bincount(code[:, j], minlength=entries)
        if total is None:
            return
        j, e = np.nonzero(count)
        d = total.shape[2]
        cols = [np.repeat(j, d), np.repeat(e, d), np.tile(np.arange(d), len(j)), total[j, e].ravel(), np.repeat(count[j, e], d)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["part", "entry", "position", "total", "n"])

    partial = state.select("x", "code").mapInArrow(run, "part long, entry long, position long, total long, n long")
    return partial.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def compress(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, groups=GROUPS) -> tuple[DataFrame, Books]:
    """(id_col, label_col, code binary, error long) of each kept row, and the codebooks.

    A row is dropped if its vector is null or holds a null or non-finite
    component. Components become floor(256 * x), kept within 2**27 so that sums
    of squares are exact. The ``entries`` (256 at most) rows of the smallest
    ids, null ids last, equal ids by their components, start the codebooks;
    with fewer rows the codebooks are shorter. Each round assigns every part
    to the nearest entry, the lower index on ties, and replaces each used entry
    by the floor of its parts' mean; at last parts are assigned again. Vectors
    shorter than the longest, rounded up to a multiple of ``parts``, are filled
    with zeros. Repeated rows stay, equal vectors have equal codes. An empty
    table gives an empty result. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)
    longest = good.agg(F.max(F.size("v"))).first()[0] or 0
    dims = parts * max(1, -(-longest // parts))
    rows = good.select("id", "label", _whole(F.col("v"), dims).alias("x"))
    with scratch():
        rows = written(rows, "vectors")
        seeds = [r.x for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
        start = np.array(seeds, np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
        books = Books(start, grouped(start, groups))
        state, drift = rows, None
        for _ in range(rounds if seeds else 0):
            state = written(_coded(state, books, drift, True), "state")
            moved = books.entries.copy()
            for r in _sums(state, parts, len(seeds)):
                moved[r.part, r.entry, r.position] = r.total // r.n
            step = np.sqrt(((moved - books.entries).astype(np.float64) ** 2).sum(axis=2))
            drift = np.array([[step[j][books.group[j] == g].max(initial=0.0) for g in range(int(books.group.max()) + 1)] for j in range(parts)])
            books = Books(moved, books.group)
        last = _coded(state, books, drift, False) if seeds else rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        coded = written(last, "codes", outer=True)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def op11_vector_codes(spark, sf_dir):
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    out = coded.join(small_side(sums, 64), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _oracle() -> str:
    """Lloyd's rounds as they are defined, every part against every entry."""
    parts = """
    v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(256 * x::DOUBLE) AS BIGINT) for x in embedding] AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, label, j, x[j * len(x) // 16 + 1 : (j + 1) * len(x) // 16] AS x FROM v, range(16) t(j)),
    b0 AS MATERIALIZED (SELECT j, rank() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"""
    near = """,
    a{r} AS MATERIALIZED (SELECT vec_id, p.j, any_value(label) AS label, any_value(x) AS x, min(list_sum([(y[1] - y[2]) * (y[1] - y[2]) for y in list_zip(x, c)])::BIGINT * 64 + e) AS best
        FROM p JOIN b{r} b ON b.j = p.j GROUP BY vec_id, p.j)"""
    move = """,
    m{r} AS (SELECT j, e, list(m ORDER BY i) AS c FROM (SELECT j, best % 64 AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 65) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY j, e),
    b{n} AS MATERIALIZED (SELECT b.j, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.j = b.j AND m.e = b.e)"""
    rounds = "".join(near.format(r=r) + move.format(r=r, n=r + 1) for r in range(ROUNDS)) + near.format(r=ROUNDS)
    return f"""
    WITH {parts}{rounds},
    d AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 64), '' ORDER BY j) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM b{ROUNDS}) AS codebooks_sha256
    FROM d
    """


ORACLES = {"op11_vector_codes": _oracle()}
