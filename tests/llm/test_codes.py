"""Vector codes against plain Lloyd rounds over every entry, and against SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np

from reelgrid.llm import codes

SF = "/root/testdata/sf0.01"


def plain(rows, parts, entries, rounds):
    """(id, code, error) and the digest, each part compared with each entry."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * d : (j + 1) * d]
    books = [[cut(v, j) for _, v in sorted(kept)[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, j: min(range(len(books[j])), key=lambda e: (far(cut(v, j), books[j][e]), e))
    for _ in range(rounds):
        got = [[pick(v, j) for j in range(parts)] for _, v in kept]
        for j in range(parts):
            for e in range(len(books[j])):
                own = [cut(v, j) for (_, v), g in zip(kept, got, strict=True) if g[j] == e]
                if own:
                    books[j][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = {}
    for i, v in kept:
        got = [pick(v, j) for j in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e in got), sum(far(cut(v, j), books[j][e]) for j, e in enumerate(got)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, v, i % 3 or None, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, x int, code string")


def test_codes_and_books_are_those_of_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) if i % 4 else rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (1004, rows[0][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, digest = plain(rows, 4, 16, 3)
    got, books = codes.compress(table(spark, rows), parts=4, entries=16, rounds=3, groups=4)
    assert {r.vec_id: (r.code.hex(), r.error) for r in got.collect()} == want and books.digest == digest
    assert want[1004] == want[0]
    near = books.decoded(want[0][0])
    assert sum((math.floor(256 * a) - math.floor(256 * b)) ** 2 for a, b in zip(near, rows[0][1], strict=True)) == want[0][1]


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (32, 1, 4))
    x = (centres[rng.integers(0, 32, 4000)] + rng.integers(-20, 20, (4000, 1, 4))).astype(np.int64)
    start = x[:32].transpose(1, 0, 2).copy()
    books = codes.Books(start, codes.grouped(start))
    code, bounds, _, whole = codes.assign(x, books)
    moved = start + rng.integers(-3, 4, start.shape)
    step = np.sqrt(((moved - start).astype(float) ** 2).sum(axis=2))
    drift = np.array([[step[0][books.group[0] == g].max(initial=0) for g in range(int(books.group.max()) + 1)]])
    later = codes.Books(moved, books.group)
    a, b = codes.assign(x, later, code, bounds, drift), codes.assign(x, later)
    assert (a[0] == b[0]).all() and (a[2] == b[2]).all() and whole == b[3] and a[3] < 0.6 * whole
    # Kept bounds never exceed the true distances.
    assert (a[1] <= b[1] + 1e-3).all()


def test_vectors_of_any_shape(spark):
    rows = [(2, [1.0] * 5), (1, []), (1, [1e30] * 3), (None, [0.5] * 5), (7, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, label string")
    got, _ = codes.compress(frame, parts=4, entries=2, rounds=1)
    out = [(r.vec_id, r.code) for r in got.collect()]
    assert len(out) == 5 and len({c for i, c in out if i in (2, 7)}) == 1
    empty, _ = codes.compress(frame.where("vec_id = 99"))
    assert empty.count() == 0


def test_the_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(codes.ORACLES["op11_vector_codes"])
    got = codes.op11_vector_codes(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.fetchall()))
