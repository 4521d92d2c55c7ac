"""Clusters by density against a plain implementation over all pairs."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import density_clusters as D
from reelgrid.plans import catalog

SF = "/root/testdata/sf0.01"


def plain_tree(ids, x, copies, samples):
    """Sorted edges (w, a, b) of the least tree, by Kruskal over all pairs, and the core distances."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    core = []
    for i in range(len(ids)):
        others = sorted((d[i, j], c) for j in range(len(ids)) for c in [copies[j]] if j != i)
        row = [0.0] * (copies[i] - 1) + [w for w, c in others for _ in range(c)]
        core.append(row[min(samples, len(row)) - 1] if row else 0.0)
    edges = sorted((max(d[i, j], core[i], core[j]), *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i))
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    tree = []
    for w, a, b in edges:
        if find(a) != find(b):
            parent[find(a)] = find(b)
            tree.append((w, a, b))
    return tree, core


def plain_clusters(ids, x, copies, least, samples):
    """Each id's cluster, named by its least id, by cutting the tree from its greatest edge down."""
    tree, core = plain_tree(ids, x, copies, samples)
    size, core = dict(zip(ids, copies, strict=True)), dict(zip(ids, core, strict=True))

    def parts(edges, nodes):
        near = defaultdict(list)
        for _, a, b in edges:
            near[a].append(b)
            near[b].append(a)
        todo, out = set(nodes), []
        while todo:
            seen, stack = set(), [min(todo)]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack += near[v]
            todo -= seen
            out.append(seen)
        return out

    lam = lambda w: 1 / max(w, D.SLACK)

    def cluster(edges, nodes, born, root=False):
        """(value, chosen groups) of the cluster that holds ``nodes``."""
        every, total, held = set(nodes), 0.0, set(nodes)
        edges = list(edges)
        while edges:
            w = edges.pop()[0]
            sides = parts(edges, held)
            big = [s for s in sides if sum(size[v] for v in s) >= least]
            if len(big) == 2:
                total += sum(size[v] for v in held) * (lam(w) - born)
                below = [cluster([e for e in edges if e[1] in s], s, lam(w)) for s in big]
                value = sum(v for v, _ in below)
                if root or total < value:
                    return value, [g for _, gs in below for g in gs]
                return total, [every]
            left = held - (big[0] if big else set())
            total += sum(size[v] for v in left) * (lam(w) - born)
            held -= left
            edges = [e for e in edges if e[1] in held]
        total += sum(size[v] * (lam(core[v]) - born) for v in held)
        return total, ([] if root else [every])

    if sum(copies) < least:
        return {}
    _, chosen = cluster(tree, ids, 0.0, True)
    return {v: min(g) for g in chosen for v in g}


def collapsed(rows):
    """Ids, unit vectors and copies of (id, vector) rows, and each id's first copy."""
    first, n, rep = {}, defaultdict(int), {}
    for i, v in sorted(rows):
        u = np.array(v, dtype=float) / math.sqrt(sum(float(c) * float(c) for c in v))
        rep[i] = first.setdefault(tuple(u), i)
        n[rep[i]] += 1
    ids = sorted(n)
    at = {i: u for u, i in first.items()}
    return ids, np.array([at[i] for i in ids]), [n[i] for i in ids], rep


def blobs(seed, groups, each, spread, stray=0, dims=4):
    g = np.random.default_rng(seed)
    rows = [c + g.normal(0, s, dims) for c, s in zip(g.normal(0, 1, (groups, dims)), np.resize(spread, groups), strict=True) for _ in range(each)]
    rows += list(g.normal(0, 1, (stray, dims)))
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([("v", i, v) for i, v in rows], "k string, i long, e array<double>")


LEAST, SAMPLES = 7, 3
copied = blobs(4, 3, 15, [0.1])
CASES = {
    "density": blobs(1, 4, 30, [0.02, 0.1, 0.3]),
    "strays": blobs(2, 5, 16, [0.05, 0.15], stray=30),
    "no structure": blobs(3, 0, 0, [1], stray=70),
    "two": blobs(5, 2, 12, [0.05]),
    "few": blobs(6, 1, 6, [0.1]),
    "copies": copied + [(100 + i, copied[i % 2][1]) for i in range(20)] + [(200 + i, copied[20 + i][1]) for i in range(6)],
}
AWKWARD = [("two", 500, None), ("two", 501, [0.0] * 4), ("one", 502, [1.0, 0.0, 0.0, 0.0]), (None, 503, [1.0, 0.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(case, i, v) for case, part in CASES.items() for i, v in part] + AWKWARD
    return spark.createDataFrame(rows, "k string, i long, e array<double>")


def test_tree_matches_plain_code(table):
    got = defaultdict(list)
    for r in D.reachability_tree(table, "k", "i", "e", SAMPLES).collect():
        got[r.k].append((r.w, r.a, r.b))
    assert set(got) == set(CASES)
    for case, rows in CASES.items():
        ids, x, copies, _ = collapsed(rows)
        tree, _ = plain_tree(ids, x, copies, SAMPLES)
        assert [e[1:] for e in sorted(got[case])] == [e[1:] for e in tree], case
        assert np.allclose([e[0] for e in sorted(got[case])], [e[0] for e in tree], atol=1e-9)


def test_clusters_match_plain_code(table):
    got = {(r.k, r.i): r.cluster for r in D.density_clusters(table, "k", "i", "e", LEAST, SAMPLES).collect()}
    assert len(got) == sum(map(len, CASES.values())) + len(AWKWARD) and all(got[k, i] is None for k, i, _ in AWKWARD)
    for case, rows in CASES.items():
        ids, x, copies, rep = collapsed(rows)
        want = plain_clusters(ids, x, copies, LEAST, SAMPLES)
        assert {i: got[case, i] for i, _ in rows} == {i: want.get(rep[i]) for i, _ in rows}, case
    assert len({got["strays", i] for i, _ in CASES["strays"]} - {None}) >= 3
    assert all(got["few", i] is None for i, _ in CASES["few"])


def test_no_rows(table):
    assert D.density_clusters(table.limit(0), "k", "i", "e").count() == 0


def test_nearest_with_copies(spark):
    rows = CASES["copies"]
    unit = {i: np.array(v) / math.sqrt(sum(c * c for c in v)) for i, v in rows}
    got = defaultdict(list)
    for r in D.nearest(frame(spark, rows), "k", "i", "e", 4).orderBy("i", "rank").collect():
        got[r.i].append((round(r.dist, 9), r.other))
    for i in unit:
        want = sorted((round(float(np.sqrt(((unit[i] - unit[j]) ** 2).sum())), 9), j) for j in unit if j != i)[:4]
        assert got[i] == want


def test_neighbours_need_few_of_the_pairs(spark):
    """Twice the vectors in groups of one size: pairs that are measured grow by less than three."""
    def visited(groups):
        units, _ = D.vertices(frame(spark, blobs(7, groups, 40, [0.01], dims=3)), "k", "i", "e")
        every, own, sizes = index = D.cells(units)
        bounds = D.nearest_vertices(units, 5, index).groupBy("k", "i").agg(F.max("dist").alias("reach"))
        return D.open_cells(every.join(bounds, ["k", "i"]), own, sizes, F.col("reach") + D.SLACK).agg(F.sum("members")).first()[0]

    few, many = visited(10), visited(20)
    assert many < 3 * few and many < 800 * 800 / 4


def test_topics_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x, copies, rep = collapsed(rows)
    want = plain_clusters(ids, x, copies, 10, 5)
    got = {r.vec_id: r.cluster for r in catalog.QUERIES["density_topics"](spark, SF).collect()}
    assert got == {i: want.get(rep[i]) for i, _ in rows}

@pytest.mark.parametrize("bound", [0, 5])
def test_rounds_and_bounded_finish_agree(table, monkeypatch, bound):
    tree = lambda: sorted((r.k, r.w, r.a, r.b) for r in D.reachability_tree(table, "k", "i", "e", SAMPLES).collect())
    clusters = lambda: {(r.k, r.i): r.cluster for r in D.density_clusters(table, "k", "i", "e", LEAST, SAMPLES).collect()}
    edges, found = tree(), clusters()
    monkeypatch.setattr(D, "BOUND", bound)
    monkeypatch.setattr(D, "CHUNK", 16)
    assert tree() == edges and clusters() == found


def test_rounds_do_not_grow_with_the_height_of_the_tree(spark, monkeypatch):
    """Groups that attach one after the other to what is there: the tables that are written are as many as for two groups."""
    def written(groups):
        names, inner = [], D._written
        monkeypatch.setattr(D, "_written", lambda df, name: names.append(name) or inner(df, name))
        rows = [(g * 20 + j, [math.cos(at), math.sin(at)]) for g in range(groups) for j in range(12) for at in [0.05 * 1.4**g + 1e-5 * j * 1.1**j]]
        found = {r.cluster for r in D.density_clusters(frame(spark, rows), "k", "i", "e", LEAST, SAMPLES).collect()} - {None}
        monkeypatch.setattr(D, "_written", inner)
        return len(found), sum(n != "parents" for n in names)

    (_, few), (many_found, many) = written(2), written(9)
    assert many_found >= 2 and few == many < 25
