"""SetSketch near-dedup against all pairs; sketches against the sets they stand for."""

from __future__ import annotations

import random
import re

import numpy as np

from reelgrid.llm import setsketch
from tests.llm.helpers import awkward, empty, frame, prose
from tests.llm.test_dedup import roots_of


def sets_of(texts, width=2):
    out = []
    for t in texts:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def all_links(sets):
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]


def edited(base, rng, most):
    w = base.split()
    for _ in range(rng.randint(0, most)):
        w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefgh")
    return " ".join(w)


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    family = prose(1, seed=3, size=150)[0]
    texts = prose(60) + [edited(family, rng, 22) for _ in range(160)]
    for t in prose(20, seed=5, size=12):
        texts += [t, edited(t, rng, 1), t.upper(), t + " " + t.split()[0]]
    texts += ["one", "ONE", "one two", "one  two", "a b c d e f", "a b c d e", "", None, " \n"]
    sets = sets_of(texts)
    want = roots_of(len(texts), all_links(sets))
    got = {r.doc_id: r for r in setsketch.near_components(frame(spark, texts), shingle=2).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))
    # The family has members near the threshold on both sides.
    assert 10 < sum(want[i] == i for i in range(60, 220)) < 150


def test_a_group_costs_about_its_size(spark, monkeypatch):
    counts, real = {}, setsketch.written

    def counted(df, label, outer=False):
        out = real(df, label, outer)
        if label in ("tried", "likely", "across"):
            counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(setsketch, "written", counted)
    rng, family = random.Random(7), prose(1, seed=3, size=150)[0]
    texts, seen = [edited(family, rng, 16) for _ in range(600)], {}
    for n in (150, 600):
        counts.clear()
        setsketch.near_components(frame(spark, texts[:n]), shingle=2).count()
        seen[n] = dict(counts)
    # All pairs would be 11,175 and 179,700.
    for label in ("tried", "likely"):
        assert seen[600][label] <= 8 * max(150, seen[150][label]) and seen[600][label] <= 20 * 600, seen
    assert seen[600].get("across", 0) <= 12 * 600, seen


def test_awkward_rows(spark):
    rows = setsketch.near_components(awkward(spark)).collect()
    assert len(rows) == 11
    blank = [r for r in rows if r.n_shingles == 0]
    assert len(blank) == 4 and all(r.component_id == r.doc_id and r.kept for r in blank)
    assert all(r.component_id == 4 for r in rows if r.doc_id in (4, 5))
    assert sum(r.doc_id is None and r.component_id == 4 and not r.kept for r in rows) == 1
    assert setsketch.near_components(empty(spark)).count() == 0
    kept = setsketch.without_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and 5 not in {r.doc_id for r in kept.collect()}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    for common, a, b in ((800, 100, 100), (400, 300, 300), (500, 0, 120), (0, 300, 300), (5, 1, 0)):
        both, x, y = fresh(common), fresh(a), fresh(b)
        u, v = setsketch.registers(np.concatenate([both, x]), 1024), setsketch.registers(np.concatenate([both, y]), 1024)
        true = common / (common + a + b)
        assert abs(setsketch.jaccard(u, v, common + a, common + b) - true) < 0.06 and abs(setsketch.jaccard(u, v) - true) < 0.12
        whole = setsketch.registers(np.concatenate([both, x, y]), 1024)
        assert (setsketch.merged(u, v) == whole).all()
        assert abs(setsketch.cardinality(whole) / (common + a + b) - 1) < 0.15
    assert setsketch.cardinality(setsketch.registers(fresh(0))) == 0
    wide, bands = setsketch.layout(10**6)
    assert (1 - 0.8**wide) ** bands <= 1e-4 and setsketch.layout(10**11)[1] < 4 * bands


def test_the_slope_tells_the_side_of_the_estimate(spark):
    """The test inside the join agrees with the estimate of greatest likelihood."""
    rng = np.random.default_rng(4)
    m, rows = 256, []
    for i in range(200):
        common, a, b = int(rng.integers(60, 300)), int(rng.integers(0, 60)), int(rng.integers(0, 60))
        parts = [rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2) for k in (common, a, b)]
        u, v = setsketch.registers(np.concatenate(parts[:2]), m), setsketch.registers(np.concatenate(parts[::2]), m)
        rows.append((i, common + a, common + b, u.tolist(), v.tolist(), setsketch._parity(u[None])[0].tolist(), setsketch._parity(v[None])[0].tolist()))
    df = spark.createDataFrame(rows, "i int, u_n long, v_n long, u_regs array<int>, v_regs array<int>, u_bits array<bigint>, v_bits array<bigint>")
    got = {r.i for r in df.where(setsketch.close(m, 0.8) & setsketch.likely(m, 0.8)).collect()}
    limit = setsketch.fewest(m, 0.8) / m
    for i, nu, nv, u, v, *_ in rows:
        j = setsketch.jaccard(np.array(u), np.array(v), nu, nv)
        if abs(j - limit) > 1e-6 and j > limit + 0.03 and min(nu, nv) >= 0.8 * max(nu, nv):
            assert i in got
        if j < limit - 1e-6:
            assert i not in got
    assert 20 < len(got) < 180
