"""Exact, line and near dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelgrid.llm import components, exact_dedup, line_dedup, neardup, simhash, sketches
from tests.llm.helpers import awkward, empty, frame, prose

BLANK = re.compile(r"[\x20\x09-\x0D]")


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_exact_keeps_longest_then_smallest(spark):
    df = frame(spark, ["a b", "ab", "a  b", "a b ", None, "", " ", "c"], [9, 1, 7, 5, 4, 3, 2, 8])
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    assert {i: out[i].keep_id for i in out} == {9: 5, 1: 5, 7: 5, 5: 5, 4: 2, 3: 2, 2: 2, 8: 8}
    assert out[9].group_size == 4 and out[8].group_size == 1
    assert {i for i in out if out[i].kept} == {5, 2, 8}
    assert out[9].text_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_exact_tells_colliding_texts_apart(spark):
    df = frame(spark, ["aa", "ab", "a a", "b"])
    weak = lambda norm: F.substring(norm, 1, 1).cast("binary")
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, hash128=weak).collect()}
    assert out == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1)}


def test_exact_on_awkward_rows(spark):
    rows = exact_dedup.exact_dedup(awkward(spark)).collect()
    assert len(rows) == 11
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r.kept)
    assert all(sum(k) == 1 for k in groups.values())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.without_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == len(groups)


def brute_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lines_against_brute_force(spark, limit):
    rng = random.Random(5)
    pool = [p[: rng.randint(15, 60)] for p in prose(25)]
    vary = [lambda s: s, str.upper, lambda s: "  " + s + "\t", lambda s: s + "é"]
    docs = [(i, "\n".join(rng.choice(vary)(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "A" * 20 + "\n" + "A" * 20), (62, "a" * 20), (63, "a" * 20 + " "), (64, "ÉÉ" * 20)]
    out = line_dedup.line_dedup(frame(spark, [t for _, t in docs], [i for i, _ in docs]), broadcast_bytes=limit)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == brute_lines(docs)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lines_on_awkward_rows(spark, limit):
    rows = line_dedup.line_dedup(awkward(spark), broadcast_bytes=limit).collect()
    assert len(rows) == 11
    assert sorted(r.n_dropped for r in rows if r.text == "" and r.n_lines == 1)[-1] == 1
    assert line_dedup.line_dedup(empty(spark), broadcast_bytes=limit).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000, dtype=np.uint64))
    m = line_dedup.MinimalPerfectHash(keys)
    assert sorted(m.index(keys).tolist()) == list(range(len(keys)))
    n = len(keys)
    shard = line_dedup.LineShard(keys, keys ^ np.uint64(7), np.arange(n) + 3, np.arange(n))
    count, keep = shard.probe(keys, keys ^ np.uint64(7))
    assert (count == np.arange(n) + 3).all() and (keep == np.arange(n)).all()
    assert not shard.probe(keys, keys)[0].any()
    twice = line_dedup.LineShard(np.array([5, 5], np.uint64), np.array([1, 2], np.uint64), np.array([3, 4]), np.array([10, 20]))
    assert twice.probe(np.array([5, 5, 5], np.uint64), np.array([1, 2, 3], np.uint64))[1].tolist() == [10, 20, line_dedup.NO_ID]


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints(spark):
    texts = [*prose(20), "", None, "One", "one TWO", "É é Ü", "a\x0bb\x0cc d"]
    for r in simhash.near_components(frame(spark, texts)).collect():
        assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"


@pytest.mark.parametrize("hot", [512, 3])
def test_links_of_close_fingerprints(spark, hot):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 30, dtype=np.uint64)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(12):
            fps.add(b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = {tuple(sorted(r)) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (201, 200)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(out.values()) == {0, 100, 200} and out[40] == 0 and out[149] == 100 and out[201] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_on_awkward_rows(spark):
    out = simhash.near_components(awkward(spark)).collect()
    assert len(out) == 11
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert len(zero) >= 4 and {r.component_id for r in zero} == {0}
    assert simhash.near_components(empty(spark)).count() == 0


@pytest.mark.parametrize(("crowded", "busy"), [(64, 16), (1, 2)])
def test_near_groups_against_brute_force(spark, crowded, busy):
    rng = random.Random(2)
    texts = []
    for p in prose(20, size=160):
        texts.append(p)
        for _ in range(6):
            w = p.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    out = {r.uid: r.root for r in neardup.near_groups(df, crowded=crowded, busy=busy).collect()}
    sets = [set(sketches.shingles(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    missed = sum(out[i] != out[j] for i, j in links)
    assert missed <= 0.01 * len(links)
    want = roots_of(len(texts), links)
    for group in {r: [u for u in out if out[u] == r] for r in out.values()}.values():
        assert len({want[u] for u in group}) == 1


def test_bit_tests_keep_pairs_at_the_threshold():
    assert neardup.exact_odds(1, 0, 4) == 0.1875
    for short, sizes in ((True, (1, 0, 4)), (False, (5, 4, 36)), (False, (100, 100, 800))):
        p = neardup.exact_odds(*sizes)
        for bits in (64, 128, 64 * neardup.WIDE):
            most = neardup.greatest_distance(bits, 0.8, short)
            ways = [math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in range(most + 1)]
            assert 1 - sum(math.exp(w + d * math.log(p) + (bits - d) * math.log(1 - p)) for d, w in enumerate(ways)) < 1e-4


def test_short_texts_with_a_word_added_are_found(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    out = {r.uid: r.root for r in neardup.near_groups(df).collect()}
    found = sum(out[i] == out[i + 1] for i in range(0, len(texts), 2))
    assert found == 400 and len(set(out.values())) == 400


def test_equal_fingerprints_are_not_equal_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(12)]
    texts += [t + " end" for t in texts] + texts[:2]
    real = neardup.fingerprint_words
    monkeypatch.setattr(neardup, "fingerprint_words", lambda own, first, last: real(own, first, last) if first else bytes(8) + real(own, 0, last)[8:])
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    out = {r.uid: r.root for r in neardup.near_groups(df).collect()}
    assert all(out[i] == i and out[i + 12] == i for i in range(12)) and out[24] == 0 and out[25] == 1


def test_near_copies_keep_one(spark):
    kept = neardup.without_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.where(F.trim(F.coalesce("text", F.lit(""))) == "").count() <= 2
    assert neardup.without_near_copies(empty(spark)).count() == 0
