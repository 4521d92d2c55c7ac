"""Spelling variants against every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from reelgrid.llm import spelling
from tests.llm.helpers import LONG, awkward, empty, frame


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, ratio=5):
    near = {w: [x for x in n if x != w and apart_by_one(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_forms_and_roots_against_all_pairs(spark):
    rng = random.Random(4)
    n = {}
    for _ in range(40):
        word, count = "".join(rng.choice("abcé") for _ in range(rng.randint(3, 8))), 6 ** rng.randint(1, 6)
        for _ in range(8):
            n.setdefault(word, count + rng.randint(0, 2))
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if kind == 0 else rng.choice("abcé")) + word[at + (kind != 1) :]
            count = max(1, count // rng.choice([1, 5, 6]))
            if not word:
                break
    n |= {"": 7, "z": 100, "y" * 3000: 10, "y" * 2999: 60, "y" * 2998 + "x": 400}
    want = plain(n)
    rows = spark.createDataFrame([(w, k, "x", 1) for w, k in n.items()], "word string, n long, id string, key int")
    assert got(spelling.variants(rows)) == want
    # Chains of more than one form occur, and ties go to the least word.
    assert any(r and want[r][0] for r, *_ in want.values())
    tie = spark.createDataFrame([("abcdex", 50), ("abcdey", 50), ("abcde", 2)], "word string, n long")
    assert got(spelling.variants(tie))["abcde"] == ("abcdex", "abcdex", 2, 2, 50)


def test_keys_are_those_of_the_distinct_deletions():
    powers, rng = spelling._Powers(), random.Random(1)
    whole = {}
    for _ in range(300):
        word = "".join(rng.choice("ab×ÿ") for _ in range(rng.randint(1, 9)))
        strings = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        keys = spelling.deletion_keys(word, powers).tolist()
        assert len(keys) == len(strings)
        whole[word] = (set(keys), strings)
    # Two words share as many keys as strings.
    for keys, strings in list(whole.values())[:60]:
        for k, s in whole.values():
            assert len(keys & k) == len(strings & s)
    assert len(spelling.deletion_keys("ab" * 50_000, powers)) == 100_001


def test_the_query_against_plain_counts(spark, tmp_path):
    rng = random.Random(8)
    words = ["tionality", "tionalité", "Ÿpsilons", "straße", "Größen×÷", "national", "nationale", "short", "Tionality"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "1"]) for _ in range(60)) for _ in range(200)] + [None, "", LONG]
    frame(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    n = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = plain({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})
    assert got(spelling.op12_spelling(spark, f"file://{tmp_path}")) == want and len(want) >= 7


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        assert spelling.op12_spelling(spark, f"file://{tmp_path}/{name}").count() == 0
