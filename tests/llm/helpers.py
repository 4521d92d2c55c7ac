"""Small corpora with the cases that every operator must stand."""

from __future__ import annotations

import random

LONG = "word " * 40_000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_uid long, h string, fp long, id long, key string, bucket long, part int"


def frame(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, x, None, None, 1, "h", 2, 3, "k", 4, 5) for i, t, x in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null texts, ids and languages; empty, blank and very long texts; ties; a row that repeats."""
    texts = [None, "", " \n\t", LONG, "one two three four five six", "one  two three\nfour five six", "one two three four five six", "日本語 テスト 🙂", "x" * 5000, None, "one two three four five six"]
    ids = [0, 1, 2, 3, 4, 5, 5, 7, 8, None, None]
    langs = ["en", None, "en", "de", "de", None, "en", "ja", None, "en", None]
    return frame(spark, texts, ids, langs)


def empty(spark):
    return frame(spark, [])


def prose(n=60, seed=1, size=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(size // 2, size))) + "." for _ in range(n)]
