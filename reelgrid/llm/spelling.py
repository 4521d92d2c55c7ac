"""Spelling variant grouping by a symmetric-delete join.

Every word emits a key for itself and for each of its distinct single
deletions; words at distance one share a key. Keys are 64-bit hashes of the
strings, all of a word's made in linear time from running sums of a polynomial,
so a word of any length costs its length and not its square. Words with a key
in common are compared exactly. The holders of a key are a few letters apart at
one place each, so a key's holders are bounded by its length and the alphabet,
whatever the corpus.

A word's form is the near word that is met most, if it is met often enough;
roots follow the forms to their end by doubling.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import discard, in_pieces, scratch, small_side, written
from reelgrid.llm.line_dedup import mixed

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: The letters of a run beside A-Z, which are lower-cased first.
LETTERS = "a-zÀ-ÿ"
#: The base of the polynomial, odd.
BASE = 0x9E3779B97F4A7C15


def runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of letters, A-Z in lower case, that have at least so many."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))


def counted(words: DataFrame, word: str, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words long and frequent enough; counts are folded where rows are read."""
    n = words.where(F.char_length(word) >= least_chars).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least_count)


class _Powers:
    """BASE ** 0, 1, ... modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            steps = np.full(max(n, 2 * len(self.table)), BASE, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                self.table = np.cumprod(steps)
        return self.table[:n]


def deletion_keys(word: str, powers: _Powers) -> np.ndarray:
    """Distinct hashes of the word and of its single deletions."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(c):
        return mixed(np.zeros(1, np.uint64), 12)
    p = powers.upto(len(c))[::-1]
    with np.errstate(over="ignore"):
        whole = c * p
        # Letters before the deleted one move down a place.
        before = np.zeros(len(c), np.uint64)
        before[1:] = np.cumsum(c[:-1] * p[1:])
        upto = np.cumsum(whole)
        return mixed(np.unique(np.append(before + (upto[-1] - upto), upto[-1])), 12)


def _keyed(words: DataFrame) -> DataFrame:
    """(key, id) of each word's keys."""

    def run(batches):
        powers = _Powers()
        for b in in_pieces(batches, 2_000, 1 << 18):
            keys = [deletion_keys(w, powers) for w in b.column("word").to_pylist()]
            ids = np.repeat(b.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_words(words: DataFrame) -> DataFrame:
    """(u, v): both directions of each pair of ``words`` (id, word) at distance one."""
    keys = written(_keyed(words), "keys")
    other = keys.select(F.col("key").alias("at"), F.col("id").alias("v"))
    pairs = written(keys.join(other, (F.col("key") == F.col("at")) & (F.col("id") < F.col("v"))).select(F.col("id").alias("u"), "v").distinct(), "pairs")
    side = lambda name: small_side(words.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word")), 64)
    one = F.levenshtein(F.col("u_word"), F.col("v_word"), 1) == 1
    links = pairs.join(side("u"), "u").join(side("v"), "v").where(one).select("u", "v")
    links = written(links, "links")
    return links.union(links.select("v", "u"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of each row of ``forms`` (id, form): the last of its forms. Forms never lead in a circle, as counts rise."""
    at = written(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = at.join(small_side(ahead, 16), "root", "left")
        now = written(step.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        done = not now.where("moved").limit(1).count()
        discard(at)
        at = now.select("id", "root")
        at.written_path = now.written_path
        if done:
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near, root for each row of ``words`` (word string, n long; distinct, not null).

    Two words are near if one inserted, deleted or replaced code point turns
    one into the other. n_near counts the near words. A word's form is its near
    word of largest n, the least in code-point order on ties, if that n is at
    least ``ratio`` (above 1) times the word's; form and form_n are null
    otherwise. root follows the forms to the last, and is the word itself
    without a form. Words may be of any length; an empty table gives an empty
    result; other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("forms lead to more frequent words only with a ratio above 1")
    with scratch():
        known = written(words.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()), "words")
        side = known.select(F.col("id").alias("v"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("it"))
        best = near_words(known).join(small_side(side, 64), "v").groupBy("u").agg(F.count(F.lit(1)).alias("n_near"), F.min("it").alias("best"))
        near = known.join(best.withColumnRenamed("u", "id"), "id", "left")
        enough = -F.col("best.less") >= ratio * F.col("n")
        found = written(
            near.select(
                "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                *[F.when(enough, x).alias(name) for name, x in (("form", F.col("best.word")), ("form_n", -F.col("best.less")), ("form_id", F.col("best.id")))],
            ),
            "found",
        )
        roots = _roots(found.where("form_id IS NOT NULL"))
        names = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
        ends = written(roots.join(small_side(names, 64), "root").select("id", "root_word"), "ends")
        out = found.join(small_side(ends, 64), "id", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root_word", "word").alias("root"))
        return written(out, "variants", outer=True)


def op12_spelling(spark, sf_dir):
    """Every 199th occurrence, by a hash of document and word, first loses a letter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = docs.select("doc_id", F.explode(runs(F.col("text"), LEAST_CHARS)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    words = run.select(F.when(h % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return variants(counted(words, "word")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12_spelling}
