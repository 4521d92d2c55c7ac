"""Language identification with error-correcting output codes.

Each language has a codeword of bits; a logistic classifier over hashed byte
n-grams predicts each bit; the language whose codeword has the least summed
loss is chosen. A second codeword nearly as close flags the text as ambiguous.
Models are fitted on the driver from n-gram vectors of a bounded sample, made
on the executors from whole texts; scoring is one scan without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, in_sample, text_or_empty

#: Vectors: so many hashed two-byte and so many hashed three-byte counts.
BUCKETS = 2048
#: Rows of a language that are learned from, about; a fixed hash of the id picks them.
ROWS_PER_LANGUAGE = 300
#: Values of ``lang`` that are learned at most; more are an error.
MOST_LANGUAGES = 1_000
#: Up to so many languages the code has every column; beyond, random columns of greatest separation.
EXHAUSTIVE = 6
#: Loss margin to the second codeword, a classifier, under which a text is ambiguous.
AMBIGUOUS = 0.05

_word_characters = re.compile(r"[^\W\d_]").finditer
#: ASCII letters in lower case, bytes of other characters as they are, the rest as blanks.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """A letter is a character of Unicode's category L: superscripts, fractions, Roman and circled numbers are none."""
    return bool(text) and any(m.group().isalpha() for m in _word_characters(text))


def ngram_counts(texts: list[str]) -> np.ndarray:
    """A row for each text: counts of hashed byte pairs and triples, scaled to length one."""
    out = np.zeros((len(texts), 2 * BUCKETS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
        pair = raw[:-1] * np.uint32(257) + raw[1:]
        seen = np.bincount(_slot(pair[pair != 32 * 257 + 32]), minlength=BUCKETS)
        triple = pair[:-1] * np.uint32(263) + raw[2:]
        thrice = np.bincount(_slot(triple[pair[1:] != 32 * 257 + 32]), minlength=BUCKETS)
        row = np.sqrt(np.concatenate([seen, thrice]))
        out[i] = row / max(1e-9, np.sqrt((row * row).sum()))
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1. Small codes have every distinct column; larger ones the best of 200 random draws."""
    if n <= EXHAUSTIVE:
        columns = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 2**n - 1) if mask & 1]
        return np.array(columns, np.int64).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    draws = (rng.choice([-1, 1], (n, 8 * (n - 1).bit_length())) for _ in range(200))
    usable = [d for d in draws if (np.abs(d.sum(axis=0)) < n).all()]
    apart = lambda d: -np.max(d @ d.T - 2 * d.shape[1] * np.eye(n))
    return max(usable, key=apart)


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def losses(self, vectors: np.ndarray) -> np.ndarray:
        """Summed logistic loss of each codeword against the predicted bits."""
        margins = vectors @ self.weights + self.bias
        return np.logaddexp(0, -margins[:, None, :] * self.codes[None]).sum(axis=2)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; ``und`` where a text has no letter."""
        real = [i for i, t in enumerate(texts) if has_letter(t)]
        out = [("und", 0.0, True)] * len(texts)
        if not real or not self.languages:
            return out
        loss = self.losses(ngram_counts([texts[i] for i in real]))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        near = np.sort(loss, axis=1)
        margin = (near[:, 1] - near[:, 0]) / max(1, self.codes.shape[1]) if loss.shape[1] > 1 else np.ones(len(real))
        for j, i in enumerate(real):
            out[i] = (self.languages[best[j]], float(share[j, best[j]]), bool(margin[j] < AMBIGUOUS))
        return out


def fit(vectors: np.ndarray, labels: list[str], rounds: int = 150, decay: float = 1e-4) -> LanguageModel:
    """One logistic classifier a column of the code, by accelerated full-batch descent."""
    languages = sorted(set(labels))
    codes = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 1), np.int64)
    width = codes.shape[1]
    w, b = np.zeros((vectors.shape[1], width), np.float32), np.zeros(width, np.float32)
    if len(languages) > 1:
        row = np.array([languages.index(x) for x in labels])
        target = codes[row].astype(np.float32)
        weight = (1 / np.bincount(row))[row][:, None].astype(np.float32) / len(languages)
        ahead_w, ahead_b, step = w, b, np.float32(8.0)
        for t in range(1, rounds + 1):
            pull = -target / (1 + np.exp(target * (vectors @ ahead_w + ahead_b))) * weight
            new_w = ahead_w - step * (vectors.T @ pull + np.float32(decay) * ahead_w)
            new_b = ahead_b - step * pull.sum(axis=0)
            speed = np.float32((t - 1) / (t + 2))
            ahead_w, ahead_b, w, b = new_w + speed * (new_w - w), new_b + speed * (new_b - b), new_w, new_b
    return LanguageModel(languages, codes, w, b)


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", may_learn=None, rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Fit on about ``rows_per_language`` labelled rows of each language where ``may_learn`` holds.

    Twice that number for each language, all together, reach the driver at
    most, however often an id repeats; more than ``most_languages`` are an
    error. Rows with a null id, text or language and texts without a letter
    teach nothing. An empty table gives a model without a language. Other
    columns are not read.
    """
    usable = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    pool = docs.where(usable if may_learn is None else usable & may_learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} values of {lang_col}")
    if not counts:
        return LanguageModel([], np.ones((0, 1), np.int64), np.zeros((2 * BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])[F.col("lang")]
    sample = pool.where(in_sample("id", chance)).withColumn("order", F.xxhash64("id"))

    def run(batches):
        for b in in_pieces(batches):
            b = b.filter(pa.array([has_letter(t) for t in b.column("text").to_pylist()], pa.bool_()))
            v = ngram_counts(b.column("text").to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("lang"), pa.array([r.tobytes() for r in v], pa.binary())], ["order", "lang", "v"])

    drawn = sample.mapInArrow(run, "order long, lang string, v binary").orderBy("order", "lang", "v").limit(2 * rows_per_language * len(counts))
    rows = sorted((r["lang"], bytes(r["v"])) for r in drawn.collect())
    return fit(np.array([np.frombuffer(v, "<f4") for _, v in rows]).reshape(-1, 2 * BUCKETS), [x for x, _ in rows])


def identify(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` ids with lang_pred, score, ambiguous.

    A null text, or one without a letter, is ``und`` with score 0. With no
    language learned every row is ``und``. Null and repeated ids pass through;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in in_pieces(batches):
            got = held.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([g[j] for g in got], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col="text") -> DataFrame:
    """``docs`` with all its columns, without rows that have no letter or whose language is ambiguous.

    Null and empty texts have no letter and go. With no language learned, all
    rows stay. Null and repeated ids, ties and repeated rows are judged each by
    itself; an empty table gives an empty result; columns of any name keep
    their values.
    """
    if not model.languages:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in in_pieces(batches):
            got = held.value.predict(b.column(text_col).to_pylist())
            yield b.filter(pa.array([not ambiguous for _, _, ambiguous in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, mod: int, rest: int):
    """True where crc32 of the id as text leaves ``rest``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def op10_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, may_learn=~held_out("doc_id", 4, 2))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_language_id": op10_language_id}
