"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting grows one shallow tree a feature and round on binned values,
and adds its leaves to the feature's lookup table; then trees over pairs of
coarse bins fill a few pair tables. A score is the sum of the looked-up values
through a logistic. The model is fitted on the driver from the features of a
bounded sample of labelled rows; scoring is one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import in_pieces, in_sample, small_side, text_or_empty, written
from reelgrid.llm.language import held_out

#: Labelled rows that are learned from, about; a fixed hash of the id picks them.
SAMPLE_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 150, 60, 0.15, 8

FEATURES = (
    "log_chars", "letters", "upper", "digits", "punctuation", "symbols", "bars", "marks", "blanks", "word_length",
    "short_words", "long_words", "distinct_words", "lines_a_word", "repeated_lines", "ended_words",
)

_CLASSES = np.zeros((256, 8), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [
        _b > 127 or _c.isalpha(), 64 < _b < 91, _c.isdigit() and _b < 128, _c in ".,;:'\"()-?", _c in "#$%&*@^~_=+<>{}[]\\/`", _c == "|", _c == "!", _c in " \t\n\x0b\x0c\r",
    ]
_BLANK = _CLASSES[:, 7].astype(bool)
_CLOSES = np.array([chr(b) in ".,;:?!" for b in range(256)])


def features(text: str) -> list[float]:
    """The values named in ``FEATURES``, from the whole text; an empty text gives zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    letters, upper, digits, punctuation, symbols, bars, marks, blanks = (np.bincount(raw, minlength=256) @ _CLASSES).tolist()
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sizes = end - begin
    words = max(1, len(sizes))
    lines = text.split("\n")
    return [
        float(np.log1p(n)), letters / n, upper / max(1, letters), digits / n, punctuation / n, symbols / n, bars / words, marks / words, blanks / n, float(sizes.sum()) / words,
        float((sizes <= 3).sum()) / words, float((sizes >= 20).sum()) / words, len(set(text.split())) / words, len(lines) / words, 1 - len(set(lines)) / len(lines), float(_CLOSES[raw[end - 1]].sum()) / words,
    ]


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf value of each bin for the best tree of two splits along the bins."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            if b - a < 2:
                continue
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            gain[(cn[:-1] < LEAST_ROWS) | (cn[-1] - cn[:-1] < LEAST_ROWS)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], leaf, a + at + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts both axes once: four quadrants."""
    best, value = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = _gain(cg[-1, -1], ch[-1, -1])
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(_gain(a, b) for a, b in zip(*quads, strict=True)) - total
            if gain > best:
                leaf = [a / (b + 1.0) for a, b in zip(*quads, strict=True)]
                best, value = gain, np.zeros_like(g)
                value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit the tables to labels 0 and 1. Without rows the model scores 0.5; with one label, near that label."""
    width = x.shape[1]
    share = np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts, model.coarse = [_cuts(x[:, j], BINS) for j in range(width)], [_cuts(x[:, j], COARSE) for j in range(width)]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            add = RATE * _tree(np.bincount(b, g, len(rows[j])), np.bincount(b, h, len(rows[j])), rows[j])
            model.tables[j] += add
            total += add[b]

    def cells(a, b):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        g, h = slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_cross(*cells(a, b)[1:])[0], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            at, g, h = cells(a, b)
            add = RATE * _cross(g, h)[1]
            table += add
            total += add.ravel()[at]
    return model


def _vectors(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in in_pieces(batches):
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["order", "y", "x"])

    return rows.mapInArrow(run, "order long, y int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", may_learn=None, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on about ``sample_rows`` labelled rows where ``may_learn`` holds, twice that at most.

    Null labels and ids are left out; a null text counts as empty; labels of
    ids without a document teach nothing, and of repeated ids each row does.
    Empty tables give a model that scores every text alike. Other columns are
    not read.
    """
    pool = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    pool = pool if may_learn is None else pool.where(may_learn)
    chance = min(1.0, sample_rows / max(1, pool.count()))
    picked = pool.where(in_sample(id_col, chance)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = written(picked, "picked")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(small_side(picked, 32), "id").select("y", "text", F.xxhash64("id").alias("order"))
    drawn = _vectors(rows).orderBy("order", "y", "x").limit(2 * sample_rows)
    got = sorted((r["y"], list(r["x"])) for r in drawn.collect())
    return fit(np.array([v for _, v in got], np.float64).reshape(-1, len(FEATURES)), np.array([y for y, _ in got], np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    """id_col, score, predicted for each row of ``docs``.

    Null text counts as empty, and an empty text is scored from zeros. Null and
    repeated ids pass through; an empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in in_pieces(batches):
            x = np.array([features(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(held.value.score(x), pa.float64())], ["id", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, may_learn=~held_out("doc_id", 5, 0))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op9_quality": op9_quality}
