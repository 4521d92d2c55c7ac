"""Personal data: base patterns, and a skip-chain conditional random field over what they leave.

The base finds four kinds by pattern. The field's nodes are the tokens that
hold a digit or an at sign; neighbours in the text share chain potentials, and
distant tokens with equal letters and digits share skip potentials, so that a
repeated mention tends to one label throughout a document. Base findings are
observed; loopy message passing gives the other tokens' marginals, and a token
whose marginal for one kind passes a threshold becomes an added span. Skip
links join each mention to the one before it, never all pairs.

Weights are fitted on the driver by pseudo-likelihood, from the tokens of a
bounded sample of documents with the base findings as labels. Finding is one
scan without a shuffle; all documents of a batch are one sparse graph.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import BLANKS, in_pieces, in_sample, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents whose tokens are learned from, about; a fixed hash of the id picks them.
SAMPLE_DOCS = 3_000
#: Tokens learned from, at most.
SAMPLE_TOKENS = 60_000
#: Texts whose messages have settled are set aside every so many ROUNDS.
THRESHOLD, ROUNDS = 0.95, 10
#: Messages have settled when none changes by more in a round.
TOLERANCE = 1e-8
#: After so many rounds the step is halved, and again: messages that swing for ever settle too.
CALM = 1_000
#: Where the weights of equal labels across a skip link are drawn to, before data speak: repeated mentions agree.
AGREE = 4.5
#: Log potential of a label that an observed token hasn't.
NEVER = -60.0

_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").finditer
_card = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_seed = re.compile(r"[0-9@][^\x20\x09-\x0D]*").finditer
_not_digit = re.compile(r"[^0-9]+")
_not_key = re.compile(r"[^A-Za-z0-9@]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs: no character is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((start, done))
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start. Matches that fail their test are dropped, without a retry."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _digit(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in _ip(text) if all(not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _card(text):
        if m.end() - m.start() >= 13:
            d = _not_digit.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(_not_digit.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


FEATURES = 15


def token_features(t: str) -> list[int]:
    """The shape of a token, without the tests of the base."""
    d = sum(c in "0123456789" for c in t)
    dots, ats = t.count("."), t.count("@")
    alpha = any(c.isalpha() for c in t)
    return [1, ats == 1, ats > 1, ats == 1 and dots > 0, dots == 3, dots > 0 and dots != 3, 1 <= d <= 3, 4 <= d <= 8, 9 <= d <= 12, 13 <= d <= 19, d > 19, alpha and d > 0, t[0] == "+", t[0] == "(", "-" in t or "/" in t]


@dataclass
class Tokens:
    """Tokens of one text: places, shapes, labels from the base, and links to earlier tokens."""

    spans: list[tuple[int, int]]
    shapes: list[list[int]]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def tokens(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    out = Tokens([], [], [], [], [])
    last, seen = -1, {}
    ordered, b = sorted((s, e, k) for k, s, e in base), 0
    for m in _seed(text):
        start = m.start()
        if start < last:
            continue
        while start > max(last, 0) and text[start - 1] not in BLANKS:
            start -= 1
        end = m.end()
        core = text[start:end].strip(".,;:!?)[]<>\"'|*#$%&")
        if not core:
            continue
        begin = start + text[start:end].find(core)
        i = len(out.spans)
        touching = i > 0 and not text[last:start].strip(BLANKS)
        last = end
        while b < len(ordered) and ordered[b][1] <= begin:
            b += 1
        label = 0
        for s, e, k in islice(ordered, b, None):
            if s >= begin + len(core):
                break
            if begin < e:
                label = k + 1
                break
        out.spans.append((begin, begin + len(core)))
        out.shapes.append(token_features(core))
        out.labels.append(label)
        if touching:
            out.chain.append((i - 1, i))
        key = _not_key.sub("", core).lower()
        if key in seen and not (touching and seen[key] == i - 1):
            out.skip.append((seen[key], i))
        seen[key] = i
    return out


@dataclass
class FieldModel:
    """node: FEATURES x labels; chain and skip: symmetric label x label log potentials."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def untrained(cls) -> FieldModel:
        k = len(LABELS)
        node = np.zeros((FEATURES, k))
        node[0, 0] = 3.0
        return cls(node, np.zeros((k, k)), AGREE * np.diag([0.0] + [1.0] * (k - 1)))


def fit(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> FieldModel:
    """Pseudo-likelihood: each label given its shape and its neighbours' labels (``chain``, ``skip``: counts by label)."""
    if not len(y):
        return FieldModel.untrained()
    k = len(LABELS)
    design = np.concatenate([x, chain, skip], axis=1).astype(np.float64)
    target = np.eye(k)[y]
    prior = np.zeros((design.shape[1], k))
    prior[FEATURES + k :] = FieldModel.untrained().skip
    w, first, second = prior, 0.0, 0.0
    for t in range(1, steps + 1):
        p = design @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = design.T @ (p - target) / len(y) + decay * (w - prior)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    node, c, s = w[:FEATURES], w[FEATURES : FEATURES + k], w[FEATURES + k :]
    return FieldModel(node, (c + c.T) / 2, (s + s.T) / 2)


def marginals(model: FieldModel, potentials: np.ndarray, chain: np.ndarray, skip: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Label marginals of each node by loopy sum-product until the messages settle; links are rows (i, j).

    ``owner`` numbers the text of each node: links stay inside a text, and each text settles by itself.
    """
    n, k = potentials.shape
    owner = np.zeros(n, np.int64) if owner is None else owner
    names, text = np.unique(owner, return_inverse=True)
    links = np.concatenate([chain.reshape(-1, 2), skip.reshape(-1, 2)])
    pair = np.concatenate([np.repeat(model.chain[None], len(chain), 0), np.repeat(model.skip[None], len(skip), 0)]).reshape(-1, k, k)
    source, goal = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    pair = np.concatenate([pair, pair])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    message = np.zeros((len(source), k))

    def gathered(message, goal, potentials):
        return potentials + np.stack([np.bincount(goal, message[:, c], len(potentials)) for c in range(k)], axis=1)

    active, turn = np.arange(len(source)), 0
    while len(active):
        # The links of the texts that still move, with their nodes and returns numbered anew.
        nodes, ends = np.unique(np.concatenate([source[active], goal[active]]), return_inverse=True)
        s, g = ends[: len(active)], ends[len(active) :]
        b, pairs, held, local = np.searchsorted(active, back[active]), pair[active], message[active], potentials[nodes]
        for _ in range(ROUNDS):
            own = gathered(held, g, local)[s] - held[b]
            new = np.logaddexp.reduce(own[:, :, None] + pairs, axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = 0.5 ** (1 + turn // CALM) * (new - held)
            held = held + change
            turn += 1
        message[active] = held
        moving = np.zeros(len(names), bool)
        moving[text[source[active][np.abs(change).max(axis=1) > TOLERANCE]]] = True
        active = active[moving[text[source[active]]]]
    belief = gathered(message, goal, potentials)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(model: FieldModel, found: list[Tokens], threshold: float = THRESHOLD) -> list[list[tuple[int, int, int]]]:
    """For each text the (kind, start, end) that the field adds to its base."""
    sizes = [len(t.spans) for t in found]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else np.zeros(0, int)
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    if not sum(sizes):
        return out
    labels = np.array([x for t in found for x in t.labels])
    potentials = np.array([x for t in found for x in t.shapes], np.float64) @ model.node
    observed = labels > 0
    potentials[observed] = NEVER
    potentials[observed, labels[observed]] = 0
    links = [np.array([(a + f, b + f) for t, f in zip(found, first.tolist(), strict=True) for a, b in getattr(t, name)], np.int64).reshape(-1, 2) for name in ("chain", "skip")]
    owner = np.repeat(np.arange(len(found)), sizes)
    p = marginals(model, potentials, *links, owner)
    sure = ~observed & (p[:, 1:].max(axis=1) >= threshold)
    for i in np.flatnonzero(sure).tolist():
        d = int(owner[i])
        out[d].append((int(p[i, 1:].argmax()), *found[d].spans[i - int(first[d])]))
    return out


def listed(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)])


def learn(docs: DataFrame, id_col="doc_id", text_col="text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> FieldModel:
    """Fit on the tokens of about ``sample_docs`` documents, ``sample_tokens`` tokens at most.

    Rows with a null id are left out; null texts have no tokens; rows that
    share an id are drawn together. An empty table, or one without tokens,
    gives the untrained model. Other columns are not read.
    """
    ids = docs.where(F.col(id_col).isNotNull())
    chance = min(1.0, sample_docs / max(1, ids.count()))
    sample = ids.where(in_sample(id_col, chance)).select(F.xxhash64(F.col(id_col)).alias("doc"), text_or_empty(text_col).alias("text"))
    k = len(LABELS)

    def run(batches):
        for b in in_pieces(batches):
            docs, places, rows = [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = tokens(text, base_spans(text))
                near = np.zeros((len(t.labels), 2 * k), np.int64)
                for at, links in ((0, t.chain), (k, t.skip)):
                    for i, j in links:
                        near[i, at + t.labels[j]] += 1
                        near[j, at + t.labels[i]] += 1
                docs += [doc] * len(t.labels)
                places += range(len(t.labels))
                rows += [[y, *map(int, shape), *n] for y, shape, n in zip(t.labels, t.shapes, near.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc", "place", "row"])

    drawn = sample.mapInArrow(run, "doc long, place long, row array<int>").withColumn("order", F.xxhash64("doc", "place")).orderBy("order", "doc", "place", "row").limit(sample_tokens)
    rows = np.array([r["row"] for r in drawn.select("row").collect()], np.float64).reshape(-1, 1 + FEATURES + 2 * k)
    return fit(rows[:, 1 : 1 + FEATURES], rows[:, 1 + FEATURES : 1 + FEATURES + k], rows[:, 1 + FEATURES + k :], rows[:, 0].astype(int))


def find(docs: DataFrame, model: FieldModel, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, base, spans (arrays of kind, start, end) and redacted text for each row of ``docs``.

    Offsets are code points, ends exclusive. Every span of the base is among
    the spans. The redacted text has ``<KIND>`` for each span; of overlapping
    spans the first, then the longer, names the stretch they cover. Null text
    counts as empty and has no spans; null and repeated ids pass through; an
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in in_pieces(batches):
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(held.value, [tokens(t, s) for t, s in zip(texts, base, strict=True)])
            both = [s + m for s, m in zip(base, more, strict=True)]
            cols = [pa.array(x, pa.string()) for x in (map(listed, base), map(listed, both), map(redact, texts, both))]
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *counts, *cols], ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "text"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, text string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    if not spans:
        return text
    out, done = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b in spans):
        end = -end
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, model: FieldModel, text_col="text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, personal data in the text replaced by ``<KIND>``; null texts stay null.

    ``length_col``, if given, becomes the code points of the new text, null
    where that is null. Empty texts stay empty; null and repeated ids, ties and
    repeated rows pass through, each row by itself; an empty table gives an
    empty result; columns of any name keep their values.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in in_pieces(batches):
            texts = b.column(at).to_pylist()
            base = [base_spans(t or "") for t in texts]
            more = added_spans(held.value, [tokens(t or "", s) for t, s in zip(texts, base, strict=True)])
            new = [t and redact(t, s + m) for t, s, m in zip(texts, base, more, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out


def op7_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find(docs, learn(docs))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op7_pii": op7_pii}
