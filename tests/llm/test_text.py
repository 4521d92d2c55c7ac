"""Tokens, packing, pieces, sketches."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from reelgrid.llm import bpe, packing, sketches, token_counts, unigram
from tests.llm.helpers import LONG, awkward, empty, frame, prose

PIECES = ["a", "the", " the", " ", "  ", "\n", "\t", " \n", "'s", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "<|endo", " ", "　", "🙂", "ß", "\x0b", "\x1c", "\x85", "\r\n"]


def fuzz(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocab())


def test_tokens_match_the_library(library):
    ids, count = bpe.token_ids(bpe.default_vocab()), bpe.token_count(bpe.default_vocab())
    for t in [*fuzz(), *prose(20), "a" * 3000, "ab" * 2000, " " * 2000, "\n" * 900, "x" * 401 + " y", ""]:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(t) == struct.pack(f"<{len(want)}I", *want)
        assert count(t) == len(want)


def test_whole_tokens_are_proved(library):
    whole = bpe.token_count(bpe.default_vocab()).whole
    assert len(whole) > 45_000
    for s in random.Random(1).sample(sorted(whole), 300):
        assert library.encode(s, add_special_tokens=False).ids == [whole[s]]


def test_counts_on_awkward_rows(spark, library):
    rows = token_counts.token_counts(awkward(spark)).collect()
    assert len(rows) == 11
    long = next(r for r in rows if r.doc_id == 3)
    assert long.n_bytes == len(LONG) and long.n_tokens == len(library.encode(LONG, add_special_tokens=False).ids) and long.over_limit
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (0, 1)} == {(0, 0)}
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_best_fit_finds_the_tightest():
    opened = packing.OpenWindows(16)
    for left, w in ((3, 0), (9, 1), (5, 2)):
        opened.put(left, w)
    assert opened.take(4) == (5, 2) and opened.take(4) == (9, 1) and opened.take(4) is None and opened.take(1) == (3, 0)


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    window, offset = packing.best_fit_decreasing(lengths, 64)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(64 - n)
    fill = np.bincount(window, lengths)
    assert sorted(64 - fill) == sorted(free)
    for w in range(len(fill)):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(window == w))
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0


def check_pack(df, library, spark):
    rows = packing.pack(df).collect()
    docs = [(r.doc_id, r.text or "") for r in df.collect()]
    want = []
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want.append((i, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    return by


def test_packing(spark, library, monkeypatch):
    texts = prose(80, size=900)
    by = check_pack(frame(spark, texts), library, spark)
    assert sum(n for own in by.values() for _, n in own) > 0.93 * 1024 * len(by)
    check_pack(awkward(spark), library, spark)
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    check_pack(frame(spark, texts), library, spark)
    assert packing.pack(empty(spark)).count() == 0


def unigram_library():
    """The library over the same pieces as a unigram model."""
    import sentencepiece

    def number(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out

    message = lambda f, b: number(f << 3 | 2) + number(len(b)) + b
    value = lambda f, n: number(f << 3) + number(n)
    pieces = unigram.read_model(unigram.default_model())
    out = b"".join(message(1, message(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + value(3, k)) for (p, _, k), s in zip(pieces, unigram.log_scores(pieces), strict=True))
    out += message(2, value(3, 1) + value(4, len(pieces)) + value(35, 1)) + message(3, message(1, b"identity") + value(3, 1) + value(4, 0) + value(5, 1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_pieces_score_like_the_library():
    lib, own = unigram_library(), unigram.codec(unigram.default_model())
    score = own.model.score
    texts = [*prose(20), *fuzz(200), "日本語テスト 🙂🙂", "\n\n", "z" * 200, " x ", "a  b   c"]
    texts = [t for t in texts if "\x00" not in t]
    equal = 0
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = lib.encode(t)
        equal += want == ids.tolist()
        total = lambda x: sum(score[i] for i in x if not own.model.is_byte[i])
        assert sum(own.model.is_byte[np.array(want, int)]) == sum(own.model.is_byte[ids])
        assert total(want) <= total(ids.tolist()) + 1e-3
        assert own.decode(ids) == t
    assert equal >= 0.95 * len(texts)


def test_long_and_short_chunks_agree():
    model = unigram.codec(unigram.default_model()).model
    for chunk in [unigram.MARK + w for w in ["", "a", "tokenization", "日本語", "🙂x🙂", "zzzzqqqq", "a\nb"]]:
        assert model.solve([chunk])[0] == model._trace(chunk.encode(), *model._path(chunk.encode()))


def test_pieces_on_awkward_rows(spark):
    out = unigram.round_trips(awkward(spark)).collect()
    assert len(out) == 11 and all(r.round_trip for r in out)
    assert {r.n_pieces for r in out if r.text == ""} == {0}
    marked = unigram.round_trips(frame(spark, ["a▁b"])).first()
    assert not marked.round_trip and marked.text == "a b"
    assert unigram.round_trips(empty(spark)).count() == 0
    pair = unigram.decode(unigram.encode(awkward(spark)))
    assert sorted(r.text for r in pair.collect()) == sorted(r.text or "" for r in awkward(spark).collect())


def test_sketch_estimates():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    x, y = sketches.sketch(a), sketches.sketch(b)
    true = len(np.intersect1d(sketches.shingles(a), sketches.shingles(b))) / len(np.union1d(sketches.shingles(a), sketches.shingles(b)))
    assert abs(sketches.resemblance(x, y) - true) < 0.13
    assert abs(sketches.containment(x, y) - 2 / 3) < 0.2
    assert abs(sketches.distinct_count(x) / 2996 - 1) < 0.3
    assert (sketches.merge(x, y) == sketches.sketch(a + " | " + b)[: sketches.K]).mean() > 0.9
    assert (sketches.decoded(sketches.encoded(x)) == x).all()
    empty_one = sketches.sketch("")
    assert sketches.resemblance(empty_one, empty_one) == 1 and sketches.resemblance(empty_one, x) == 0


@pytest.mark.parametrize("bucket", [4000, 3])
def test_edited_texts_follow_descending_ids(spark, monkeypatch, bucket):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", bucket)
    texts = [*prose(30), "", None, "short"]
    ids = [(7 * i) % 101 for i in range(len(texts))]
    out = {r.doc_id: r for r in sketches.edited_likeness(frame(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(t)
        assert abs(out[i].near_edited - (1.0 if edited == t else len(np.intersect1d(sketches.shingles(t), sketches.shingles(edited))) / max(1, len(np.union1d(sketches.shingles(t), sketches.shingles(edited)))))) < 0.15


@pytest.mark.parametrize("bucket", [4000, 3])
def test_sketches_on_awkward_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", bucket)
    assert sketches.edited_likeness(awkward(spark)).count() == 11
    assert sketches.edited_likeness(empty(spark)).count() == 0
    one = sketches.edited_likeness(frame(spark, ["a b c d e f"])).first()
    assert one.near_next == 1.0


def test_merged_sketches(spark):
    texts = prose(12)
    s = sketches.document_sketches(frame(spark, texts)).selectExpr("*", "doc_id % 2 AS half")
    out = {r.key: sketches.decoded(r.fingerprint) for r in sketches.merged_sketches(s, ["half"]).collect()}
    for half in (0, 1):
        want = sketches.merge(*[sketches.sketch(t) for t in texts[half::2]])
        assert (out['{"half":%d}' % half] == want).all()
