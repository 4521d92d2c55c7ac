"""Language, quality, personal data, and the pipeline."""

from __future__ import annotations

import re

import numpy as np
import pytest

from reelgrid.llm import language, pii, quality, registry
from tests.llm.helpers import awkward, empty, frame, prose

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        c = language.codewords(n)
        assert c.shape[0] == n and len({tuple(r) for r in c.tolist()}) == n
        if n > 2:
            apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
            assert apart >= (2 if n < 9 else c.shape[1] // 5)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = registry.QUERIES["op10_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_awkward_rows(spark):
    model = language.learn(awkward(spark))
    out = language.identify(awkward(spark), model).collect()
    assert len(out) == 11
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2) or (r.doc_id is None and r.score == 0)) for r in out)
    assert language.identify(empty(spark), model).count() == 0
    none = language.learn(empty(spark))
    assert {r.lang_pred for r in language.identify(awkward(spark), none).collect()} == {"und"}
    assert language.keep_identified(awkward(spark), none).count() == 11
    one = language.learn(frame(spark, prose(5)))
    assert {r.lang_pred for r in language.identify(frame(spark, prose(3)), one).collect()} == {"en"}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.QUERIES["op9_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 40 and right >= 0.95 * len(rows)


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_quality_on_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(awkward(spark), labels)
    rows = quality.score(awkward(spark), model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.score(empty(spark), model).count() == 0
    untrained = quality.learn(awkward(spark), labels.where("doc_id > 99"))
    assert {r.score for r in quality.score(awkward(spark), untrained).collect()} == {0.5}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    import random

    rng = random.Random(9)
    parts = ["a@b.c", "x.y+z@host-1.example.org", "@@", "a@b", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111-1111", "+1 (706) 555-3138", "+49", " ", "  ", "-", "12345", "_", "é", "a@b.c_d@e.f", "001.02.3.0004"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(t) == plain_base(t), t


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    sym = lambda a: (a + a.T) / 2
    model = pii.FieldModel(np.zeros((pii.FEATURES, k)), sym(rng.normal(size=(k, k))), sym(rng.normal(size=(k, k))))
    pot = rng.normal(size=(4, k))
    chain, skip = np.array([(0, 1), (1, 2)]), np.array([(0, 3)])
    full = np.zeros((k,) * 4)
    for y in np.ndindex(*full.shape):
        full[y] = np.exp(sum(pot[i, y[i]] for i in range(4)) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]] + model.skip[y[0], y[3]])
    full /= full.sum()
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    got = pii.marginals(model, pot, chain, skip)
    pii.ROUNDS = rounds
    for i in range(4):
        assert np.allclose(got[i], full.sum(axis=tuple(j for j in range(4) if j != i)), atol=1e-6)


def chain_by_elimination(model, pot, links):
    """Marginals of a plain chain, forward and backward."""
    fore, back = pot.copy(), np.zeros_like(pot)
    for i, j in links:
        fore[j] += np.logaddexp.reduce(fore[i][:, None] + model.skip, axis=0)
    for i, j in reversed(links):
        back[i] = np.logaddexp.reduce((pot[j] + back[j])[None] + model.skip, axis=1)
    p = fore + back
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_a_number_repeated_forty_times_is_settled():
    k = len(pii.LABELS)
    model = pii.FieldModel(np.zeros((pii.FEATURES, k)), np.zeros((k, k)), np.diag([4.0, 6, 6, 6, 6]))
    pot = np.tile([1.0, 0, 0, 0, 0.5], (41, 1))
    pot[0] = [pii.NEVER] * 4 + [0]
    links = [(i, i + 1) for i in range(40)]
    want = chain_by_elimination(model, pot, links)
    assert (want[1:, 4] > 0.95).sum() > 20
    got = pii.marginals(model, pot, np.zeros((0, 2), np.int64), np.array(links))
    assert np.allclose(got, want, atol=1e-6)
    swing = pii.FieldModel(model.node, np.zeros((k, k)), -6.0 * np.ones((k, k)) * np.eye(k))
    three = np.array([(0, 1), (1, 2), (0, 2)])
    assert np.isfinite(pii.marginals(swing, pot[1:4], np.zeros((0, 2), np.int64), three)).all()


def test_the_sample_of_tokens_draws_places_not_shapes(spark, monkeypatch):
    texts = [" ".join(f"{i}{j:02d} x" for j in range(40)) + " 12:30" for i in range(1, 30)]
    seen = {}
    monkeypatch.setattr(pii, "fit", lambda x, chain, skip, y: seen.update(x=x))
    pii.learn(frame(spark, texts), sample_tokens=300)
    assert len(seen["x"]) == 300 and len(np.unique(seen["x"], axis=0)) == 2


def test_repeated_mentions_agree(spark):
    model = pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = "Call +1 (706) 555-3138 now. Much later he said 555-3138 twice."
    row = pii.find(frame(spark, [text]), model).first()
    assert row.base == "phone:5:22" and row.n_phone == 1
    assert set(row.base.split(",")) <= set(row.spans.split(","))
    assert "phone:47:55" in row.spans
    assert row.text == "Call <PHONE> now. Much later he said <PHONE> twice."


def test_personal_data_on_awkward_rows(spark):
    model = pii.learn(empty(spark))
    assert len(pii.find(awkward(spark), model).collect()) == 11
    assert pii.find(empty(spark), model).count() == 0
    out = pii.redacted(frame(spark, ["mail a@b.org now", None]), model, length_col="n_chars")
    assert {(r.text, r.n_chars) for r in out.collect()} == {("mail <EMAIL> now", 16), (None, None)}
    assert pii.redact("abcdef", [(0, 1, 3), (2, 2, 5)]) == "a<EMAIL>f"


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet").limit(400), []
    docs.write.parquet(f"file://{tmp_path_factory.mktemp('p')}/d")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        path = f"file://{tmp_path_factory.mktemp(name)}/t"
        after.write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns_and_act(staged):
    assert [n for n, *_ in staged] == ["language_id", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns
        assert after.join(before.select("doc_id"), "doc_id", "left_semi").count() == after.count()
    copies = staged[1][2]
    assert copies.selectExpr("regexp_replace(text, '[ \t-\r]', '') AS t").distinct().count() == copies.count()
    redacted = staged[3][2].collect()
    assert not any(plain_base(r.text)[:1] and plain_base(r.text)[0][0] == 0 for r in redacted)
    assert all(r.n_chars == len(r.text) for r in redacted)
    packed = staged[4]
    assert packed[2].select("doc_id").distinct().count() == packed[1].count()
