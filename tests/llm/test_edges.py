"""Contracts and bounds: letters, long numbers, models against plain code, SQL of the operators, stages on awkward rows, growth."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from reelgrid.llm import language, neardup, packing, pii, quality, registry, sketches
from reelgrid.llm.common import in_sample
from tests.llm.helpers import awkward, empty, frame, prose

SF = "/root/testdata/sf0.01"


def test_letters_are_of_category_l(spark):
    assert not any(map(language.has_letter, ["²", "½", "Ⅷ", "①", "3 _ 4", "", None, "٣"]))
    assert all(map(language.has_letter, ["a", "1é", "日", "ª", "½x"]))
    model = language.learn(frame(spark, prose(8), langs=["en", "de"] * 4))
    texts = ["² ½", "Ⅷ ①", "é"]
    assert [r.lang_pred == "und" for r in sorted(language.identify(frame(spark, texts), model).collect())] == [True, True, False]


def test_numbers_of_any_length():
    zeros = "0" * 5000
    for place in range(4):
        parts = ["1"] * 4
        parts[place] = zeros
        assert pii.base_spans(".".join(parts)) == [(1, 0, 5006)]
        parts[place] = zeros + "255"
        assert len(pii.base_spans(".".join(parts))) == 1
        for bad in (zeros + "256", "1" + zeros, "9" * 6000):
            parts[place] = bad
            assert pii.base_spans(".".join(parts)) == []


def test_tokens_see_every_span_they_touch():
    base = [(2, 0, 1), (2, 2, 3), (2, 4, 5), (2, 6, 7), (2, 8, 9), (0, 10, 30)]
    assert pii.tokens("1 2 3 4 5 mail-me@example.org-now", base).labels[-1] == 1


def test_scores_are_sums_of_looked_up_bins(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality.score(docs, model).collect()[::7]:
        x = quality.features(texts[r.doc_id] or "")
        total = model.base
        for j, v in enumerate(x):
            total += model.tables[j][sum(c <= v for c in model.cuts[j])]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(c <= x[a] for c in model.coarse[a])][sum(c <= x[b] for c in model.coarse[b])]
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_the_language_has_the_least_loss_of_all_codewords(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in language.identify(docs, model).collect()[::9]:
        if not language.has_letter(texts[r.doc_id]):
            assert r.lang_pred == "und"
            continue
        margins = language.ngram_counts([texts[r.doc_id]])[0].astype(np.float64) @ model.weights + model.bias
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, code, strict=True)) for code in model.codes]
        assert model.languages[int(np.argmin(losses))] == r.lang_pred
        shares = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert r.score == pytest.approx(shares.max(), abs=1e-4)


def test_samples_keep_their_bound(spark, monkeypatch):
    many = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert 120 < many.where(in_sample("doc_id", 1e-3)).count() < 290
    assert many.where(in_sample("doc_id", 1.0)).count() == 200_000
    # One id on every row: the draw is all or nothing, the bound holds.
    seen = {}
    monkeypatch.setattr(language, "fit", lambda v, labels: seen.update(n=len(labels)))
    for i in range(3):
        language.learn(frame(spark, prose(60), ids=[i] * 60), rows_per_language=5)
        assert seen["n"] in (0, 10)
    with pytest.raises(ValueError):
        language.learn(frame(spark, prose(4), langs=list("abcd")), most_languages=3)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_of_the_operators(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_repeated_rows_part_in_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    out = packing.pack(frame(spark, ["one two three"] * 300, ids=[None] * 300)).collect()
    groups = [r.sequence_id >> 32 for r in out]
    assert len(out) == 300 and max(groups.count(g) for g in set(groups)) < 60


def saved(df, tmp_path, name):
    df.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    return f"file://{tmp_path}/{name}"


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    # Two languages to learn from, every stage with a fitted model.
    rng = random.Random(3)
    other = [" ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(40)) for _ in range(30)]
    known = frame(spark, [*prose(30), *other, "mail a@b.org or 10.0.0.1 now", "call +1 (706) 555-3138"], ids=list(range(100, 162)), langs=["en"] * 30 + ["de"] * 30 + ["en"] * 2)
    for docs in (known.union(awkward(spark)), awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            kept = after.collect()
            docs = spark.createDataFrame(kept, docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(r.start == 0 for r in last) == len(kept)
    for name, docs in (("awkward", known.union(awkward(spark))), ("empty", empty(spark))):
        packed = corpus_pipeline.run(spark, saved(docs, tmp_path, name)).collect()
        assert (len(packed) > 50) == (name == "awkward")


def edited(base, rng, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(len(w))] = "".join(rng.choice("klmnop") for _ in range(5))
        out.append(" ".join(w))
    return out


def test_a_group_costs_about_its_size(spark, monkeypatch):
    """Pairs of every step over one group of near copies, half of them below the threshold: no step grows with the square."""
    counts = {}
    real = neardup.written

    def counted(df, label, outer=False):
        out = real(df, label, outer)
        if label in ("stars", "pairs", "near", "links"):
            counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "written", counted)
    rng = random.Random(6)
    base = prose(1, seed=9, size=160)[0]
    texts, seen = edited(base, rng, 800, 3), {}
    for n in (200, 800):
        counts.clear()
        df = spark.createDataFrame(list(enumerate(texts[:n])), "uid long, text string")
        roots = {r.root for r in neardup.near_groups(df).collect()}
        assert len(roots) < 0.5 * n
        seen[n] = dict(counts)
    # Four times the nodes: at most the nodes times their keys, and far from the square, which is sixteen times.
    assert seen[800]["stars"] <= 16 * 800
    for label in seen[200]:
        assert seen[800][label] <= 8 * max(200, seen[200][label]), seen


def test_near_groups_of_the_documents_against_all_links(spark):
    """Every link of the documents of sf0.01, found by shared rare shingles without loss, lies inside a group."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: set(sketches.shingles(t).tolist()) for i, t in rows}
    count, held = {}, {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    links = 0
    out = {r.uid: r.root for r in neardup.near_groups(spark.createDataFrame(rows, "uid long, text string")).collect()}
    missed = 0
    for i, s in sets.items():
        least = sorted(s, key=lambda x: (count[x], x))[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1]
        for j in {j for x in least for j in held.get(x, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links, missed = links + 1, missed + (out[i] != out[j])
        for x in least:
            held.setdefault(x, []).append(i)
    assert links > 50 and missed <= 0.01 * links
