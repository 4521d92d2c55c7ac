"""Names in texts and the ranks of their entities, against plain code."""

from __future__ import annotations

import math
import random
import re

import pytest

from reelgrid.operators.annotate import annotate, fitting_ranks, name_spans, named_entities

GAZETTEER = "qid string, label string, aliases array<string>, weight double"


def plain_spans(texts, names):
    out = []
    for key, text in texts:
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text or "")]
        for name in names:
            parts = name.split(" ")
            for i in range(len(words) - len(parts) + 1):
                if [w[2] for w in words[i : i + len(parts)]] == parts:
                    out.append((key, name, words[i][0], words[i + len(parts) - 1][1]))
    return sorted(out)


@pytest.mark.parametrize("automaton", [10**6, 0])
def test_spans_are_all_places_of_whole_words(spark, automaton):
    pick = random.Random(5)
    texts = [(i, "".join(pick.choice(["New", "york", "YORK", "É1", "a", "𝒳b"]) + pick.choice([" ", ", ", "\n\n", "-", "_"]) for _ in range(60))) for i in range(30)]
    texts += [(90, None), (91, ""), (92, "..."), (93, "newyork new"), (94, "New York"), (94, "New York"), (95, "new york " * 4000)]
    names = ["new", "new york", "york new york", "é1 a", "york", "absent"]
    got = name_spans(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), automaton)
    assert sorted((r.id, r.name, r.start, r.end) for r in got.collect()) == plain_spans(texts, names)


@pytest.mark.parametrize("automaton", [10**6, -1])
def test_no_names_and_no_texts(spark, automaton):
    texts, names = spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([("a",)], "name string")
    assert name_spans(texts, "id", "text", names.limit(0), automaton).count() == 0
    assert name_spans(texts.limit(0), "id", "text", names, automaton).count() == 0


def test_shares_of_names(spark):
    rows = [("Q1", "Paris", ["PARIS", "City of Light"], 3.0), ("Q2", "paris!", None, 1.0), ("Q3", "...", [None, "zero"], None), ("Q4", "zero", None, -2.0), (None, "paris", None, 9.0)]
    got = {(r.name, r.qid): r.prior for r in named_entities(spark.createDataFrame(rows, GAZETTEER)).collect()}
    assert got == {("paris", "Q1"): 0.75, ("paris", "Q2"): 0.25, ("city of light", "Q1"): 1.0, ("zero", "Q3"): 0.5, ("zero", "Q4"): 0.5}
    few = {r.name for r in named_entities(spark.createDataFrame(rows, GAZETTEER), 0.9).collect()}
    assert few == {"paris", "city of light"}


def test_ranks_follow_links_inside_the_text(spark):
    starts = [(1, "a", 2.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 1.0), (2, "d", 1.0), (None, "a", 1.0), (3, "a", 0.0)]
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("d", "z")]
    got = {(r.id, r.qid): r.page_rank for r in fitting_ranks(spark.createDataFrame(starts, "id int, qid string, start double"), spark.createDataFrame(links, "src string, dst string"), "id", 40).collect()}
    begin, now = {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.5, "b": 0.25, "c": 0.25}
    for _ in range(40):
        moved = {"a": 0.0, "b": now["a"] / 2, "c": now["a"] / 2 + now["b"]}
        now = {x: 0.15 * begin[x] + 0.85 * (moved[x] + now["c"] * begin[x]) for x in begin}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "d")}
    assert all(math.isclose(got[1, x], now[x]) for x in now) and math.isclose(got[2, "a"], 0.5)


def test_context_decides_between_two_of_one_name(spark):
    """The river of two entities named alike is linked to what else the text names, and ``link_mentions`` takes it."""
    from pyspark.sql import functions as F

    from reelgrid.operators.entities import link_mentions

    g = spark.createDataFrame([("Q1", "Amazon", None, 1.2), ("Q2", "Amazon", None, 1.0), ("Q3", "Manaus", None, 1.0)], GAZETTEER)
    links = spark.createDataFrame([("Q3", "Q2"), ("Q2", "Q3")], "src string, dst string")
    texts = spark.createDataFrame([(1, "Manaus lies on the Amazon."), (2, "The Amazon.")], "turn int, text string")
    found = annotate(texts, "turn", "text", g, links)
    m = spark.createDataFrame([(10, 1, 19, 25, "Amazon", "ORG"), (20, 2, 4, 10, "Amazon", "ORG")], "id int, turn int, start int, end int, text string, type string")
    candidates = found.select("turn", "qid", F.col("start").alias("ch_from"), F.col("end").alias("ch_to"), "page_rank", F.lit(0).alias("seq"))
    none = spark.createDataFrame([], "hit int, search_id string")
    assert {r.id: r.wd_id for r in link_mentions(m, candidates, none, F.col("id") == F.col("hit"), ["id"], ["turn"]).collect()} == {10: "Q2", 20: "Q1"}
    top = annotate(texts, "turn", "text", g, links, sq_share=0.3)
    assert {(r.turn, r.qid) for r in top.collect()} < {(r.turn, r.qid) for r in found.collect()}
