"""Entities named in whole texts, weighted by how well they fit together.

A text and a name are sequences of words, runs of letters and digits in lower
case; a name stands wherever its words follow one another, whatever is between
them, also inside a longer name. Names are looked up by an Aho-Corasick
automaton in each task while the distinct ones are few; a larger gazetteer
meets the texts' word sequences in a shuffled join, with the same result.

The entities that a text may name are ranked by page rank over their links:
the surfer starts at the text's names, each as often as it stands there, takes
one of its entities by their prior weight, and follows the links among the
text's entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.sources.staging import written

#: What lies between two words, and a word.
WORD = r"([^\p{L}\p{N}]*)([\p{L}\p{N}]+)"

#: Characters of all distinct names up to which tasks hold them in an automaton.
AUTOMATON = 4_000_000


def _words(text):
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(2)), F.lower)


def named_entities(gazetteer: DataFrame, max_entropy: float | None = None) -> DataFrame:
    """(name, qid, prior): each name's entities and their shares of the name's weight.

    gazetteer(qid, label, aliases array<string>, weight). A name that one entity
    bears twice counts once; names without a word go. Weights of null or below
    zero are zero, and a name whose weights are all zero is shared alike.
    ``max_entropy`` drops names whose shares hold more bits than that.
    """
    every = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = gazetteer.where("qid IS NOT NULL").select("qid", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.explode(every).alias("text"))
    each = names.select("qid", "weight", F.array_join(_words(F.col("text")), " ").alias("name")).where("name <> ''").groupBy("name", "qid").agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("name")
    share = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(w)), 1 / F.count(F.lit(1)).over(w))
    out = each.withColumn("prior", share).drop("weight")
    if max_entropy is not None:
        bits = F.sum(F.when(F.col("prior") > 0, -F.col("prior") * F.log2("prior")).otherwise(0.0)).over(w)
        out = out.withColumn("_bits", bits).where(F.col("_bits") <= max_entropy).drop("_bits")
    return out


def _spans_by_automaton(texts: DataFrame, names: list[str], kind: str) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name in held.value:
            # Blanks around a name and around the text keep matches to whole words.
            found.add_word(f" {name} ", name)
        found.make_automaton()
        for batch in batches:
            ids, starts, ends, hits = [], [], [], []
            for key, words, gaps, sizes in zip(*(batch[c].to_pylist() for c in ("id", "words", "gaps", "sizes")), strict=True):
                if not words:
                    continue
                last = np.cumsum(np.add(gaps, sizes))
                first = last - np.asarray(sizes)
                places = np.cumsum([1 + len(w) for w in words])
                line = f" {' '.join(words)} "
                for end, name in found.iter(line):
                    # ``end`` is the blank after the last word; the name's words are as many as its blanks and one.
                    at = int(np.searchsorted(places, end))
                    ids.append(key)
                    starts.append(int(first[at - name.count(" ")]))
                    ends.append(int(last[at]))
                    hits.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(hits, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "name", "start", "end"])

    return texts.mapInArrow(run, f"id {kind}, name string, start long, end long")


def _spans_by_join(texts: DataFrame, names: DataFrame) -> DataFrame:
    order = Window.partitionBy("row").orderBy("pos")
    words = texts.select("row", "id", F.posexplode(F.arrays_zip("words", "gaps", "sizes")).alias("pos", "w")).select("row", "id", "pos", "w.*")
    words = words.withColumn("last", F.sum(F.col("gaps") + F.col("sizes")).over(order)).withColumn("first", F.col("last") - F.col("sizes"))
    spans = None
    for n in sorted(r[0] for r in names.select(F.size(F.split("name", " "))).distinct().collect()):
        ahead = order.rowsBetween(0, n - 1)
        runs = words.select("id", F.collect_list("words").over(ahead).alias("run"), F.col("first").alias("start"), F.max("last").over(ahead).cast("long").alias("end"))
        hits = runs.where(F.size("run") == n).withColumn("name", F.array_join("run", " ")).join(names, "name").select("id", "name", F.col("start").cast("long").alias("start"), "end")
        spans = hits if spans is None else spans.unionByName(hits)
    return spans if spans is not None else texts.select("id", F.lit("").alias("name"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).limit(0)


def name_spans(texts: DataFrame, id: str, text: str, names: DataFrame, automaton: int = AUTOMATON) -> DataFrame:
    """(id, name, start, end): every place of every name(name) in whole texts; code points, end exclusive.

    Null and empty texts have none. ``automaton`` bounds the characters of the
    names that the driver and the tasks hold; beyond it they are joined.
    """
    pieces = lambda i: F.regexp_extract_all(text, F.lit(WORD), F.lit(i))
    long = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Texts are dealt out first: a file may hold all of them in one row group, which is one task.
    dealt = texts.where(F.col(text).isNotNull()).select(id, text).repartition(parts)
    split = dealt.select(F.col(id).alias("id"), _words(F.col(text)).alias("words"), long(pieces(1)).alias("gaps"), long(pieces(2)).alias("sizes"))
    each = written(names.select("name").distinct(), "names")
    size = each.agg(F.sum(F.length("name") + 2)).first()[0]
    if size is not None and size <= automaton:
        spans = _spans_by_automaton(split, [r.name for r in each.collect()], texts.schema[id].dataType.simpleString())
    else:
        spans = _spans_by_join(written(split.withColumn("row", F.monotonically_increasing_id()), "words"), each)
    return spans.withColumnRenamed("id", id)


def fitting_ranks(starts: DataFrame, links: DataFrame, id: str, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, qid, page_rank): page rank of each text's entities over links(src, dst) among them.

    starts(id, qid, start) is where the surfer starts, in any scale; a text's ranks
    add up to one. Who stands at an entity without links in the text starts
    anew. A text's entities and the links among them are one group.
    """
    own = written(starts.where(F.col(id).isNotNull() & (F.col("start") > 0)).groupBy(F.col(id).alias("id"), "qid").agg(F.sum("start").alias("start")), "starts")
    edges = links.where("src <> dst").select("src", "dst").distinct()
    inside = own.select("id", F.col("qid").alias("src")).join(edges, "src").join(own.select("id", F.col("qid").alias("dst")), ["id", "dst"]).select(F.col("id").alias("text"), "src", "dst")
    schema = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("id", "qid")) + ", page_rank double"

    def rank(nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("qid", ignore_index=True)
        at = pd.Index(nodes["qid"])
        n, begin = len(at), nodes["start"].to_numpy() / nodes["start"].sum()
        arcs = arcs.sort_values(["src", "dst"])
        a, b = at.get_indexer(arcs["src"]), at.get_indexer(arcs["dst"])
        out = np.bincount(a, minlength=n)
        now = begin
        for _ in range(rounds):
            moved = np.bincount(b, weights=now[a] / out[a], minlength=n) if len(a) else np.zeros(n)
            now = (1 - damping) * begin + damping * (moved + now[out == 0].sum() * begin)
        return nodes[["id", "qid"]].assign(page_rank=now)

    # A text costs far more than its bytes, by which small shuffles would be put into few tasks.
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.sparkSession.sparkContext.defaultParallelism)
    return own.repartition(parts, "id").groupBy("id").cogroup(inside.repartition(parts, "text").groupBy("text")).applyInPandas(rank, schema).withColumnRenamed("id", id)


def annotate(texts: DataFrame, id: str, text: str, gazetteer: DataFrame, links: DataFrame, max_entropy: float | None = 3.0, sq_share: float = 1.0, rounds: int = 10, damping: float = 0.85, automaton: int = AUTOMATON) -> DataFrame:
    """(id, start, end, name, qid, page_rank): the entities that each text may name, where, and their rank in the text.

    ``sq_share`` keeps a text's highest ranks until their squares add up to that
    share of all; of equal ranks the lesser qid is first. With 1 all stay. Rows
    of one id are one text for the ranks. The result is what ``link_mentions``
    takes as candidates.
    """
    entities = written(named_entities(gazetteer, max_entropy), "entities")
    spans = written(name_spans(texts, id, text, entities, automaton), "spans")
    often = spans.groupBy(id, "name").agg(F.count(F.lit(1)).alias("times"))
    starts = often.join(entities, "name").select(id, "qid", (F.col("times") * F.col("prior")).alias("start"))
    ranks = fitting_ranks(starts, links, id, rounds, damping)
    if sq_share < 1:
        w = Window.partitionBy(id)
        square = F.col("page_rank") * F.col("page_rank")
        before = F.coalesce(F.sum(square).over(w.orderBy(F.col("page_rank").desc(), "qid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ranks = ranks.withColumn("_b", before).withColumn("_t", F.sum(square).over(w)).where(F.col("_b") < sq_share * F.col("_t")).drop("_b", "_t")
    return spans.join(entities.select("name", "qid"), "name").join(ranks, [id, "qid"]).select(id, "start", "end", "name", "qid", "page_rank")
