"""Entity linking and typing over offline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import word_count


def link_mentions(mentions: DataFrame, candidates: DataFrame, search: DataFrame, search_on: Column, by: list[str], within: list[str], slack: int = 2, least_rank: float = 1e-4) -> DataFrame:
    """Mentions with wd_id and disambiguation.

    A candidate fits a mention of the same ``within`` if its characters lie in
    the mention's, give or take ``slack``; the greatest page rank wins, the
    first on ties. Without one the search table's first hit counts, else the
    mention is ``unk``. Mentions of one character, or of a type other than
    PER, ORG, LOC and MISC, go. Mentions and candidates join on ``within``, the
    text they stand in, each span of characters once.
    """
    m = mentions.where((F.length("text") >= 2) & F.col("type").isin("PER", "ORG", "LOC", "MISC"))
    c = candidates.where(F.col("page_rank") >= least_rank)
    fits = (F.col("ch_from") >= F.col("start") - slack) & (F.col("ch_to") <= F.col("end") + slack)
    rank = F.struct("page_rank", -F.col("seq"))
    top = F.max_by(F.struct("qid", "page_rank", "seq"), rank).alias("_c")
    span = [*within, "start", "end"]
    # Of candidates on the same characters only the best can win, and mentions on the same characters have one winner.
    alone = c.groupBy(*within, "ch_from", "ch_to").agg(top).select(*within, "ch_from", "ch_to", "_c.*")
    winners = m.select(*span).distinct().join(alone, within).where(fits).groupBy(*span).agg(top).select(*span, "_c.*")
    best = m.join(winners, span).groupBy(*by).agg(F.max_by("qid", rank).alias("qid"))
    out = m.join(best, by, "left").join(search, search_on, "left")
    return out.withColumn("wd_id", F.coalesce("qid", "search_id", F.lit("unk"))).withColumn(
        "disambiguation", F.when(F.col("qid").isNotNull(), "wikifier").when(F.col("search_id").isNotNull(), "search").otherwise("unk")
    )


def search_entities(texts: DataFrame, text: str, gazetteer: DataFrame, lang: str, limit: int = 1) -> DataFrame:
    """Each distinct text with the ``limit`` best entries of a gazetteer that bear it as a label or alias in ``lang``.

    gazetteer(qid, lang, label, aliases array<string>, rank). Case and outer
    blanks don't matter; the greatest rank comes first, then the least qid. An
    entry that bears a text twice is one hit. Texts without a hit have no row;
    null texts neither. Both sides meet by equality, so the gazetteer may be
    larger than memory.
    """
    key = lambda c: F.lower(F.trim(c))
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    entries = gazetteer.where(F.col("lang") == lang).select("qid", "rank", F.explode(F.array_distinct(F.transform(names, key))).alias("_key"))
    asked = texts.select(text).distinct().withColumn("_key", key(F.col(text)))
    place = F.row_number().over(Window.partitionBy(text).orderBy(F.col("rank").desc(), "qid"))
    return asked.join(entries, "_key").withColumn("hit", place).where(F.col("hit") <= limit).select(text, "hit", "qid")


def first_rule(bindings: DataFrame, entity: str, seq: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """(entity, rule_type): over bindings in order, the first rule in order that holds."""
    number = F.lit(None).cast("int")
    for i, (cond, _) in reversed(list(enumerate(rules))):
        number = F.when(cond, i).otherwise(number)
    kinds = F.array(*[F.lit(name) for _, name in rules])
    hit = bindings.withColumn("_rule", number).where(F.col("_rule").isNotNull())
    return hit.groupBy(entity).agg(F.get(kinds, F.min_by("_rule", seq)).alias("rule_type"))


def person_type(label: Column, disambiguation: Column) -> Column:
    """EPER for a linked full name, LPER for a single name or an unlinked one."""
    return F.when((word_count(label) > 1) & (disambiguation != "unk"), "EPER").otherwise("LPER")


def fixed_type(linked_type: Column, original: Column, label: Column, disambiguation: Column) -> Column:
    """The binding's type, else by the mention's: persons by their name, unlinked others are MISC."""
    return (
        F.when(linked_type.isNotNull(), linked_type)
        .when(original == "PER", person_type(label, disambiguation))
        .when(disambiguation == "unk", "MISC")
        .otherwise(original)
    )


def transitive_subclasses(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """Distinct (root, sub) reached in 1..``hops`` steps of edge (sub, super)."""
    level = roots.join(edges, roots["root"] == edges["super"]).select("root", "sub")
    out = level
    for _ in range(hops - 1):
        e = edges.select(F.col("sub").alias("next"), "super")
        level = level.join(e, F.col("sub") == F.col("super")).select("root", F.col("next").alias("sub")).distinct()
        out = out.union(level)
    return out.distinct()


def entity_facts(entities: DataFrame, triples: DataFrame, properties: dict[str, str]) -> DataFrame:
    """Entities with one column a property, null where a triple is absent; one pass over the triples."""
    wide = triples.groupBy("subject").agg(*[F.min(F.when(F.col("property") == p, F.col("object"))).alias(name) for name, p in properties.items()])
    return entities.join(wide, F.col("entity") == F.col("subject"), "left").drop("subject")


def first_seen(df: DataFrame, label: str, value: str, seq: list[str], by: list[str]) -> DataFrame:
    """The first value of each label in order, within ``by``."""
    return df.groupBy(*by, label).agg(F.min_by(value, F.struct(*seq)).alias(value))
