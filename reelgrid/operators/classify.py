"""Tree ensembles over feature vectors: fitted on labelled turns, applied to all, put to the vote."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_ensemble(labelled: DataFrame, features: str, label: str, kind: str = "forest", trees: int = 20, depth: int = 6, seed: int = 1):
    """A fitted classifier of ``label`` (0, 1, ...) from an array column, fitted on every labelled row.

    ``kind`` is "forest", "boosted" (one boosted ensemble a class) or "tree".
    Rows with a null label or feature array are left out.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    rows = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    if kind == "forest":
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    elif kind == "boosted":
        model = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed))
    elif kind == "tree":
        model = DecisionTreeClassifier(maxDepth=depth, seed=seed)
    else:
        raise ValueError(kind)
    return model.fit(rows)


def ensemble_votes(df: DataFrame, models: list, by: list[str]) -> DataFrame:
    """(by, model, label): the label of each of ``models``, pairs of a feature column and a fitted classifier, numbered from 0."""
    votes = None
    for i, (features, model) in enumerate(models):
        rows = df.select(*by, array_to_vector(F.col(features).cast("array<double>")).alias("features"))
        one = model.transform(rows).select(*by, F.lit(i).alias("model"), F.col("prediction").cast("int").alias("label"))
        votes = one if votes is None else votes.unionByName(one)
    return votes
