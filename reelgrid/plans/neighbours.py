"""Similarity of each shot to its neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid.functions.vectors import cosine
from reelgrid.plans.registry import query, table


def neighbour_similarity(shots, n=2, by="video_id", order="idx", vec="embedding"):
    """Cosine of each row with its k-th neighbours, k = 1..n; 0 at the edges."""
    w = Window.partitionBy(by).orderBy(order)
    cols = []
    for k in range(1, n + 1):
        for name, other in ((f"prev_{k}", F.lag(vec, k)), (f"next_{k}", F.lead(vec, k))):
            cols.append(F.coalesce(cosine(F.col(vec), other.over(w)), F.lit(0.0)).alias(name))
    return shots.select(by, order, *cols)


@query(
    "neighbour_similarity",
    """
    WITH s AS (SELECT label AS video_id, vec_id AS idx, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT *, lag(e, 1) OVER w AS p1, lead(e, 1) OVER w AS n1, lag(e, 2) OVER w AS p2, lead(e, 2) OVER w AS n2
          FROM s WINDOW w AS (PARTITION BY video_id ORDER BY idx))
    SELECT video_id, idx,
           round(coalesce(list_cosine_similarity(e, p1), 0), 6) AS prev_1,
           round(coalesce(list_cosine_similarity(e, n1), 0), 6) AS next_1,
           round(coalesce(list_cosine_similarity(e, p2), 0), 6) AS prev_2,
           round(coalesce(list_cosine_similarity(e, n2), 0), 6) AS next_2
    FROM n
    """,
)
def q_neighbour_similarity(spark, sf):
    shots = table(spark, sf, "embeddings").selectExpr("label AS video_id", "vec_id AS idx", "embedding")
    out = neighbour_similarity(shots)
    return out.select("video_id", "idx", *[F.round(c, 6).alias(c) for c in out.columns[2:]])
