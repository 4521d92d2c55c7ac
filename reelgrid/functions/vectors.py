"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """``f(value)``, the value computed once: inside a lambda an expression of a column is computed again for each element."""
    return F.transform(F.array(value), f)[0]


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either side is null."""
    pairs = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null or has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(v: Column) -> Column:
    return bound(norm(v), lambda n: F.transform(as_double(v), lambda x: F.try_divide(x, n)))


def l1_normalise(v: Column) -> Column:
    """Shares of the total; null where the total is zero."""
    total = F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x)
    return bound(total, lambda t: F.when(t != 0, F.transform(as_double(v), lambda x: x / t)))


def softmax(v: Column) -> Column:
    def shares(e):
        return bound(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total))

    return bound(bound(F.array_max(as_double(v)), lambda top: F.transform(as_double(v), lambda x: F.exp(x - top))), shares)
