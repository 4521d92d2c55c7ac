"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    """The mapped value, else ``default``, else null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def get_or(m: Column, key: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def inverted(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def at_least(m: Column, least: float) -> Column:
    return F.map_filter(m, lambda _, v: v >= least)


def pooled(m: Column, keys: list[str]) -> Column:
    """Sum of some classes, absent ones counting zero."""
    return sum((get_or(m, k, 0.0) for k in keys), F.lit(0.0))


def multi_hot(joined: Column, labels: list[str]) -> Column:
    """One flag a label for a text of labels joined by underscores."""
    parts = F.split(joined, "_")
    return F.array(*[F.array_contains(parts, x).cast("int") for x in labels])


def binarised(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def argmax(v: Column, labels: list[str]) -> Column:
    """The label of the greatest value, the first on ties; null for an empty array."""
    return F.try_element_at(F.array(*map(F.lit, labels)), F.array_position(v, F.array_max(v)).cast("int"))


def expected_class(p: Column) -> Column:
    """Sum of probability times class number, classes counted from one."""
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(1), F.size(p)), lambda x, k: x.cast("double") * k), F.lit(0.0), lambda a, x: a + x)


def padded_array(v: Column, length: int, value: float) -> Column:
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def distinct_first(v: Column) -> Column:
    return F.array_distinct(v)
