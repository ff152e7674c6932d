"""Functions of arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def first_other_than(items: Column, value: str) -> Column:
    """The first item that differs from ``value``, else the first; null for an empty array."""
    return F.coalesce(F.get(F.filter(items, lambda x: x != value), F.lit(0)), F.get(items, F.lit(0)))


def allowed(items: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(items, F.array(*[F.lit(v) for v in vocabulary]))


def highest_priority(members: Column, priority: list[str]) -> Column:
    """The first of ``priority`` that is a member."""
    order = F.array(*[F.lit(p) for p in priority])
    return F.get(F.filter(order, lambda p: F.array_contains(members, p)), F.lit(0))


def positive_entries(signals: Column) -> Column:
    return F.map_filter(signals, lambda _, v: v > 0)


def batch_number(row_number: Column, size: int) -> Column:
    """Number of the batch that a 1-based row falls into."""
    return F.floor((row_number - 1) / size).cast("int")


def looked_up(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small constant map; null for an unknown key."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key) if entries else F.lit(None).cast("string")


def zipped(keys: Column, values: Column) -> Column:
    """Pairs of two arrays by place; null if their lengths differ, so a whole batch is discarded."""
    return F.when(F.size(keys) == F.size(values), F.arrays_zip(keys.alias("key"), values.alias("value")))


def is_subset(items: Column, vocabulary: list[str]) -> Column:
    """Whether all items are known."""
    return F.size(F.array_except(items, F.array(*[F.lit(v) for v in vocabulary]))) == 0


def merged_in_order(first: Column, then: Column) -> Column:
    """Items of both arrays without repeats, those of the first in front."""
    return F.array_distinct(F.concat(first, then))
