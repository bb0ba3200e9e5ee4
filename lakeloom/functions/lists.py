"""List functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_asc_null_last(x: Column) -> Column:
    return F.array_sort(x)


def first_difference(a: Column, b: Column) -> Column:
    """The first element of ``a`` that differs from the one of ``b`` in its place.

    Null if there is none or ``a`` is null; the first element if ``b`` is null.
    """
    other = F.coalesce(b, F.array_repeat(F.element_at(a, 1), 0))
    place = F.sequence(F.lit(1), F.size(a))
    differs = F.filter(place, lambda i: (i > F.size(other)) | ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(other, i)))
    return F.when(F.size(a) > 0, F.try_element_at(a, F.try_element_at(differs, F.lit(1))))


def union_distinct(lists: Column) -> Column:
    """Sorted distinct elements of all lists of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))
