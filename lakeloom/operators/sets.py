"""Set operations, distinct and top-N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def combine(kind: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """union_all, union_distinct, except_all, except_distinct, intersect_all or intersect_distinct.

    EXCEPT subtracts all others from the first; INTERSECT keeps what all have.
    """
    steps = {
        "union_all": lambda a, b: a.union(b),
        "union_distinct": lambda a, b: a.union(b),
        "except_all": lambda a, b: a.exceptAll(b),
        "except_distinct": lambda a, b: a.subtract(b),
        "intersect_all": lambda a, b: a.intersectAll(b),
        "intersect_distinct": lambda a, b: a.intersect(b),
    }
    out = reduce(steps[kind], others, first)
    return out.distinct() if kind == "union_distinct" or (not others and kind.endswith("distinct")) else out


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; ties are broken by all columns in turn, so the result is defined."""
    if not order:
        raise ValueError("top_n needs an order")
    return df.orderBy(*order, *[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]).limit(n)


def fetch(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """LIMIT, only with an order."""
    return top_n(df, n, *order)
