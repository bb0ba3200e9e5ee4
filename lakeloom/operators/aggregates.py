"""Aggregate functions with defined orders and empty values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.lists import union_distinct as list_union_distinct  # noqa: F401


def filtered(x: Column, condition: Column | None) -> Column:
    """The measure's input where its FILTER holds, else null (which all aggregates skip)."""
    return x if condition is None else F.when(condition, x)


def sum0(x: Column) -> Column:
    """Sum, 0 without values."""
    return F.coalesce(F.sum(x), F.lit(0))


def count_star(condition: Column | None = None) -> Column:
    return F.count("*") if condition is None else F.count_if(condition)


def list_agg(x: Column) -> Column:
    """All values, copies too, in ascending order."""
    return F.array_sort(F.collect_list(x))


def string_agg(x: Column, separator: str) -> Column:
    """Values in ascending order; null without values."""
    return F.when(F.count(x) > 0, F.array_join(F.array_sort(F.collect_list(x.cast("string"))), separator))


def min_by(x: Column, y: Column, *ties: Column) -> Column:
    """x where y is least; ties go to the least of ``ties``, else of x. Null y is skipped."""
    return F.min_by(x, F.when(y.isNotNull(), F.struct(y, *(ties or (x,)))))


def max_by(x: Column, y: Column) -> Column:
    """x where y is greatest; ties go to the greatest x."""
    return F.max_by(x, F.when(y.isNotNull(), F.struct(y, x)))


def surrogate_keys(df: DataFrame, keys: list[str], column: str = "surrogate_key", known: DataFrame | None = None) -> DataFrame:
    """Number each distinct key; keys in ``known`` keep their number, new ones follow.

    New numbers come from per-bucket counts and offsets, so no task sorts all keys. Stable for
    the same input; a persisted ``known`` table keeps them stable across runs.
    """
    fresh = df.select(*keys).distinct()
    start = F.lit(0).cast("bigint")
    if known is not None:
        fresh = fresh.join(known, keys, "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max(column), F.lit(-1))).first()[0] + 1)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1024))
    fresh = fresh.withColumn("_b", bucket)
    offsets = fresh.groupBy("_b").count()
    offsets = offsets.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_o"))  # 1024 rows
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    fresh = fresh.withColumn("_r", own).join(F.broadcast(offsets), "_b").select(*keys, (start + F.col("_o") + F.col("_r")).cast("bigint").alias(column))
    return fresh if known is None else known.select(*keys, column).unionByName(fresh)
