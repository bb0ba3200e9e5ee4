"""Keyed upserts to current rows and to changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """The last row of each key by ``order`` (a partial aggregation, no sort), deleted keys left out."""
    names = [c for c in df.columns if c not in keys]
    mark = deleted if deleted is not None else F.lit(False)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names, F.coalesce(mark, F.lit(False)).alias("_deleted")), F.struct(order, *[c for c in names if not dict(df.dtypes)[c].startswith(("map", "variant"))])).alias("_r"))
    return best.filter(~F.col("_r._deleted")).select(*keys, *[F.col("_r")[c].alias(c) for c in names]).select(*df.columns)


def consolidate(changes: DataFrame, weight: str = "_weight") -> DataFrame:
    """Sum the weights of equal rows and drop what cancels out."""
    names = [c for c in changes.columns if c != weight]
    return changes.groupBy(*names).agg(F.sum(weight).cast("int").alias(weight)).filter(F.col(weight) != 0)


def differences(old: DataFrame, new: DataFrame, weight: str = "_weight") -> DataFrame:
    """The weighted changes that turn ``old`` into ``new``; equal rows give none."""
    return consolidate(new.withColumn(weight, F.lit(1)).unionByName(old.withColumn(weight, F.lit(-1))), weight)
