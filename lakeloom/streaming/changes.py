"""Weighted change-logs: rows with _weight, positive for inserts and negative for deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.normalize import consolidate, differences  # noqa: F401

WEIGHT = "_weight"


def apply(snapshot: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The rows after the changes; copies stay copies."""
    weighted = changes if snapshot is None else snapshot.withColumn(WEIGHT, F.lit(1)).unionByName(changes)
    left = consolidate(weighted).filter(F.col(WEIGHT) > 0)
    return left.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col(WEIGHT)))).drop("_n", WEIGHT)


def weighted_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of weighted rows; weights multiply."""
    a, b = left.withColumnRenamed(WEIGHT, "_wl"), right.withColumnRenamed(WEIGHT, "_wr")
    return a.join(b, keys).withColumn(WEIGHT, F.col("_wl") * F.col("_wr")).drop("_wl", "_wr")


def join_delta(left: DataFrame, left_changes: DataFrame, right: DataFrame, right_changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of an inner join: both snapshots are from before the changes."""
    one = lambda df: df.withColumn(WEIGHT, F.lit(1))
    parts = weighted_join(left_changes, one(right), keys).unionByName(weighted_join(one(left), right_changes, keys)).unionByName(weighted_join(left_changes, right_changes, keys))
    return consolidate(parts)


def upserts_to_changes(current: DataFrame | None, updates: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """Changes that keyed updates make; rows that stay equal give none.

    ``updates`` has at most one row per key; ``deleted`` names a boolean column that is dropped.
    """
    kept = updates.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else updates
    if current is None:
        return kept.withColumn(WEIGHT, F.lit(1))
    return differences(current.join(updates.select(*keys).distinct(), keys, "left_semi"), kept)
