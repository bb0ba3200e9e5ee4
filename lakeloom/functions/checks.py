"""Data checks: values pass through, failures are counted per run and listed in a side table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Checks:
    """Collects conditions to watch on one DataFrame.

    ``value`` and ``true`` give the column to select; ``watch`` attaches one observation that
    counts the failures of all conditions in the same pass; ``violations`` lists them.
    """

    def __init__(self) -> None:
        self.rules: list[tuple[str, Column, str, dict[str, Column]]] = []

    def value(self, x: Column, condition: Column, message: str, **tags: Column) -> Column:
        self.rules.append((f"check_{len(self.rules)}", condition, message, tags))
        return x

    def true(self, condition: Column, message: str, **tags: Column) -> Column:
        self.rules.append((f"check_{len(self.rules)}", condition, message, tags))
        return condition

    def watch(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """``df`` with an observation of the number of failures per rule; null counts as failed."""
        seen = Observation("checks")
        counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c, _, _ in self.rules]
        return df.observe(seen, *counts), seen

    def violations(self, df: DataFrame) -> DataFrame:
        """check, message (tags in {braces} filled in) and tags of every failure."""
        each = []
        for name, condition, message, tags in self.rules:
            parts = [F.coalesce(tags[p[1:-1]].cast("string"), F.lit("null")) if p[1:-1] in tags and p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", message) if p]
            named = F.map_from_arrays(F.array(*[F.lit(k) for k in tags]), F.array(*[v.cast("string") for v in tags.values()])) if tags else F.create_map().cast("map<string,string>")
            each.append(F.when(~F.coalesce(condition, F.lit(False)), F.struct(F.lit(name).alias("check"), F.concat(*parts).alias("message"), named.alias("tags"))))
        failed = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))
        return df.select(failed.alias("_f")).select("_f.*")
