"""Window functions: ROWS frames by default, sessions by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import surrogate_keys


def window(partition: list, order: list | None = None, rows: tuple[int | None, int | None] | None = None) -> WindowSpec:
    """A window with a ROWS frame.

    With an order the default is all rows up to the current one (not its peers); without, the
    whole partition. In ``rows`` None is unbounded, negative precedes.
    """
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    if rows is None:
        rows = (None, 0) if order else (None, None)
    lo = Window.unboundedPreceding if rows[0] is None else rows[0]
    hi = Window.unboundedFollowing if rows[1] is None else rows[1]
    return spec.rowsBetween(lo, hi)


def last_value(x: Column, spec: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.last(x, ignore_nulls).over(spec)


def min_by(x: Column, y: Column, spec: WindowSpec, order: list[Column]) -> Column:
    """x of the first row, in window order, with the least y of the frame."""
    return F.min_by(x, F.when(y.isNotNull(), F.struct(y, *order))).over(spec)


def max_by(x: Column, y: Column, spec: WindowSpec, order_desc: list[Column]) -> Column:
    """x of the first row with the greatest y; ``order_desc`` must fall along the window order."""
    return F.max_by(x, F.when(y.isNotNull(), F.struct(y, *order_desc))).over(spec)


def sliding_by(df: DataFrame, partition: list[str], order: list, preceding: int, **columns: tuple[str, str, str]) -> DataFrame:
    """Add min_by / max_by of (kind, x, y) over the last ``preceding`` rows and the current one.

    x of the first row, in window order, with the least (greatest) y; null y is skipped. ``order``
    should be total. Rows are cut into blocks of the frame's length, so a frame is the end of one
    block and the start of the next: running values from both sides of each block give it, with a
    few steps a row however long the frame (a moving frame takes as many steps as it has rows).
    """
    n = preceding + 1
    whole = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(whole)).withColumn("_block", F.floor((F.col("_rn") - 1) / n))
    block = Window.partitionBy(*partition, "_block")
    ahead, back = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_rn"), F.desc("_rn")))
    by_row = Window.partitionBy(*partition).orderBy("_rn")
    best = {}
    for name, (kind, x, y) in columns.items():
        pick, both, sign = (F.min, F.least, 1) if kind == "min_by" else (F.max, F.greatest, -1)
        row = F.when(F.col(y).isNotNull(), F.struct(F.col(y).alias("y"), (sign * F.col("_rn")).alias("n"), F.col(x).alias("x")))
        out = out.withColumn(f"_a_{name}", pick(row).over(ahead)).withColumn(f"_b_{name}", pick(row).over(back))
        best[name] = both(F.col(f"_a_{name}"), F.lag(f"_b_{name}", preceding).over(by_row))["x"]
    return out.select(*df.columns, *[b.alias(name) for name, b in best.items()])


def surrogate_key(df: DataFrame, partition: list[str], column: str = "surrogate_key") -> DataFrame:
    """Add one number per partition key: 0 to n - 1, unique, without a sort of all keys in a task."""
    keys = surrogate_keys(df, partition, column)
    same = None
    for k in partition:
        both = df[k].eqNullSafe(F.col(f"_k_{k}"))
        same = both if same is None else same & both
    named = keys.select(*[F.col(k).alias(f"_k_{k}") for k in partition], column)
    return df.join(named, same).drop(*[f"_k_{k}" for k in partition])


def session_window(df: DataFrame, partition: list[str], ts: str, gap_seconds: float, column: str = "session_start") -> DataFrame:
    """Add the start of each row's session: a gap of more than ``gap_seconds`` begins a new one.

    A gap of just that length stays within. Rows without a time get null and end no session.
    """
    timed = Window.partitionBy(*partition).orderBy(F.col(ts).asc_nulls_first())
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    starts = F.when(F.col(ts).isNotNull(), F.coalesce(us - F.lag(us).over(timed) > int(gap_seconds * 10**6), F.lit(True)).cast("int"))
    out = df.withColumn("_new", starts)
    first = F.last(F.when(F.col("_new") == 1, F.col(ts)), True).over(timed.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(column, F.when(F.col(ts).isNotNull(), first)).drop("_new")


def session_groups(df: DataFrame, keys: list[str], ts: str, gap: str, *measures: Column) -> DataFrame:
    """GROUP BY keys, SESSION(ts, gap): session_start, session_end (last + gap) and the measures."""
    s = F.session_window(ts, gap)
    out = df.filter(F.col(ts).isNotNull()).groupBy(*keys, s.alias("_s")).agg(*measures)
    names = [c for c in out.columns if c not in keys and c != "_s"]
    return out.select(*keys, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), *names)
