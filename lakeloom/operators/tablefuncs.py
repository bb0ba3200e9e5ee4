"""Table functions: unnest, tumbling and hopping windows aligned at 0001-01-01."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.datetimes import DAYS_TO_EPOCH, MICROS, from_micros, micros

MOST_WINDOWS = 100_000


def size_micros(amount: int, unit: str) -> int:
    unit = unit.upper().rstrip("S") if unit.upper() != "S" else unit
    if unit not in MICROS or int(amount) != amount or amount <= 0:
        raise ValueError(f"not a window size: {amount} {unit}")
    return int(amount) * MICROS[unit]


def _aligned(ts: Column, step: int) -> Column:
    """The last multiple of ``step`` from 0001-01-01 at or before ts, in microseconds since 1970."""
    shift = DAYS_TO_EPOCH * MICROS["DAY"] % step
    return micros(ts) - F.pmod(micros(ts) + shift, F.lit(step))


def unnest(df: DataFrame, items: Column, alias: str = "value", outer: bool = False, on: Callable[[Column], Column] | None = None) -> DataFrame:
    """Join each row to its elements; a map's are structs of key and value.

    ``outer`` keeps rows without (matching) elements; ``on`` is a condition on an element, checked
    within the array, so no join is needed.
    """
    kind = df.select(items.alias("x")).schema["x"].dataType.typeName()
    listed = F.map_entries(items) if kind == "map" else items
    if on is not None:
        listed = F.filter(listed, on)
    return df.select("*", (F.explode_outer if outer else F.explode)(listed).alias(alias))


def tumbling_window(df: DataFrame, ts: str, size: int, unit: str) -> DataFrame:
    """Add window_start and window_end; rows without a time are dropped. No shuffle."""
    step = size_micros(size, unit)
    start = _aligned(F.col(ts), step)
    return df.filter(F.col(ts).isNotNull()).select("*", from_micros(start).alias("window_start"), from_micros(start + step).alias("window_end"))


def hopping_window(df: DataFrame, ts: str, hop: int, hop_unit: str, size: int, size_unit: str, outer: bool = False) -> DataFrame:
    """One row per window that holds the time; hops longer than the window leave gaps.

    ``outer`` keeps rows in no window, with null bounds.
    """
    step, width = size_micros(hop, hop_unit), size_micros(size, size_unit)
    n = -(-width // step)
    if n > MOST_WINDOWS:
        raise ValueError(f"{n} windows a row")
    last = _aligned(F.col(ts), step)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: last - k * F.lit(step)), lambda s: s > micros(F.col(ts)) - width)
    rows = df if outer else df.filter(F.col(ts).isNotNull())
    out = rows.select("*", (F.explode_outer if outer else F.explode)(starts).alias("_s"))
    return out.select(*df.columns, from_micros(F.col("_s")).alias("window_start"), from_micros(F.col("_s") + width).alias("window_end"))
