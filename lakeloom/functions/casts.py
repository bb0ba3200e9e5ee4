"""Casts that give null for invalid input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import datetimes, strings


def cast(x: Column, to: str, kind: str = "string") -> Column:
    """Cast a column of type ``kind``.

    To string: whole doubles without fraction, times as ISO with Z. To boolean from text: only
    true and false. Times to integer: microseconds; integer to time: 100 ns ticks since 1970.
    Doubles to integer are truncated.
    """
    to, kind = to.lower(), kind.lower()
    time = kind.startswith("timestamp") or kind == "date"
    if to == "string":
        return strings.to_string(x, kind)
    if to in ("bool", "boolean"):
        return strings.to_bool(x) if kind == "string" else x.cast("boolean")
    if to in ("int", "integer", "bigint"):
        if time:
            return datetimes.micros(x)
        return x.try_cast("bigint")
    if to.startswith("timestamp"):
        return F.timestamp_micros(F.floor(x / 10).cast("bigint")) if kind in ("int", "bigint") else x.try_cast("timestamp")
    if to == "decimal":
        to = "decimal(38,18)"
    return x.try_cast(to)
