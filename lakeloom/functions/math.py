"""Arithmetic whose results differ from Spark's own: invalid input gives null, zero divisors IEEE values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(x: Column, y: Column) -> Column:
    """Division in doubles: x / 0 is infinite, 0 / 0 not a number, null stays null."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).otherwise(F.signum(x) * INF)
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def modulo(x: Column, y: Column) -> Column:
    """Remainder with the sign of x; not a number for a zero divisor, so the result is a double then."""
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, F.lit(NAN)).otherwise(F.try_mod(x, y).cast("double"))


def decimal_divide(x: Column, y: Column) -> Column:
    """Decimal division; null for a zero divisor."""
    return F.when(y != 0, F.try_divide(x, y))


def round_even(x: Column) -> Column:
    """Half to even, keeping the type."""
    return F.bround(x, 0)


def floor(x: Column, kind: str = "double") -> Column:
    return F.floor(x).cast(kind)


def ceil(x: Column, kind: str = "double") -> Column:
    return F.ceil(x).cast(kind)


def log10(x: Column) -> Column:
    """-infinity at 0, not a number below."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log10(x))


def numeric(x: Column) -> Column:
    """Null for what isn't a number."""
    return x.try_cast("double")


def is_nan(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.isnan(x.cast("double")))


def is_infinite(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.abs(x.cast("double")) == INF)


def is_finite(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != INF))


def xor(a: Column, b: Column) -> Column:
    return a != b


#: One-argument functions that Spark already has with these semantics.
PLAIN = {
    "sqrt": F.sqrt, "exp": F.exp, "cos": F.cos, "sin": F.sin, "tan": F.tan, "cosh": F.cosh, "sinh": F.sinh, "tanh": F.tanh,
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "acosh": F.acosh, "asinh": F.asinh, "atanh": F.atanh,
    "radians": F.radians, "degrees": F.degrees, "abs": F.abs, "sign": F.signum, "negate": F.negative,
}
