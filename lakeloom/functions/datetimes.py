"""Date and time functions. Times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 0001-01-01, where windows are aligned, to 1970-01-01.
DAYS_TO_EPOCH = 719162
MICROS = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "h": "MMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "Z": "'UTC'", "z": "'+0000'"}


def strftime(us: Column, fmt: str) -> Column:
    """Format microseconds since 1970 by % directives."""
    parts, i, plain = [], 0, ""
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            i += 1
            d = fmt[i]
            if d in "%nt":
                plain += {"%": "%", "n": "\n", "t": "\t"}[d]
            else:
                parts += [("lit", plain), (d, None)]
                plain = ""
        else:
            plain += c
        i += 1
    parts.append(("lit", plain))
    ts = F.timestamp_micros(us)
    named = {
        "e": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
        "s": lambda: F.unix_seconds(ts).cast("string"),
        "u": lambda: (F.weekday(ts) + 1).cast("string"),
        "w": lambda: (F.dayofweek(ts) - 1).cast("string"),
        "V": lambda: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        "G": lambda: F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
        "C": lambda: F.lpad(F.floor(F.year(ts) / 100).cast("string"), 2, "0"),
    }
    out = []
    for d, text in parts:
        if d == "lit":
            out += [F.lit(text)] if text else []
        elif d in named:
            out.append(named[d]())
        elif d in _STRFTIME:
            out.append(F.date_format(ts, _STRFTIME[d]))
        else:
            raise ValueError(f"unknown directive %{d}")
    return F.when(us.isNotNull(), F.concat(*out) if out else F.lit(""))


def _weeks(ts: Column, first: int) -> Column:
    """Week of the year whose first week starts on the first day ``first`` (0: Monday) of January."""
    day = F.dayofyear(ts) - 1
    since = F.pmod(F.weekday(ts) - first, F.lit(7))
    return F.floor((day - since + 7) / 7).cast("int")


def _us(ts: Column) -> tuple[Column, Column]:
    """(year, week) of the calendar whose weeks start on Sunday and belong to their Wednesday's year."""
    sunday = F.date_sub(F.to_date(ts), F.dayofweek(ts) - 1)
    middle = F.date_add(sunday, 3)
    return F.year(middle), F.floor((F.dayofyear(middle) - 1) / 7).cast("int") + 1


PARTS = {
    "YEAR": F.year,
    "ISO_YEAR": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "US_YEAR": lambda t: _us(t)[0],
    "QUARTER": F.quarter,
    "MONTH": F.month,
    "DAY": F.dayofmonth,
    "DAY_OF_YEAR": F.dayofyear,
    "MONDAY_DAY_OF_WEEK": lambda t: F.weekday(t) + 1,
    "SUNDAY_DAY_OF_WEEK": F.dayofweek,
    "MONDAY_WEEK": lambda t: _weeks(t, 0),
    "SUNDAY_WEEK": lambda t: _weeks(t, 6),
    "ISO_WEEK": F.weekofyear,
    "US_WEEK": lambda t: _us(t)[1],
    "HOUR": F.hour,
    "MINUTE": F.minute,
    "SECOND": F.second,
    "MILLISECOND": lambda t: F.floor(F.pmod(micros(t), F.lit(10**6)) / 1000),
    "MICROSECOND": lambda t: F.pmod(micros(t), F.lit(1000)),
}


def extract(part: str, ts: Column) -> Column:
    return PARTS[part.upper()](ts).cast("bigint")


_DOTNET = [("yyyy", "yyyy"), ("yy", "yy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("M", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("mm", "mm"), ("m", "m"), ("ss", "ss"), ("s", "s"), ("tt", "a"), ("zzz", "XXX"), ("K", "XXX")]


def java_format(fmt: str) -> str:
    """A .NET date format as Spark's; other letters are quoted."""
    out, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c in "'\"":
            end = fmt.find(c, i + 1)
            end = len(fmt) if end < 0 else end
            out += "'" + fmt[i + 1 : end].replace("'", "''") + "'"
            i = end + 1
        elif c == "\\" and i + 1 < len(fmt):
            out += "'" + fmt[i + 1] + "'"
            i += 2
        elif c in "fF":
            n = len(fmt[i:]) - len(fmt[i:].lstrip(c))
            out += "S" * n
            i += n
        else:
            for a, b in _DOTNET:
                if fmt.startswith(a, i):
                    out += b
                    i += len(a)
                    break
            else:
                out += f"'{c}'" if c.isalpha() else c
                i += 1
    return out


def parse(text: Column, fmt: str) -> Column:
    """Null if the text doesn't match."""
    return F.try_to_timestamp(text, F.lit(java_format(fmt)))


def format(ts: Column, fmt: str) -> Column:  # noqa: A001
    return F.date_format(ts, java_format(fmt))


def add(part: str, n: Column, ts: Column) -> Column:
    """ts plus n parts; calendar parts keep the day or end at the month's last."""
    part = part.upper()
    months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}.get(part)
    if months:
        return ts + F.make_ym_interval(F.lit(0), (n * months).cast("int"))
    if part not in MICROS:
        raise ValueError(f"unknown part {part}")
    return from_micros(micros(ts) + n.cast("bigint") * MICROS[part])


def diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of ``part`` crossed from a to b; weeks start on Sunday."""
    part = part.upper()
    if part in ("YEAR", "QUARTER", "MONTH"):
        per = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[part]
        month = lambda t: F.floor((F.year(t) * 12 + F.month(t) - 1) / per)
        return (month(b) - month(a)).cast("bigint")
    if part == "WEEK":
        week = lambda t: F.floor((F.unix_date(F.to_date(t)) + 4) / 7)
        return (week(b) - week(a)).cast("bigint")
    size = MICROS[part]
    return (F.floor(micros(b) / size) - F.floor(micros(a) / size)).cast("bigint") if size < 86400 * 10**6 and size > 1000 else _exact(part, a, b)


def _exact(part: str, a: Column, b: Column) -> Column:
    if part == "DAY":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("bigint")
    if part == "MILLISECOND":
        return F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))
    return micros(b) - micros(a)


def _week_start(ts: Column, first: int) -> Column:
    return F.date_trunc("day", F.date_sub(F.to_date(ts), F.pmod(F.weekday(ts) - first, F.lit(7)).cast("int"))).cast("timestamp_ntz")


_ORIGINS = {
    "YEAR": lambda t: F.date_trunc("year", t),
    "MONTH": lambda t: F.date_trunc("month", t),
    "MONDAY_WEEK": lambda t: _week_start(t, 0),
    "ISO_WEEK": lambda t: _week_start(t, 0),
    "SUNDAY_WEEK": lambda t: _week_start(t, 6),
    "US_WEEK": lambda t: _week_start(t, 6),
    "DAY": lambda t: F.date_trunc("day", t),
    "HOUR": lambda t: F.date_trunc("hour", t),
    "MINUTE": lambda t: F.date_trunc("minute", t),
    "SECOND": lambda t: F.date_trunc("second", t),
    "MILLISECOND": lambda t: F.date_trunc("millisecond", t),
}


def round_calendar(ts: Column, rounding: str, unit: str, origin: str, multiple: int) -> Column:
    """Round to a grid of ``multiple`` units that starts anew at each ``origin``.

    FLOOR, CEIL (the next grid point, also from a grid point), ROUND_TIE_DOWN, ROUND_TIE_UP.
    """
    if multiple <= 0:
        raise ValueError("multiple must be positive")
    unit, origin, rounding = unit.upper(), origin.upper(), rounding.upper()
    anchor = _ORIGINS[origin](ts).cast("timestamp_ntz")
    if unit in ("YEAR", "MONTH"):
        months = multiple * (12 if unit == "YEAR" else 1)
        step = F.floor((F.month(ts) - 1) / months) * months if origin == "YEAR" and unit == "MONTH" else F.lit(0)
        before = anchor + F.make_ym_interval(F.lit(0), step.cast("int"))
        after = before + F.make_ym_interval(F.lit(0), F.lit(months))
    else:
        size = MICROS[unit] * multiple
        gone = micros(ts) - micros(anchor)
        before = from_micros(micros(ts) - F.pmod(gone, F.lit(size)))
        after = from_micros(micros(ts) - F.pmod(gone, F.lit(size)) + size)
    if rounding == "FLOOR":
        return before
    if rounding == "CEIL":
        return after
    down, up = micros(ts) - micros(before), micros(after) - micros(ts)
    closer = (down < up) | ((down == up) & F.lit(rounding == "ROUND_TIE_DOWN"))
    return F.when(ts.isNull(), None).when(closer, before).otherwise(after)
