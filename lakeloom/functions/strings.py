"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUID = r"^[{(]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[)}]?$"


def like_pattern(pattern: str, escape: str | None = None) -> str:
    """An anchored Java regular expression for a LIKE pattern with % _ [set] [^set]."""
    out, i = [], 0
    special = set(r"\.[]{}()*+-?^$|&#")
    quote = lambda c: "\\" + c if c in special else c
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(quote(pattern[i]))
        elif c == "%":
            out.append("[\\s\\S]*")
        elif c == "_":
            out.append("[\\s\\S]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            negated = inner.startswith("^")
            body = inner[1:] if negated else inner
            out.append("[" + ("^" if negated else "") + body.replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        else:
            out.append(quote(c))
        i += 1
    return "^" + "".join(out) + "$"


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE; plain patterns stay LIKE (which can be pushed down), sets become a regular expression."""
    if "[" not in pattern and (escape is None or escape not in pattern) and "\\" not in pattern:
        return x.like(pattern)
    return x.rlike(like_pattern(pattern, escape))


def starts_with(x: Column, prefix: Column, ignore_case: bool = False) -> Column:
    """False for null on either side."""
    if ignore_case:
        x, prefix = F.lower(x), F.lower(prefix)
    return F.coalesce(F.startswith(x, prefix), F.lit(False))


def split(x: Column, separator: str | None) -> Column:
    """Split at a literal separator; a null separator gives the whole string."""
    if separator is None:
        return F.when(x.isNotNull(), F.array(x))
    return F.split(x, "\\Q" + separator + "\\E", -1)


def regexp_split(x: Column, pattern: str) -> Column:
    return F.split(x, pattern, -1)


def join(separator: Column, items: Column) -> Column:
    """Non-null items joined; no items give an empty string, a null separator null."""
    items = F.filter(items.cast("array<string>"), lambda v: v.isNotNull())
    joined = F.aggregate(items, F.lit(None).cast("string"), lambda a, v: F.when(a.isNull(), v).otherwise(F.concat(a, separator, v)))
    return F.when(separator.isNotNull() & items.isNotNull(), F.coalesce(joined, F.lit("")))


def strpos(x: Column, part: Column) -> Column:
    """Position from 1, 0 if missing."""
    return F.position(part, x)


def substring(x: Column, start: Column, length: Column | None = None) -> Column:
    """From position ``start`` (from 1), in code points."""
    return F.substr(x, start, length) if length is not None else F.substr(x, start)


def base64_encode(x: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(x, "UTF-8")), "[\r\n]", "")


def base64_decode(x: Column) -> Column:
    return F.decode(F.unbase64(x), "UTF-8")


def to_string(x: Column, kind: str = "string") -> Column:
    """As text; whole doubles have no fraction."""
    if kind in ("double", "float"):
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return x.cast("string")


def to_bool(x: Column) -> Column:
    """Only true and false in any case; all else is null."""
    low = F.lower(x)
    return F.when(low == "true", True).when(low == "false", False)


def guid(x: Column) -> Column:
    """Lower-case dashed form of a valid identifier; else null."""
    plain = F.lower(F.regexp_replace(x, "[{}()-]", ""))
    dashed = F.concat_ws("-", *[F.substring(plain, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(x.rlike(GUID), dashed)


def to_json(x: Column) -> Column:
    """JSON text; a string becomes a quoted string."""
    return F.to_json(x)


def from_json(x: Column, schema: str | None = None) -> Column:
    """Parsed by a schema, or as a variant; malformed text is null."""
    return F.from_json(x, schema) if schema else F.try_parse_json(x)
