"""Functions, by single values."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import casts, checks, datetimes, hashing, lists, math, strings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def d(*a):
    return datetime.datetime(*a)


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("x, y, want", [(1, 2, 0.5), (1, 0, INF), (-1, 0, -INF), (None, 1, None), (7, None, None)])
def test_divide(spark, x, y, want):
    assert value(spark, math.divide(F.lit(x).cast("int"), F.lit(y).cast("int"))) == want


def test_not_a_number(spark):
    assert value(spark, F.isnan(math.divide(F.lit(0), F.lit(0))))
    assert value(spark, F.isnan(math.modulo(F.lit(5), F.lit(0))))
    assert value(spark, math.modulo(F.lit(-7), F.lit(3))) == -1
    assert value(spark, math.is_nan(F.lit(None).cast("double"))) is None
    assert value(spark, math.is_infinite(F.lit(INF))) is True
    assert value(spark, math.is_finite(F.lit(NAN))) is False
    assert value(spark, math.log10(F.lit(0.0))) == -INF
    assert value(spark, F.isnan(math.log10(F.lit(-1.0))))


@pytest.mark.parametrize("x, want", [(2.5, 2.0), (3.5, 4.0), (-2.5, -2.0), (2.51, 3.0)])
def test_round_even(spark, x, want):
    assert value(spark, math.round_even(F.lit(x))) == want


@pytest.mark.parametrize(
    "text, pattern, escape, want",
    [("abc", "a%", None, True), ("abc", "a[bc]c", None, True), ("axc", "a[^bc]c", None, True), ("a%c", "a!%c", "!", True), ("abc", "a!%c", "!", False), ("a.c", "a_c", None, True), ("x(1)", "x(%", None, True), ("abc", "[x]bc", None, False)],
)
def test_like(spark, text, pattern, escape, want):
    assert value(spark, strings.like(F.lit(text), pattern, escape)) is want


def test_strings(spark):
    s = lambda x: F.lit(x)
    assert value(spark, strings.starts_with(F.lit(None).cast("string"), s("a"))) is False
    assert value(spark, strings.starts_with(s("Abc"), s("aB"), True)) is True
    assert value(spark, strings.split(s("a.b.c"), ".")) == ["a", "b", "c"]
    assert value(spark, strings.split(s("a.b"), None)) == ["a.b"]
    assert value(spark, strings.regexp_split(s("a1b22c"), "[0-9]+")) == ["a", "b", "c"]
    assert value(spark, strings.join(s(","), F.array(s("a"), F.lit(None), s("b")))) == "a,b"
    assert value(spark, strings.join(s(","), F.array().cast("array<string>"))) == ""
    assert value(spark, strings.base64_decode(strings.base64_encode(s("héllo")))) == "héllo"
    assert value(spark, strings.strpos(s("hello"), s("l"))) == 3 and value(spark, strings.strpos(s("hello"), s("z"))) == 0
    assert value(spark, strings.guid(s("{ABCDEF01-2345-6789-ABCD-EF0123456789}"))) == "abcdef01-2345-6789-abcd-ef0123456789"
    assert value(spark, strings.guid(s("nonsense"))) is None
    assert value(spark, strings.to_string(F.lit(3.0), "double")) == "3" and value(spark, strings.to_string(F.lit(3.25), "double")) == "3.25"
    assert value(spark, strings.to_bool(s("TRUE"))) is True and value(spark, strings.to_bool(s("yes"))) is None
    assert value(spark, strings.from_json(s('{"a":1}'), "a int"))["a"] == 1
    assert value(spark, F.to_json(strings.from_json(s('{"b":1,"a":[2]}')))) == '{"a":[2],"b":1}'


def test_casts(spark):
    assert value(spark, casts.cast(F.lit("x"), "int")) is None
    assert value(spark, casts.cast(F.lit(-3.7), "int", "double")) == -3
    assert value(spark, casts.cast(ts("2024-01-02 03:04:05"), "string", "timestamp")) == "2024-01-02T03:04:05.000Z"
    assert value(spark, casts.cast(ts("1970-01-01 00:00:01"), "int", "timestamp")) == 10**6
    assert value(spark, casts.cast(F.lit("abc"), "timestamp")) is None
    assert str(value(spark, casts.cast(F.lit("1.5"), "decimal"))).startswith("1.5")


@pytest.mark.parametrize(
    "part, a, b, want",
    [("MINUTE", "2024-01-01 12:00:59", "2024-01-01 12:01:00", 1), ("YEAR", "2023-12-31", "2024-01-01", 1), ("WEEK", "2024-01-06", "2024-01-07", 1), ("MONTH", "2024-02-01", "2024-01-31", -1), ("QUARTER", "2024-01-01", "2024-12-31", 3), ("DAY", "2024-01-01 23:59:59", "2024-01-02", 1), ("MILLISECOND", "2024-01-01", "2024-01-01 00:00:01", 1000), ("MICROSECOND", "2024-01-01", "2024-01-01 00:00:01", 10**6), ("SECOND", "1969-12-31 23:59:59.5", "1970-01-01", 1)],
)
def test_datediff(spark, part, a, b, want):
    assert value(spark, datetimes.diff(part, ts(a), ts(b))) == want


@pytest.mark.parametrize("day, part, want", [("2021-01-03", "US_WEEK", 1), ("2021-01-02", "US_YEAR", 2020), ("2021-01-03", "ISO_YEAR", 2020), ("2021-01-04", "MONDAY_WEEK", 1), ("2021-01-03", "MONDAY_WEEK", 0), ("2021-01-03", "SUNDAY_WEEK", 1), ("2024-02-29 10:11:12.345678", "MILLISECOND", 345), ("2024-02-29 10:11:12.345678", "MICROSECOND", 678), ("2024-02-29", "DAY_OF_YEAR", 60)])
def test_extract(spark, day, part, want):
    assert value(spark, datetimes.extract(part, ts(day))) == want


def test_dates(spark):
    assert value(spark, datetimes.add("MONTH", F.lit(1), ts("2024-01-31"))) == d(2024, 2, 29)
    assert value(spark, datetimes.add("MICROSECOND", F.lit(5), ts("2024-01-31"))) == d(2024, 1, 31, 0, 0, 0, 5)
    assert value(spark, datetimes.parse(F.lit("16 Apr 2025 02:30 PM"), "dd MMM yyyy hh:mm tt").cast("timestamp_ntz")) == d(2025, 4, 16, 14, 30)
    assert value(spark, datetimes.parse(F.lit("nope"), "yyyy-MM-dd")) is None
    assert value(spark, datetimes.format(ts("2025-04-16 14:05:06.123"), "yyyy-MM-dd'T'HH:mm:ss.fff")) == "2025-04-16T14:05:06.123"
    assert value(spark, datetimes.strftime(F.lit(0).cast("bigint"), "%Y-%m-%d %H:%M:%S %j %%")) == "1970-01-01 00:00:00 001 %"


@pytest.mark.parametrize(
    "at, args, want",
    [("2024-05-17 13:25:00", ("FLOOR", "MONTH", "YEAR", 3), d(2024, 4, 1)), ("2024-05-17 13:25:00", ("CEIL", "HOUR", "DAY", 6), d(2024, 5, 17, 18)), ("2024-05-17 12:00:00", ("CEIL", "HOUR", "DAY", 6), d(2024, 5, 17, 18)), ("2024-05-17 13:30:00", ("ROUND_TIE_DOWN", "HOUR", "DAY", 1), d(2024, 5, 17, 13)), ("2024-05-17 13:30:00", ("ROUND_TIE_UP", "HOUR", "DAY", 1), d(2024, 5, 17, 14)), ("2024-05-17 13:30:00", ("FLOOR", "DAY", "MONDAY_WEEK", 2), d(2024, 5, 17)), ("2024-05-18", ("FLOOR", "WEEK", "SUNDAY_WEEK", 1), d(2024, 5, 12))],
)
def test_round_calendar(spark, at, args, want):
    assert value(spark, datetimes.round_calendar(ts(at), *args)) == want


def test_lists(spark):
    a = lambda *x: F.array(*[F.lit(v).cast("int") for v in x])
    assert value(spark, lists.sort_asc_null_last(a(3, None, 1))) == [1, 3, None]
    assert value(spark, lists.first_difference(a(1, 2, 3), a(1, 5, 3))) == 2
    assert value(spark, lists.first_difference(a(1, 2), a(1, 2))) is None
    assert value(spark, lists.first_difference(a(4, 2), F.lit(None).cast("array<int>"))) == 4
    assert value(spark, lists.first_difference(F.lit(None).cast("array<int>"), a(1))) is None


HASHES = [("hello", "string", 2794345569481354659, "adc1e9b5-1b07-7f3e-c779-cfaa5e523818"), (123, "bigint", -7945237082106452088, "73ee1948-c617-586c-3264-27d6e25f86d1"), (None, "string", -1642502924627794072, "935ecda6-0092-6a0f-c44b-dff4074eecdb"), (True, "boolean", -8484456787529832656, "445a0251-8391-0555-e12e-f9d2eb86ceeb"), ("2016-12-31 13:30:15", "timestamp_ntz", -6067517087359942292, "81ad73b8-5fcb-f3b7-385a-2ae0afec3379")]


@pytest.mark.parametrize("x, kind, short, long", HASHES)
def test_hashes(spark, x, kind, short, long):
    c = F.lit(x).cast(kind)
    assert value(spark, hashing.xxhash64(c)) == short
    assert value(spark, hashing.xxhash128_guid(c)) == long


def test_hashes_of_columns_equal_hashes_of_values(spark):
    """Whole columns, with nulls, against bytes put together value by value."""
    import struct
    from decimal import Decimal

    import xxhash

    rows_ = [(1, 2.5, "é", True, b"xy", Decimal("1.50"), [1, None], ("a", 3), {"k": 7}), (None,) * 9, (-7, float("nan"), "", False, b"", Decimal("-12345678901.000001"), [], (None, 4), {}), (1 << 62, -0.0, "long " * 50, None, None, None, [5], ("b", None), {"x": None})]
    df = spark.createDataFrame(rows_, "i bigint, d double, s string, b boolean, y binary, m decimal(30,6), l array<bigint>, r struct<p:string,q:bigint>, k map<string,bigint>").repartition(2)
    for names in (["i"], ["d"], ["s"], ["b"], ["y"], ["m"], ["l"], ["r"], ["k"], ["s", "i"], ["i", "d", "s", "b", "y", "m", "l", "r", "k"]):
        for r in df.select(*names, hashing.xxhash64(*[F.col(n) for n in names]).alias("h")).collect():
            plain = b"".join(hashing.value_bytes(dict(r[n]) if isinstance(r[n], dict) else list(r[n]) if isinstance(r[n], (list, tuple)) else r[n]) for n in names)
            assert r["h"] == struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(plain)))[0], names


def test_hash_of_two(spark):
    assert value(spark, hashing.xxhash64(F.lit(123).cast("bigint"), F.lit("hello"))) == -79122209000784278


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "a int, b int")
    c = checks.Checks()
    out = df.select(c.value(F.col("a"), F.col("a") < F.col("b"), "{a} is not below {b}", a=F.col("a"), b=F.col("b")).alias("a"), "b")
    watched, seen = c.watch(df)
    assert watched.count() == 3 and seen.get == {"check_0": 2}
    assert sorted(r["message"] for r in c.violations(df).collect()) == ["3 is not below 2", "null is not below 1"]
    assert out.count() == 3
