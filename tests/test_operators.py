"""Operators on small tables: edge cases that the driver's tables don't have."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import aggregates, joins, normalize, recursion, sets, tablefuncs, windows


def d(*a):
    return datetime.datetime(2024, 1, 1, *a)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_top_n_breaks_ties_by_all_columns(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert rows(sets.top_n(df, 2, F.col("k"))) == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError):
        sets.top_n(df, 2)


def test_bag_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(sets.combine("except_all", a, b)) == [(1,), (2,)]
    assert rows(sets.combine("intersect_all", a, b)) == [(1,)]
    assert rows(sets.combine("union_distinct", a, b)) == [(1,), (2,), (3,)]
    assert rows(sets.combine("except_all", a, b, b)) == [(2,)]


def test_mark_join_and_not_in_are_two_valued(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (1,), (None,)], "y int")
    assert rows(joins.mark_join(a, b, [("x", "y")])) == [(1, True), (2, False), (None, False)]
    assert rows(joins.not_in(a, b, "x", "y")) == [(2,), (None,)]


def test_broadcast_is_checked(spark):
    small = spark.range(10)
    assert "broadcast" in joins.broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.broadcast_if_small(spark.range(10**9))._jdf.queryExecution().logical().toString().lower()


def test_session_gap_of_equal_length_stays(spark):
    df = spark.createDataFrame([("u", d(0, 0)), ("u", d(0, 30)), ("u", d(1, 1)), ("u", None)], "u string, ts timestamp_ntz")
    out = windows.session_window(df, ["u"], "ts", 1800)
    assert rows(out) == sorted([("u", d(0, 0), d(0, 0)), ("u", d(0, 30), d(0, 0)), ("u", d(1, 1), d(1, 1)), ("u", None, None)], key=repr)


def test_default_frame_is_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    out = df.select(F.sum("v").over(windows.window([], ["k"])).alias("s"))
    assert sorted(r[0] for r in out.collect()) in ([1, 3], [2, 3])


def test_windows_align_at_year_one_monday(spark):
    df = spark.createDataFrame([(d(5),), (None,)], "ts timestamp_ntz")
    assert tablefuncs.tumbling_window(df, "ts", 1, "WEEK").select("window_start").collect()[0][0] == d(0)
    with pytest.raises(ValueError):
        tablefuncs.tumbling_window(df, "ts", 1, "MONTH")


def test_hopping_gap_and_overlap(spark):
    df = spark.createDataFrame([(d(0, 7),)], "ts timestamp_ntz")
    assert sorted(r[0] for r in tablefuncs.hopping_window(df, "ts", 5, "MINUTE", 10, "MINUTE").select("window_start").collect()) == [d(0, 0), d(0, 5)]
    assert tablefuncs.hopping_window(df, "ts", 10, "MINUTE", 5, "MINUTE").count() == 0
    assert tablefuncs.hopping_window(df, "ts", 10, "MINUTE", 5, "MINUTE", outer=True).select("window_start").collect()[0][0] is None


def test_unnest(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, xs array<int>")
    assert rows(tablefuncs.unnest(df, F.col("xs"), "x").select("id", "x")) == [(1, 1), (1, 2)]
    assert rows(tablefuncs.unnest(df, F.col("xs"), "x", outer=True).select("id", "x")) == [(1, 1), (1, 2), (2, None), (3, None)]
    assert rows(tablefuncs.unnest(df, F.col("xs"), "x", outer=True, on=lambda x: x > 1).select("id", "x")) == [(1, 2), (2, None), (3, None)]


def test_iteration_limits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    start = spark.createDataFrame([(1,)], "id int")
    step = lambda new: edges.join(new, F.col("a") == F.col("id")).select(F.col("b").alias("id"))
    assert rows(recursion.iterate(start, step, distinct=True)) == [(1,), (2,), (3,)]
    assert recursion.iterate(start, step, max_iterations=4).count() == 5
    assert rows(recursion.iterate(start, step, until=lambda new: new.filter("id < 2"))) == [(1,), (2,)]


def test_surrogate_keys_persist(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    first = aggregates.surrogate_keys(df, ["k"])
    more = aggregates.surrogate_keys(spark.createDataFrame([("c",), ("a",)], "k string"), ["k"], known=recursion.written(first, "keys"))
    keys = dict(map(tuple, more.collect()))
    assert sorted(keys.values()) == [0, 1, 2] and keys["c"] == 2


def test_normalize(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, None, True)], "k int, t int, v string, gone boolean")
    assert rows(normalize.latest(df, ["k"], F.col("t"), F.col("gone")).select("k", "v")) == [(1, "b")]


def test_exchange(spark):
    df = spark.range(100)
    assert joins.exchange(df, "scatter", ["id"], 3).rdd.getNumPartitions() == 3
    assert joins.exchange(df, "single").rdd.getNumPartitions() == 1


def test_sliding_by_equals_moving_frames(spark):
    import random

    from pyspark.sql import functions as F

    from lakeloom.operators import windows

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(3), i, rng.choice([None, *range(6)]), f"r{i}") for i in range(120)], "g int, t int, y int, x string")
    for preceding in (0, 1, 4, 60, 500):
        w = windows.window(["g"], ["t"], (-preceding, 0))
        want = df.select("*", windows.min_by(F.col("x"), F.col("y"), w, [F.col("t")]).alias("lo"), windows.max_by(F.col("x"), F.col("y"), w, [-F.col("t")]).alias("hi"))
        got = windows.sliding_by(df, ["g"], ["t"], preceding, lo=("min_by", "x", "y"), hi=("max_by", "x", "y"))
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_crowded_ranges_spread_over_tiles(spark, monkeypatch):
    """A crowded bucket's pairs come from many tasks, each pair once: equal rows, nulls and thin buckets too."""
    monkeypatch.setattr(joins, "CANDIDATES", 500, raising=False)
    for name, rows_ in (("POINTS", 4), ("RANGES", 8), ("TILE", 32)):
        monkeypatch.setattr(joins, name, rows_, raising=False)
    left = spark.createDataFrame([(i, float(i % 90) / 9) for i in range(180)] + [(500, 3.0)] * 3 + [(600, None), (601, 31.0), (602, 99.0)], "id int, v double")
    right = spark.createDataFrame([(i, float(i % 40) / 5, float(i % 40) / 5 + 4) for i in range(120)] + [(700, 30.0, 32.0), (701, None, 3.0), (702, 5.0, 1.0)], "part int, lo double, hi double")
    got = joins.range_join(left, right, "v", "lo", "hi", 4.0)
    want = [(a["id"], a["v"], *b) for a in left.collect() for b in right.collect() if None not in (a["v"], b["lo"]) and b["lo"] <= a["v"] <= b["hi"]]
    assert got.columns == ["id", "v", "part", "lo", "hi"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert len({r[0] for r in got.filter("part < 700").select(F.spark_partition_id()).distinct().collect()}) > 6
