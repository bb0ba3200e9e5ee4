"""Change-logs and maintained views against recomputation."""

import random

from pyspark.sql import functions as F

from lakeloom.streaming import changes, views
from lakeloom.streaming.views import KeyedSink, View


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_apply_and_consolidate(spark):
    c = spark.createDataFrame([("a", 2), ("b", 1), ("b", -1)], "k string, _weight int")
    s = changes.apply(None, c)
    assert rows(s) == [("a",), ("a",)]
    assert rows(changes.apply(s, spark.createDataFrame([("a", -1), ("c", 1)], "k string, _weight int"))) == [("a",), ("c",)]


def test_join_delta_equals_difference(spark):
    rng = random.Random(3)
    table = lambda n, a, b: spark.createDataFrame([(rng.randrange(4), rng.randrange(3)) for _ in range(n)], f"k int, {a} int")
    left, right = table(6, "a", 0), table(6, "b", 0)
    dl, dr = table(3, "a", 0).withColumn("_weight", F.lit(1)), right.limit(2).withColumn("_weight", F.lit(-1))
    delta = changes.join_delta(left, dl, right, dr, ["k"])
    before = left.join(right, "k").select("k", "a", "b")
    after = changes.apply(left, dl).join(changes.apply(right, dr), "k").select("k", "a", "b")
    assert rows(changes.apply(before, delta.select("k", "a", "b", "_weight"))) == rows(after)


def test_view_with_churn(spark, tmp_path, monkeypatch):
    """Random upserts and deletes, with logs merged on the way."""
    monkeypatch.setattr(views, "COMPACT", 2)
    rng = random.Random(1)
    build = lambda t: t["orders"].join(t["users"], "user").groupBy("user").agg(F.sum("money").alias("total"), F.max("name").alias("name"))
    view = View(spark, f"file://{tmp_path}/state", {"orders": ["key"], "users": ["user"]}, build, affected={"orders": ["user"], "users": ["user"]})
    sink = KeyedSink(spark, f"file://{tmp_path}/sink", ["user"])
    orders, users = {}, {}
    for batch in range(5):
        changed_orders = {rng.randrange(8): (rng.randrange(3), rng.randrange(100), rng.random() < 0.3) for _ in range(4)}
        changed_users = {rng.randrange(3): f"n{rng.randrange(9)}" for _ in range(2)}
        o = spark.createDataFrame([(k, u, m, gone) for k, (u, m, gone) in changed_orders.items()], "key int, user int, money int, gone boolean")
        u = spark.createDataFrame(list(changed_users.items()), "user int, name string")
        out = view.process(batch, {"orders": o, "users": u}, deleted="gone")
        for k, (user, m, gone) in changed_orders.items():
            orders.pop(k, None) if gone else orders.update({k: (user, m)})
        users |= changed_users
        want = {}
        for user, m in orders.values():
            if user in users:
                want[user] = want.get(user, 0) + m
        assert rows(view.result().select("user", "total", "name")) == sorted([(user, t, users[user]) for user, t in want.items()], key=repr)
        if out is not None:
            sink(out, batch)
            assert rows(sink.rows().select("user", "total", "name")) == rows(view.result().select("user", "total", "name"))
    assert view.process(4, {"orders": o, "users": u}) is None


def test_unchanged_rows_give_no_output(spark, tmp_path):
    view = View(spark, f"file://{tmp_path}/s", {"t": ["k"]}, lambda t: t["t"].select("k", (F.col("v") > 5).alias("big")))
    df = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    assert rows(view.process(0, {"t": df((1, 6), (2, 1))})) == [(1, True, 1), (2, False, 1)]
    assert rows(view.process(1, {"t": df((1, 7))})) == []
    assert rows(view.process(2, {"t": df((1, 2))})) == [(1, False, 1), (1, True, -1)]


def test_from_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k int, v int, t int"
    spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    view = View(spark, f"file://{tmp_path}/s", {"t": ["k"]}, lambda t: t["t"].agg(F.sum("v").alias("s")))
    got = []
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    view.start("t", read(), str(tmp_path / "cp"), sink=lambda out, b: got.append(rows(out)), order="t").awaitTermination()
    spark.createDataFrame([(2, 7, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    view.start("t", read(), str(tmp_path / "cp"), sink=lambda out, b: got.append(rows(out)), order="t").awaitTermination()
    assert rows(view.result()) == [(27,)]
    assert got[-1] == [(25, -1), (27, 1)]


def test_sql_view(spark, tmp_path):
    """A maintained query with a session window and a join; a late row merges two sessions."""
    import datetime

    from lakeloom.plans.engine import Engine

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    visits = lambda *r: spark.createDataFrame(list(r), "id int, who int, ts timestamp_ntz")
    sql = """CREATE VIEW named AS SELECT v.ts, p.name FROM visits v JOIN people p ON v.who = p.who;
    INSERT INTO out SELECT name, window_start, count(*) AS n FROM named GROUP BY name, SESSION(ts, 10, 'MINUTE')"""
    view = Engine(spark).maintain(sql, {"visits": ["id"], "people": ["who"]}, f"file://{tmp_path}/v")
    people = spark.createDataFrame([(1, "ann"), (2, "bob")], "who int, name string")
    view.process(0, {"visits": visits((1, 1, at(0)), (2, 1, at(20)), (3, 2, at(5))), "people": people})
    assert rows(view.result()) == [("ann", at(0), 1), ("ann", at(20), 1), ("bob", at(5), 1)]
    out = view.process(1, {"visits": visits((4, 1, at(10)))})
    assert rows(out) == sorted([("ann", at(0), 1, -1), ("ann", at(20), 1, -1), ("ann", at(0), 3, 1)], key=repr)
    assert rows(view.result()) == [("ann", at(0), 3), ("bob", at(5), 1)]


def test_exchange_is_pulled_by_bucket(spark, tmp_path):
    import pytest

    from lakeloom.streaming.exchange import Exchange

    ex = Exchange(spark, f"file://{tmp_path}/ex", 3)
    with pytest.raises(LookupError):
        ex.pull(0, -1)
    part = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "id % 5 AS k")
    ex.publish(0, part(0, 20), "scatter", ["k"])
    ex.publish(0, part(0, 999), "scatter", ["k"])  # a replay
    ex.publish(1, part(20, 30), "scatter", ["k"])
    got = [ex.pull(b, -1) for b in range(3)]
    assert [at for _, at in got] == [1, 1, 1] and sorted(r[0] for df, _ in got for r in df.collect()) == list(range(30))
    keys = [{r[1] for r in df.collect()} for df, _ in got]
    assert sum(map(len, keys)) == 5
    ex.publish(2, part(30, 31), "single")
    assert [ex.pull(b, 1)[0].count() for b in range(3)] == [1, 0, 0] and ex.pull(2, 2)[1] == 2
    with pytest.raises(ValueError):
        ex.publish(3, spark.range(1))
    ex.release(1)
    assert sum(ex.pull(b, -1)[0].count() for b in range(3)) == 1


def churn(spark, view, batches=6, seed=5):
    """Random upserts and deletes; yields the tables as they then are."""
    rng = random.Random(seed)
    orders, users, teams = {}, {}, {1: "red", 2: "blue"}
    for batch in range(batches):
        o = {rng.randrange(30): (rng.randrange(6), rng.choice([None, 1, 5, 9]), rng.random() < 0.25) for _ in range(8)}
        u = {rng.randrange(6): (f"n{rng.randrange(4)}", rng.randrange(1, 4)) for _ in range(3)}
        step = {"orders": spark.createDataFrame([(k, w, m, gone) for k, (w, m, gone) in o.items()], "key int, who int, money int, gone boolean")}
        if batch % 2 == 0:
            step["users"] = spark.createDataFrame([(k, n, t) for k, (n, t) in u.items()], "id int, name string, team int")
            users |= u
        for k, (w, m, gone) in o.items():
            orders.pop(k, None) if gone else orders.update({k: (w, m)})
        out = view.process(batch, step, deleted="gone")
        yield orders, users, teams, out


SUMS = "SELECT u.name, count(*) AS n, sum(o.money) AS total, avg(money) AS mean, min(o.money) AS low, max(money) + 1 AS high FROM orders o JOIN users u ON o.who = u.id AND o.key <> 7 WHERE u.team < 3 GROUP BY u.name HAVING count(*) > 1"


def test_incremental_groups(spark, tmp_path, monkeypatch):
    from lakeloom.plans.engine import Engine
    from lakeloom.streaming.incremental import IncrementalView

    monkeypatch.setattr(views, "COMPACT", 3)
    view = Engine(spark).maintain(SUMS, {"orders": ["key"], "users": ["id"]}, f"file://{tmp_path}/v")
    assert isinstance(view, IncrementalView)
    sink = KeyedSink(spark, f"file://{tmp_path}/sink", ["name"])
    for batch, (orders, users, _, out) in enumerate(churn(spark, view)):
        groups = {}
        for k, (w, m) in orders.items():
            if k != 7 and w in users and users[w][1] < 3:
                groups.setdefault(users[w][0], []).append(m)
        want = []
        for name, ms in groups.items():
            some = [m for m in ms if m is not None]
            if len(ms) > 1:
                want.append((name, len(ms), sum(some) if some else None, sum(some) / len(some) if some else None, min(some, default=None), max(some) + 1 if some else None))
        assert rows(view.result()) == sorted(want, key=repr), batch
        sink(out, batch)
        assert rows(sink.rows().select(view.result().columns)) == rows(view.result())


def test_incremental_joins(spark, tmp_path):
    """Three tables, one that doesn't change, and no grouping."""
    from lakeloom.plans.engine import Engine

    spark.createDataFrame([(1, "red"), (2, "blue")], "nr int, colour string").createOrReplaceTempView("teams")
    sql = "SELECT o.key AS key, upper(u.name) AS name, t.colour AS colour FROM orders o INNER JOIN users u ON o.who = u.id JOIN teams t ON u.team = t.nr WHERE o.money > 1"
    view = Engine(spark).maintain(sql, {"orders": ["key"], "users": ["id"]}, f"file://{tmp_path}/v")
    for orders, users, teams, _ in churn(spark, view, 4, 9):
        want = [(k, users[w][0].upper(), teams[users[w][1]]) for k, (w, m) in orders.items() if m and m > 1 and w in users and users[w][1] in teams]
        assert rows(view.result()) == sorted(want, key=repr)


def test_small_batches_read_little(spark, tmp_path):
    from lakeloom.plans.engine import Engine

    view = Engine(spark).maintain("SELECT o.who AS who, count(*) AS n, max(o.key) AS last FROM orders o JOIN users u ON o.who = u.id GROUP BY o.who", {"orders": ["key"], "users": ["id"]}, f"file://{tmp_path}/v", buckets=64)
    view.process(0, {"orders": spark.range(2000).selectExpr("CAST(id AS INT) AS key", "CAST(id % 500 AS INT) AS who"), "users": spark.range(500).selectExpr("CAST(id AS INT) AS id")})
    out = view.process(1, {"orders": spark.createDataFrame([(5000, 17), (3, 17)], "key int, who int")})
    assert rows(out) == sorted([(17, 4, 1517, -1), (17, 6, 5000, 1), (3, 4, 1503, -1), (3, 3, 1503, 1)], key=repr)
    files, of = view.read
    assert 0 < files < of / 8


def test_other_queries_are_computed_again(spark, tmp_path):
    from lakeloom.plans.engine import Engine
    from lakeloom.streaming.incremental import IncrementalView, shape_of

    s = ["a", "b"]
    assert shape_of("SELECT a.x FROM a", s, []) is not None and shape_of("SELECT a.x FROM v", s, ["v"]) is None
    for sql in ("SELECT DISTINCT x FROM a", "SELECT count(*) AS n FROM a", "SELECT a.x FROM a LEFT JOIN b ON a.x = b.x", "SELECT a.x FROM a JOIN b ON a.x < b.x", "SELECT x FROM a WHERE x IN (SELECT y FROM b)", "SELECT y, sum(x) AS s FROM a GROUP BY z", "SELECT p.x FROM a p JOIN a q ON p.x = q.x", "SELECT * FROM a"):
        assert shape_of(sql, s, []) is None, sql
    assert not isinstance(Engine(spark).maintain("SELECT DISTINCT x FROM a", {"a": None}, f"file://{tmp_path}/v"), IncrementalView)


def test_stateful_aggregate_on_a_stream(spark, tmp_path):
    """The state goes on from one run of a stream to the next; deletes count against it."""
    from lakeloom.streaming.stateful import stateful_aggregate

    step = lambda s, rows_: (int(s[0] + rows_["_weight"].sum()), int(s[1] + (rows_["v"] * rows_["_weight"]).sum()))
    aggregate = lambda df: stateful_aggregate(df, ["k"], (0, 0), step, lambda s: (s[1] / s[0] if s[0] else None,), "mean double", "n bigint, total bigint")
    schema, got = "k string, v int, _weight int", []
    for name, part in (("a", [("x", 1, 1), ("x", 3, 1), ("y", 5, 1)]), ("b", [("x", 1, -1), ("x", 8, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = aggregate(stream).writeStream.foreachBatch(lambda df, b: got.append(rows(df))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r for r in got if r] == [[("x", 2.0), ("y", 5.0)], [("x", 5.5)]]
    assert rows(aggregate(spark.createDataFrame([("x", 1, 1), ("x", 4, 1)], schema))) == [("x", 2.5)]


def test_initial_load_comes_first(spark, tmp_path):
    """With a trigger that goes on, what is there is taken in before the first checkpoint that goes on; the watermark follows."""
    import time

    (tmp_path / "in").mkdir()
    schema = "k int, v int"
    add = lambda name, *r: spark.createDataFrame(list(r), schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    add("a", (1, 10), (2, 5))
    view = View(spark, f"file://{tmp_path}/s", {"t": ["k"]}, lambda t: t["t"].agg(F.sum("v").alias("s")))
    assert views.offsets(spark, f"file://{tmp_path}/cp") == {}
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = view.start("t", stream, f"file://{tmp_path}/cp", trigger={"processingTime": "200 milliseconds"})
    try:
        assert rows(view.result()) == [(15,)]
        first = views.offsets(spark, f"file://{tmp_path}/cp")
        add("b", (2, 7))
        for _ in range(100):
            if rows(view.result()) == [(17,)]:
                break
            time.sleep(0.3)
        assert rows(view.result()) == [(17,)]
    finally:
        query.stop()
    assert set(first) == {0} and views.offsets(spark, f"file://{tmp_path}/cp") != first


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    """One bucket of a log isn't one task's work, however many rows it has."""
    from lakeloom.streaming.views import State

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "50000")
    try:
        df = State(spark, f"file://{tmp_path}/s").append("rows", 0, spark.range(0, 200_000, 1, 8).selectExpr("id", "xxhash64(id) AS x", "CAST(id % 2 AS INT) AS _bucket"), ["_bucket"])
    finally:
        spark.conf.set(name, before)
    files = list((tmp_path / "s/rows/log/0").glob("_bucket=0/*.parquet"))
    assert len(files) > 2 and df.count() == df.distinct().count() == 200_000
