"""Statements of the SQL dialect."""

import datetime

import pytest

from lakeloom.plans import dialect
from lakeloom.plans.engine import Engine
from lakeloom.sources.registry import Registry


def d(*a):
    return datetime.datetime(2024, 1, 1, *a)


@pytest.fixture
def engine(spark):
    spark.createDataFrame([(1, "Ann", 10, 1), (2, "Bob", None, 1), (3, "Cid", 30, 2)], "id int, name string, visits int, company int").createOrReplaceTempView("users")
    spark.createDataFrame([(1, 1, 5.0, d(0, 7)), (2, 1, 7.0, d(0, 20)), (3, 3, 7.0, d(2, 0))], "key int, user int, money double, at timestamp_ntz").createOrReplaceTempView("orders_t")
    spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent int").createOrReplaceTempView("nodes")
    return Engine(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [
    ("SELECT TOP 2 key, money FROM orders_t ORDER BY money DESC", [(2, 7.0), (3, 7.0)]),
    ("SELECT DISTINCT TOP (1) company FROM users ORDER BY company", [(1,)]),
    ("SELECT id, visits * 2 AS twice FROM users WHERE twice > 20", [(3, 60)]),
    ("SELECT key, row_number() OVER (PARTITION BY user ORDER BY at) AS rn FROM orders_t WHERE rn <= 1", [(1, 1), (3, 1)]),
    ("SELECT company, list_agg(name) AS names, string_agg(name, '/') AS joined, sum0(visits) AS v FROM users GROUP BY company", [(1, ["Ann", "Bob"], "Ann/Bob", 10), (2, ["Cid"], "Cid", 30)]),
    ("SELECT company, count(*) FILTER (WHERE visits > 5) AS n FROM users GROUP BY company HAVING count(*) > 1", [(1, 1)]),
    ("SELECT id FROM users WHERE visits NOT IN (SELECT visits FROM users WHERE id <> 1)", [(1,), (2,)]),
    ("SELECT name FROM users u WHERE EXISTS (SELECT 1 FROM orders_t o WHERE o.user = u.id)", [("Ann",), ("Cid",)]),
    ("SELECT window_start, count(*) AS n FROM orders_t o INNER JOIN tumbling_window(o.at, 15, 'MINUTE') GROUP BY window_start", [(d(0, 0), 1), (d(0, 15), 1), (d(2, 0), 1)]),
    ("SELECT key, window_start FROM orders_t o LEFT JOIN hopping_window(o.at, 10, 'MINUTE', 5, 'MINUTE')", [(1, None), (2, d(0, 20)), (3, d(2, 0))]),
    ("SELECT val FROM UNNEST(list(1, 2)) val", [(1,), (2,)]),
    ("SELECT id, x FROM users LEFT JOIN UNNEST(list(id, visits)) x ON x > 9 WHERE id < 3", [(1, 10), (2, None)]),
    ("SELECT user, count(*) AS n, window_start FROM orders_t GROUP BY user, SESSION(at, 30, 'MINUTE')", [(1, 2, d(0, 7)), (3, 1, d(2, 0))]),
    ("SELECT user, session_end(at, 30, 'MINUTE') AS e FROM orders_t GROUP BY user, SESSION(at, 30, 'MINUTE')", [(1, d(0, 50)), (3, d(2, 30))]),
    ("SELECT key, session_window(10, 'MINUTE') OVER (PARTITION BY user ORDER BY at) AS s FROM orders_t", [(1, d(0, 7)), (2, d(0, 20)), (3, d(2, 0))]),
    ("WITH tree AS (SELECT id, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1 FROM nodes n JOIN tree t ON n.parent = t.id) SELECT id, depth FROM tree", [(1, 0), (2, 1), (3, 2)]),
    ("SELECT company FROM users EXCEPT ALL SELECT company FROM users WHERE id = 1", [(1,), (2,)]),
    ("SELECT company FROM users INTERSECT SELECT 2", [(2,)]),
    ("SELECT id FROM users WHERE name LIKE '[AC]%'", [(1,), (3,)]),
    ("SELECT id, round(2.5D) AS r, len(name) AS l, strpos(name, 'n') AS p, starts_with(name, 'A') AS s FROM users WHERE id = 1", [(1, 2.0, 3, 2, True)]),
    ("SELECT timestamp_add('DAY', 1, at) AS a, datediff('HOUR', at, timestamp_add('MINUTE', 53, at)) AS h, timestamp_extract('HOUR', at) AS x, timestamp_format(at, 'yyyy/MM') AS f FROM orders_t WHERE key = 1", [(datetime.datetime(2024, 1, 2, 0, 7), 1, 0, "2024/01")]),
    ("SELECT key, max_by(key, money) OVER (ORDER BY at) AS best FROM orders_t", [(1, 1), (2, 2), (3, 2)]),
    ("SELECT key, sum(money) OVER (ORDER BY at ROWS 1 PRECEDING) AS s FROM orders_t", [(1, 5.0), (2, 12.0), (3, 14.0)]),
    ("SELECT v.b FROM (VALUES (1, 'x'), (2, 'y')) v(a, b) WHERE v.a = 2", [("y",)]),
    ("SELECT list_first_difference(list(1, 2), list(1, 3)) AS d, list_sort_asc_null_last(list(3, NULL, 1)) AS s", [(2, [1, 3, None])]),
]


@pytest.mark.parametrize("sql, want", CASES, ids=[c[0][:60] for c in CASES])
def test_query(engine, sql, want):
    assert rows(engine.query(sql)) == want


@pytest.mark.parametrize(
    "sql",
    ["SELECT TOP 3 id FROM users", "SELECT count(id) FROM users", "SELECT sum(id) OVER (ORDER BY id RANGE UNBOUNDED PRECEDING) FROM users", "SELECT 1 FROM users NATURAL JOIN nodes", "SELECT id FROM orders_t JOIN tumbling_window(at, 1, 'MONTH')"],
)
def test_refused(engine, sql):
    with pytest.raises(ValueError):
        engine.query(sql)


def test_statements(spark):
    written = {}
    registry = Registry()
    registry.add_source("people", lambda s, name, schema: s.createDataFrame([(1, "x")], schema or "id bigint, name string"))
    registry.add_sink("out.*", lambda s, name, df, key, overwrite: written.update({name: (rows(df), key, overwrite)}))
    e = Engine(spark, registry)
    e.sql(
        """CREATE TABLE people (id INT, name STRING);
        -- a view
        SUBSTREAM one;
        CREATE VIEW upper_people WITH (BUFFERED = true) AS SELECT id, upper(name) AS name FROM people;
        INSERT INTO output PRIMARY KEY (id) SELECT id, name FROM upper_people;
        INSERT OVERWRITE out2 (k) SELECT id FROM upper_people"""
    )
    assert written == {"output": ([(1, "X")], ["id"], False), "out2": ([(1,)], [], True)}
    with pytest.raises(dialect.DialectError):
        e.sql("INSERT INTO output PRIMARY KEY (nope) SELECT id FROM upper_people")


def test_types():
    assert dialect.spark_type("LIST<INT>") == "array<bigint>"
    assert dialect.spark_type("MAP<STRING, DOUBLE>") == "map<string, double>"
    assert dialect.spark_type(None) == "variant"
    assert dialect.spark_type("decimal(10, 2)") == "decimal(10, 2)"


def test_udfs(engine, spark):
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.LongType())
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    @F.pandas_udf(T.DoubleType())
    def middle(x: pd.Series) -> float:
        return float(x.median())

    engine.function("doubled", doubled)
    engine.function("middle", middle)
    assert rows(engine.query("SELECT doubled(id) AS x FROM users")) == [(2,), (4,), (6,)]
    assert rows(engine.query("SELECT middle(id) AS m FROM users")) == [(2.0,)]


def test_data_checks_have_effects(spark):
    engine = Engine(spark)
    spark.createDataFrame([(1, 5, 3), (2, 1, 3), (3, None, 3)], "k int, a int, b int").createOrReplaceTempView("pairs")
    out = engine.sql("SELECT k, CHECK_VALUE(a, a < b, 'a is {a}, b is {b} {c}', a, pairs.b) AS v FROM pairs WHERE k < 3")
    assert rows(out[0]) == [(1, 5), (2, 1)]
    assert [(r["message"], r["tags"]) for r in engine.violations().collect()] == [("a is 5, b is 3 {c}", {"a": "5", "b": "3"})]
    out = engine.sql("SELECT k FROM pairs WHERE CHECK_TRUE(a < b, 'bad {k}', k)")
    assert rows(out[0]) == [(2,)]
    assert sorted(r["message"] for r in engine.violations().collect()) == ["bad 1", "bad 3"]
    engine.sql("WITH big AS (SELECT b, CHECK_VALUE(count(*), count(*) < 3, 'many {b}', b) AS n FROM pairs GROUP BY b) SELECT * FROM big; SELECT k FROM (SELECT k, CHECK_TRUE(k <> 2, 'two') AS ok FROM pairs) WHERE ok")
    assert sorted(r["message"] for r in engine.violations().collect()) == ["many 3", "two"]
    engine.sql("SELECT k FROM pairs")
    assert engine.violations().count() == 0
    with pytest.raises(dialect.DialectError):
        engine.sql("SELECT x.k FROM pairs x JOIN pairs y ON CHECK_TRUE(x.k = y.k, 'no')")


def test_gettimestamp_ticks(spark, tmp_path):
    import datetime

    times = [datetime.datetime(2024, 1, 1, 12, 0)]
    engine = Engine(spark, clock=lambda: times[-1], tick=60)
    read = lambda: engine.query("SELECT gettimestamp() AS now").first()["now"]
    assert read() == times[0] and engine.query("SELECT gettimestamp() AS now").schema["now"].dataType.simpleString() == "timestamp_ntz"
    times.append(times[0] + datetime.timedelta(seconds=59))
    assert read() == times[0]
    times.append(times[0] + datetime.timedelta(seconds=61))
    assert read() == times[2]
    view = engine.maintain("SELECT k FROM due WHERE at <= gettimestamp()", {"due": ["k"]}, f"file://{tmp_path}/v", affected={"due": ["k"]})
    at = lambda s: times[2] + datetime.timedelta(seconds=s)
    view.process(0, {"due": spark.createDataFrame([(1, at(-5)), (2, at(100))], "k int, at timestamp_ntz")})
    assert rows(view.result()) == [(1,)]
    times.append(at(120))
    assert rows(view.process(1, {})) == [(2, 1)] and rows(view.result()) == [(1,), (2,)]
    assert rows(view.process(2, {})) == []


def test_registered_expressions(spark):
    engine = Engine(spark)
    engine.expression("twice_of", lambda x: f"(2 * ({x}))")
    engine.expression("spread_of", lambda a, f: f"(max({a[0]}){f} - min({a[0]}){f})", "aggregate")
    engine.expression("share_of", lambda a, spec: f"({a[0]} / sum({a[0]}) OVER ({spec}))", "window")
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 4)], "g string, n int").createOrReplaceTempView("few")
    assert rows(engine.query("SELECT g, twice_of(spread_of(n) FILTER (WHERE n < 4)) AS s FROM few GROUP BY g")) == [("a", 4), ("b", None)]
    assert rows(engine.query("SELECT g, share_of(n) OVER (PARTITION BY g) AS s FROM few")) == [("a", 0.25), ("a", 0.75), ("b", 1.0)]


def test_window_function_from_python(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def middle(x: pd.Series) -> float:
        return float(x.median())

    engine = Engine(spark)
    engine.function("middle", middle)
    spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 8.0, 3), ("b", 4.0, 1)], "g string, n double, t int").createOrReplaceTempView("few")
    got = rows(engine.query("SELECT g, t, middle(n) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM few"))
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 4.0)]


def test_substreams_are_run_by_name(spark):
    sql = "SELECT 0 AS x; SUBSTREAM one; SELECT 1 AS x; SUBSTREAM two; SELECT 2 AS x"
    xs = lambda e: [df.first()[0] for df in e.sql(sql)]
    assert xs(Engine(spark)) == [0, 1, 2] and xs(Engine(spark, substream="One")) == [0, 1] and xs(Engine(spark, substream="two")) == [0, 2]


def test_hints_reach_the_reader(spark):
    seen = []

    def read(s, name, schema, hints):
        seen.append((name, hints))
        return s.createDataFrame([(1, "x")], "id int, v string")

    engine = Engine(spark, Registry().add_source("hinted.*", read).add_source("plain", lambda s, name, schema: s.createDataFrame([(1,)], "id int")))
    assert rows(engine.query("SELECT h.v FROM hinted_a h WITH (size = 5, mode = 'fast') JOIN plain p ON p.id = h.id")) == [("x",)]
    assert rows(engine.query("SELECT v FROM hinted_b")) == [("x",)]
    assert seen == [("hinted_a", {"size": "5", "mode": "fast"}), ("hinted_b", {})]
