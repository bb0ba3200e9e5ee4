"""Queries over the driver's tables, one or more per operator, with the DuckDB SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import casts, datetimes, lists, math, strings
from lakeloom.operators import aggregates, joins, normalize, recursion, sets, tablefuncs, windows
from lakeloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]):
        """The function gets a loader of tables."""
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# reading, filtering, projecting


@query("SELECT o_orderkey, o_orderkey + o_custkey AS key_sum, upper(o_orderpriority) AS priority, o_totalprice * 0.5 AS discounted FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def filter_project(t):
    o = t("orders").filter((c("o_totalprice") > 100000) & (c("o_orderstatus") != "F"))
    return o.select("o_orderkey", (c("o_orderkey") + c("o_custkey")).alias("key_sum"), F.upper("o_orderpriority").alias("priority"), (c("o_totalprice") * 0.5).alias("discounted"))


@query("SELECT n_nationkey, n_name FROM (SELECT * FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey BETWEEN 2 AND 20) WHERE CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END = 'even'")
def case_in_between(t):
    kind = F.when(c("n_nationkey") % 2 == 0, "even").otherwise("odd")
    return t("nation").filter(c("n_regionkey").isin(1, 3) & c("n_nationkey").between(2, 20) & (kind == "even")).select("n_nationkey", "n_name")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def virtual_table(t):
    return t("region").sparkSession.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT r_name, v.weight FROM region JOIN (VALUES (0, 10), (2, 30)) v(k, weight) ON r_regionkey = v.k")
def values_join(t):
    r = t("region")
    v = r.sparkSession.createDataFrame([(0, 10), (2, 30)], "k int, weight int")
    return r.join(v, r["r_regionkey"] == v["k"]).select("r_name", "weight")


# joins


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def inner_join(t):
    return t("customer").join(t("orders"), c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def left_join(t):
    return t("customer").join(t("orders").filter(c("o_totalprice") > 200000), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 0) c RIGHT JOIN orders ON c_custkey = o_custkey")
def right_join(t):
    return t("customer").filter(c("c_acctbal") > 0).join(t("orders"), c("c_custkey") == c("o_custkey"), "right").select("o_orderkey", "c_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def full_join(t):
    return t("customer").join(t("supplier"), c("c_custkey") == c("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey > o_custkey WHERE l_quantity > 45")
def multi_key_join(t):
    return t("lineitem").filter(c("l_quantity") > 45).join(t("orders"), (c("l_orderkey") == c("o_orderkey")) & (c("l_suppkey") > c("o_custkey"))).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey OR n_name = r_name")
def theta_join(t):
    return t("nation").join(t("region"), (c("n_regionkey") < c("r_regionkey")) | (c("n_name") == c("r_name"))).select("n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(t):
    return t("customer").join(t("orders").filter(c("o_totalprice") > 300000), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(t):
    return t("customer").join(t("orders"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t):
    return t("orders").join(t("customer").filter(c("c_mktsegment") == "BUILDING"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS k FROM customer) WHERE k = s_suppkey)")
def not_in_subquery(t):
    other = t("customer").select(F.when(c("c_custkey") % 2 == 0, c("c_custkey")).alias("k"))
    return joins.not_in(t("supplier"), other, "s_suppkey", "k").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def mark_or_exists(t):
    marked = joins.mark_join(t("customer"), t("orders").filter(c("o_orderstatus") == "F"), [("c_custkey", "o_custkey")])
    return marked.filter((c("c_acctbal") < 0) | c("mark")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_extendedprice BETWEEN p_retailprice AND p_retailprice + 50")
def range_band_join(t):
    p = t("part").select("p_partkey", "p_retailprice", (c("p_retailprice") + 50).alias("hi"))
    return joins.range_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), p, "l_extendedprice", "p_retailprice", "hi", 50.0).select("l_orderkey", "l_linenumber", "p_partkey")


@query(
    """SELECT a.event_id, b.event_type AS start_type, a.value FROM events a JOIN
    (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '0001-01-01') AS ws, event_type FROM events WHERE event_type = 'purchase') b
    ON a.ts >= b.ws AND a.ts < b.ws + INTERVAL 10 MINUTE AND a.value > 50"""
)
def window_band_join(t):
    starts = tablefuncs.tumbling_window(t("events").filter(c("event_type") == "purchase"), "ts", 10, "MINUTE").select(c("window_start").alias("ws"), c("event_type").alias("start_type")).distinct()
    return joins.window_band_join(t("events").filter(c("value") > 50), starts, "ts", "ws", 10, "MINUTE").select("event_id", "start_type", "value")


# aggregates


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship,
    max(l_discount) AS max_discount, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_basic(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("max_discount"), F.count("*").alias("n"))


@query("SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS n, min(l_orderkey) AS least FROM lineitem WHERE l_quantity > 1000")
def agg_global_empty(t):
    return t("lineitem").filter(c("l_quantity") > 1000).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"), F.min("l_orderkey").alias("least"))


@query(
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS closed_sum,
    max(o_orderdate) FILTER (WHERE o_totalprice > 100000) AS last_big FROM orders GROUP BY o_custkey"""
)
def agg_filter(t):
    f = aggregates.filtered
    return t("orders").groupBy("o_custkey").agg(
        aggregates.count_star(c("o_orderstatus") == "O").alias("n_open"), F.round(F.sum(f(c("o_totalprice"), c("o_orderstatus") == "F")), 2).alias("closed_sum"), F.max(f(c("o_orderdate"), c("o_totalprice") > 100000)).alias("last_big")
    )


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def count_distinct(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT n_regionkey, CAST(list_sort(list(n_name)) AS VARCHAR[]) AS names FROM nation GROUP BY n_regionkey")
def list_agg(t):
    return t("nation").groupBy("n_regionkey").agg(aggregates.list_agg(c("n_name")).alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, string_agg(CASE WHEN n_nationkey < 0 THEN n_name END, ',') AS no_names FROM nation GROUP BY n_regionkey")
def string_agg(t):
    return t("nation").groupBy("n_regionkey").agg(aggregates.string_agg(c("n_name"), "; ").alias("names"), aggregates.string_agg(F.when(c("n_nationkey") < 0, c("n_name")), ",").alias("no_names"))


@query("SELECT n_regionkey, list_sort(list_distinct(flatten(list([n_nationkey % 3, n_nationkey % 5])))) AS marks FROM nation GROUP BY n_regionkey")
def list_union_distinct_agg(t):
    return t("nation").groupBy("n_regionkey").agg(aggregates.list_union_distinct(F.array(c("n_nationkey") % 3, c("n_nationkey") % 5)).alias("marks"))


@query(
    """SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey"""
)
def min_by_max_by(t):
    return t("orders").groupBy("o_custkey").agg(aggregates.min_by(c("o_orderkey"), c("o_totalprice")).alias("cheapest"), aggregates.max_by(c("o_orderkey"), c("o_totalprice")).alias("dearest"))


@query("SELECT c_nationkey, coalesce(sum(CASE WHEN c_acctbal > 9900 THEN c_custkey END), 0)::BIGINT AS big FROM customer GROUP BY c_nationkey")
def sum0(t):
    return t("customer").groupBy("c_nationkey").agg(aggregates.sum0(F.when(c("c_acctbal") > 9900, c("c_custkey"))).alias("big"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).filter((c("n") > 12) & (c("m") > 100000)).select("o_custkey", "n")


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS surrogate_key, 1::BIGINT AS n_groups FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def surrogate_key(t):
    """The numbers are 0 to n - 1, each of one group; which group has which is left open."""
    keys = aggregates.surrogate_keys(t("customer"), ["c_nationkey", "c_mktsegment"])
    return keys.groupBy("surrogate_key").agg(F.count_distinct("c_nationkey", "c_mktsegment").alias("n_groups"))


# sets, distinct, top-N


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return sets.combine("union_distinct", t("orders").select("o_orderstatus", "o_orderpriority"))


def _sides(t):
    return t("customer").select((c("c_nationkey") % 7).alias("k")), t("supplier").select((c("s_nationkey") % 9).alias("k"))


_A, _B = "SELECT c_nationkey % 7 AS k FROM customer", "SELECT s_nationkey % 9 AS k FROM supplier"


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    return sets.combine("union_all", *_sides(t))


@query(f"{_A} UNION {_B}")
def union_distinct(t):
    return sets.combine("union_distinct", *_sides(t))


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(t):
    return sets.combine("except_all", *_sides(t))


@query(f"{_B} EXCEPT {_A}")
def except_distinct(t):
    return sets.combine("except_distinct", *reversed(_sides(t)))


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(t):
    return sets.combine("intersect_all", *_sides(t))


@query(f"{_A} INTERSECT {_B}")
def intersect_distinct(t):
    return sets.combine("intersect_distinct", *_sides(t))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 25")
def top_n(t):
    return sets.top_n(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), 25, F.desc("o_totalprice"))


# window functions

_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(t, *rows):
    return windows.window(["user_id"], ["ts", "event_id"], rows[0] if rows else None)


@query(f"SELECT event_id, round(sum(value) OVER ({_W} ROWS UNBOUNDED PRECEDING), 3) AS running FROM events")
def win_running_sum(t):
    return t("events").select("event_id", F.round(F.sum("value").over(_events(t)), 3).alias("running"))


@query(f"SELECT event_id, round(avg(value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS around FROM events")
def win_frame_avg(t):
    return t("events").select("event_id", F.round(F.avg("value").over(_events(t, (-3, 1))), 4).alias("around"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type), 2) AS total FROM events")
def win_whole_partition(t):
    return t("events").select("event_id", F.round(F.sum("value").over(windows.window(["event_type"])), 2).alias("total"))


@query(f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER ({_W.replace('ts, event_id', 'value DESC, event_id')}) AS rn FROM events) WHERE rn <= 1")
def row_number_top1(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t("events").withColumn("rn", F.row_number().over(w)).filter(c("rn") <= 1).select("user_id", "event_id", "value")


@query(f"SELECT event_id, lead(value) OVER ({_W}) AS next_value, lag(value, 2, -1.0::DOUBLE) OVER ({_W}) AS before_last FROM events")
def lead_lag(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lead("value").over(w).alias("next_value"), F.lag("value", 2, -1.0).over(w).alias("before_last"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_click FROM events")
def last_value_ignore_nulls(t):
    return t("events").select("event_id", windows.last_value(F.when(c("event_type") == "click", c("value")), _events(t), True).alias("last_click"))


@query(
    f"""SELECT event_id, arg_min(ts, (value, event_id)) OVER ({_W} ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS low_at,
    arg_max(ts, (value, -event_id)) OVER ({_W} ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS high_at FROM events"""
)
def win_min_by(t):
    e = t("events").select("event_id", "user_id", "ts", "value")
    return windows.sliding_by(e, ["user_id"], ["ts", "event_id"], 364, low_at=("min_by", "ts", "value"), high_at=("max_by", "ts", "value")).select("event_id", "low_at", "high_at")


@query(
    f"""SELECT event_id, arg_min(ts, (value, event_id)) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS low_at,
    arg_max(ts, (value, -event_id)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS high_at FROM events"""
)
def win_min_by_frames(t):
    w, whole = _events(t, (-2, 3)), _events(t)
    return t("events").select("event_id", windows.min_by(c("ts"), c("value"), w, [c("event_id")]).alias("low_at"), windows.max_by(c("ts"), c("value"), whole, [-c("event_id")]).alias("high_at"))


@query(
    """SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS first_of_key, (SELECT count(DISTINCT user_id) FROM events) AS keys_in_all
    FROM events"""
)
def win_surrogate_key(t):
    """Rows have one number if and only if they have one user; numbers are 0 to n - 1."""
    e = windows.surrogate_key(t("events"), ["user_id"], "key")
    per = e.groupBy("key").agg(F.min("event_id").alias("first_of_key"))
    return e.join(per, "key").select("event_id", "first_of_key", (F.lit(e.agg(F.max("key")).first()[0]) + 1).cast("bigint").alias("keys_in_all"))


@query(
    """SELECT event_id, max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_start FROM
    (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, TRUE) AS fresh FROM events)"""
)
def session_assign(t):
    return windows.session_window(t("events"), ["user_id"], "ts", 6 * 3600).select("event_id", "session_start")


@query(
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM
    (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
     (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, TRUE) AS fresh FROM events)) GROUP BY user_id, s"""
)
def session_group(t):
    return windows.session_groups(t("events"), ["user_id"], "ts", "6 hours", F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# table functions


@query(
    """SELECT ws AS window_start, ws + INTERVAL 7 MINUTE AS window_end, event_type, count(*) AS n, max(value) AS highest FROM
    (SELECT *, time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '0001-01-01') AS ws FROM events) GROUP BY ws, event_type"""
)
def tumbling(t):
    return tablefuncs.tumbling_window(t("events"), "ts", 7, "MINUTE").groupBy("window_start", "window_end", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '0001-01-01') AS week, count(*) AS n FROM events GROUP BY 1")
def tumbling_week(t):
    return tablefuncs.tumbling_window(t("events"), "ts", 1, "WEEK").groupBy(c("window_start").alias("week")).agg(F.count("*").alias("n"))


_HOP = "SELECT e.event_id, e.event_type, time_bucket(INTERVAL {h} MINUTE, ts, TIMESTAMP '0001-01-01') - INTERVAL {h} MINUTE * k.k AS ws FROM events e, generate_series(0, {n}) k(k) WHERE e.ts < time_bucket(INTERVAL {h} MINUTE, ts, TIMESTAMP '0001-01-01') - INTERVAL {h} MINUTE * k.k + INTERVAL {s} MINUTE"


@query(f"SELECT ws AS window_start, ws + INTERVAL 25 MINUTE AS window_end, count(*) AS n FROM ({_HOP.format(h=10, s=25, n=2)}) GROUP BY ws")
def hopping(t):
    return tablefuncs.hopping_window(t("events"), "ts", 10, "MINUTE", 25, "MINUTE").groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, ws AS window_start FROM ({_HOP.format(h=60, s=20, n=0)})")
def hopping_gap(t):
    return tablefuncs.hopping_window(t("events"), "ts", 1, "HOUR", 20, "MINUTE").select("event_id", "window_start")


@query("SELECT vec_id, label, x::DOUBLE AS x FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) WHERE x > 0.25")
def unnest_inner(t):
    return tablefuncs.unnest(t("embeddings"), c("embedding"), "x", on=lambda x: x > 0.25).select("vec_id", "label", c("x").cast("double").alias("x"))


@query("SELECT n_name, x FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [n_regionkey, n_nationkey] ELSE [] END) AS x FROM nation) ON k = n_nationkey AND x > 3")
def unnest_left(t):
    items = F.when(c("n_nationkey") % 2 == 0, F.array("n_regionkey", "n_nationkey")).otherwise(F.array().cast("array<int>"))
    return tablefuncs.unnest(t("nation"), items, "x", outer=True, on=lambda x: x > 3).select("n_name", "x")


@query("SELECT n_name, 'region' AS key, n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT n_name, 'nation', n_nationkey::VARCHAR FROM nation")
def unnest_map(t):
    m = F.create_map(F.lit("region"), c("n_regionkey").cast("string"), F.lit("nation"), c("n_nationkey").cast("string"))
    return tablefuncs.unnest(t("nation"), m, "e").select("n_name", "e.key", "e.value")


@query("SELECT unnest([3, 1, NULL]) AS x")
def table_function_root(t):
    return t("region").sparkSession.range(1).select(F.explode(F.array(F.lit(3), F.lit(1), F.lit(None).cast("int"))).alias("x"))


# recursion, change-logs, views


@query(
    """WITH RECURSIVE tree AS (SELECT o_orderkey AS id, 0::BIGINT AS level FROM orders WHERE o_orderkey <= 3
    UNION ALL SELECT o.o_orderkey, tree.level + 1 FROM orders o JOIN tree ON o.o_orderkey // 2 = tree.id AND o.o_orderkey > 3) SELECT id, level FROM tree"""
)
def recursive_tree(t):
    nodes = t("orders").select(c("o_orderkey").alias("id"), F.floor(c("o_orderkey") / 2).alias("parent"))
    start = nodes.filter("id <= 3").select("id", F.lit(0).cast("bigint").alias("level"))
    return recursion.iterate(start, lambda new: nodes.filter("id > 3").join(new.select(c("id").alias("p"), "level"), c("parent") == c("p")).select("id", (c("level") + 1).alias("level")))


@query(
    """WITH RECURSIVE reach AS (SELECT 0::BIGINT AS id UNION SELECT e.b FROM reach JOIN (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 3 + 1)::BIGINT % 25 AS b FROM nation) e ON e.a = reach.id) SELECT id FROM reach"""
)
def recursive_cycle(t):
    edges = t("nation").select(c("n_nationkey").cast("bigint").alias("a"), ((c("n_nationkey") * 3 + 1) % 25).cast("bigint").alias("b"))
    start = t("nation").sparkSession.range(1)
    return recursion.iterate(start, lambda new: edges.join(new, c("a") == c("id")).select(c("b").alias("id")), distinct=True)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def normalize_latest(t):
    e = t("events").select("user_id", "event_id", "event_type", "value", "ts")
    return normalize.latest(e, ["user_id"], F.struct("ts", "event_id"), c("event_type") == "error").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, user_id % 10 AS bucket, (sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END))::INT AS _weight FROM events GROUP BY 1, 2 HAVING sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) <> 0")
def changelog_consolidate(t):
    weight = F.when(c("event_id") % 3 == 0, -1).otherwise(1)
    return normalize.consolidate(t("events").select("event_type", (c("user_id") % 10).alias("bucket"), weight.alias("_weight")))


@query(
    """SELECT n_nationkey, name, (sum(w))::INT AS _weight FROM (SELECT n_nationkey, n_name AS name, -1 AS w FROM nation WHERE n_nationkey < 15
    UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END, 1 FROM nation WHERE n_nationkey >= 5) GROUP BY 1, 2 HAVING sum(w) <> 0"""
)
def changelog_differences(t):
    n = t("nation").select("n_nationkey", c("n_name").alias("name"))
    new = n.filter("n_nationkey >= 5").withColumn("name", F.when(c("n_nationkey") % 4 == 0, F.lower("name")).otherwise(c("name")))
    return normalize.differences(n.filter("n_nationkey < 15"), new)


@query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT c_nationkey, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def cte_view(t):
    big = t("orders").filter(c("o_totalprice") > 150000).select("o_custkey", "o_totalprice")
    return big.join(t("customer"), c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))


# scalar functions


@query(
    """SELECT o_orderkey, o_totalprice::BIGINT - CASE WHEN o_totalprice::BIGINT > o_totalprice THEN 1 ELSE 0 END AS whole, o_orderkey::VARCHAR AS text, try_cast(o_orderpriority[1:1] AS BIGINT) AS priority,
    o_orderkey::DOUBLE AS float, epoch_us(o_orderdate) AS micros, try_cast(o_orderstatus AS BIGINT) AS no_number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, o_orderkey % 2 = 1 AS odd FROM orders"""
)
def cast_matrix(t):
    o = t("orders")
    return o.select(
        "o_orderkey", casts.cast(c("o_totalprice"), "int", "double").alias("whole"), casts.cast(c("o_orderkey"), "string", "bigint").alias("text"), casts.cast(F.substring("o_orderpriority", 1, 1), "int").alias("priority"),
        casts.cast(c("o_orderkey"), "double", "bigint").alias("float"), casts.cast(c("o_orderdate"), "int", "timestamp").alias("micros"), casts.cast(c("o_orderstatus"), "int").alias("no_number"),
        casts.cast(c("o_orderdate"), "string", "timestamp").alias("iso"), casts.cast(c("o_orderkey") % 2, "bool", "bigint").alias("odd"),
    )


@query(
    """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(exp(p_size / 50.0), 6) AS e, round(power(p_size, 2), 6) AS square, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS at,
    abs(p_size - 25) AS distance, sign(p_size - 25)::DOUBLE AS sg, round(log10(p_retailprice), 6) AS lg, round_even(p_retailprice::DOUBLE, 0)::DOUBLE AS even, floor(p_retailprice) AS low, ceil(p_retailprice) AS high,
    round(radians(p_size), 6) AS rad, round(degrees(p_size), 6) AS deg, round(tanh(p_size / 30.0), 6) AS th, greatest(p_size, 25, NULL) AS big, nullif(p_size, 10) AS no10, coalesce(nullif(p_size, 10), -1) AS or1 FROM part"""
)
def math_fns(t):
    r = lambda x: F.round(x, 6)
    size, price = c("p_size"), c("p_retailprice")
    return t("part").select(
        "p_partkey", r(F.sqrt(price)).alias("root"), r(F.exp(size / 50.0)).alias("e"), r(F.pow(size, F.lit(2))).alias("square"), r(F.sin(size)).alias("s"), r(F.atan2(size, F.lit(3))).alias("at"), F.abs(size - 25).alias("distance"),
        F.signum(size - 25).alias("sg"), r(math.log10(price)).alias("lg"), math.round_even(price).alias("even"), math.floor(price).alias("low"), math.ceil(price).alias("high"), r(F.radians(size)).alias("rad"), r(F.degrees(size)).alias("deg"),
        r(F.tanh(size / 30.0)).alias("th"), F.greatest(size, F.lit(25), F.lit(None).cast("int")).alias("big"), F.nullif(size, F.lit(10)).alias("no10"), F.coalesce(F.nullif(size, F.lit(10)), F.lit(-1)).alias("or1"),
    )


@query(
    """SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN CASE WHEN n_nationkey = 0 THEN 'nan' ELSE 'inf' END ELSE round(n_nationkey::DOUBLE / n_regionkey, 6)::VARCHAR END IS NOT NULL AS has,
    n_regionkey = 0 AND n_nationkey > 0 AS infinite, n_regionkey = 0 AND n_nationkey = 0 AS nan, CASE WHEN n_regionkey > 0 THEN (n_nationkey % n_regionkey)::DOUBLE END AS rest FROM nation"""
)
def divide_by_zero(t):
    q, m = math.divide(c("n_nationkey"), c("n_regionkey")), math.modulo(c("n_nationkey"), c("n_regionkey"))
    return t("nation").select("n_nationkey", q.isNotNull().alias("has"), math.is_infinite(q).alias("infinite"), math.is_nan(q).alias("nan"), F.when(~math.is_nan(m), m).alias("rest"))


@query(
    """SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed, length(c_name) AS len, strpos(c_name, '#') AS at, substring(c_name, 3, 4) AS part, replace(c_name, '0', 'o') AS replaced,
    starts_with(c_name, 'Customer#0000') AS starts, c_name || ':' || c_custkey AS joined, base64(encode(c_name)) AS b64, string_split(c_name, '#') AS parts, c_mktsegment LIKE '%B_IL%' AS matches, array_to_string(['x', c_mktsegment], '-') AS dashed FROM customer"""
)
def string_fns(t):
    n, m = c("c_name"), c("c_mktsegment")
    return t("customer").select(
        "c_custkey", F.lower(n).alias("low"), F.upper(m).alias("up"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.char_length(n).cast("bigint").alias("len"), strings.strpos(n, F.lit("#")).cast("bigint").alias("at"),
        strings.substring(n, F.lit(3), F.lit(4)).alias("part"), F.replace(n, F.lit("0"), F.lit("o")).alias("replaced"), strings.starts_with(n, F.lit("Customer#0000")).alias("starts"), F.concat(n, F.lit(":"), c("c_custkey")).alias("joined"),
        strings.base64_encode(n).alias("b64"), strings.split(n, "#").alias("parts"), strings.like(m, "%B_IL%").alias("matches"), strings.join(F.lit("-"), F.array(F.lit("x"), m, F.lit(None).cast("string"))).alias("dashed"),
    )


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3][^5]$') AS in_set, p_type LIKE '%!_%' ESCAPE '!' AS escaped, NOT (p_name LIKE '%a') AS no_a FROM part")
def like_escape(t):
    return t("part").select("p_partkey", strings.like(c("p_brand"), "Brand#[1-3][^5]").alias("in_set"), strings.like(c("p_type"), "%!_%", "!").alias("escaped"), (~strings.like(c("p_name"), "%a")).alias("no_a"))


@query(
    """SELECT event_id, date_diff('year', TIMESTAMP '2023-12-31 23:59:59', ts) AS years, date_diff('quarter', TIMESTAMP '2023-12-31 23:59:59', ts) AS quarters, date_diff('month', TIMESTAMP '2023-12-31 23:59:59', ts) AS months,
    date_diff('day', TIMESTAMP '2023-12-31 23:59:59', ts) AS days, date_diff('hour', TIMESTAMP '2023-12-31 23:59:59', ts) AS hours, date_diff('minute', TIMESTAMP '2023-12-31 23:59:59', ts) AS minutes,
    date_diff('second', TIMESTAMP '2023-12-31 23:59:59', ts) AS seconds, date_diff('week', TIMESTAMP '2023-12-31 23:59:59' + INTERVAL 1 DAY, ts + INTERVAL 1 DAY) AS weeks FROM events"""
)
def datediff_boundary(t):
    a = F.lit("2023-12-31 23:59:59").cast("timestamp_ntz")
    return t("events").select("event_id", *[datetimes.diff(p, a, c("ts")).alias(p.lower() + "s") for p in ("YEAR", "QUARTER", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "WEEK")])


@query(
    """SELECT event_id, year(ts) AS year, isoyear(ts) AS iso_year, quarter(ts) AS quarter, month(ts) AS month, day(ts) AS day, dayofyear(ts) AS day_of_year, isodow(ts) AS monday_day_of_week, dayofweek(ts) + 1 AS sunday_day_of_week,
    week(ts) AS iso_week, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, strftime(ts, '%W')::BIGINT AS monday_week, strftime(ts, '%U')::BIGINT AS sunday_week,
    year(date_trunc('week', ts + INTERVAL 1 DAY) + INTERVAL 2 DAY) AS us_year, (dayofyear(date_trunc('week', ts + INTERVAL 1 DAY) + INTERVAL 2 DAY) - 1) // 7 + 1 AS us_week FROM events"""
)
def timestamp_extract(t):
    parts = "YEAR ISO_YEAR QUARTER MONTH DAY DAY_OF_YEAR MONDAY_DAY_OF_WEEK SUNDAY_DAY_OF_WEEK ISO_WEEK HOUR MINUTE SECOND MONDAY_WEEK SUNDAY_WEEK US_YEAR US_WEEK".split()
    return t("events").select("event_id", *[datetimes.extract(p, c("ts")).alias(p.lower()) for p in parts])


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 6 MONTH AS q, o_orderdate - INTERVAL 1 MONTH AS m, o_orderdate + INTERVAL 14 DAY AS w, o_orderdate + INTERVAL 90 MINUTE AS mi, date_trunc('day', o_orderdate + INTERVAL 30 HOUR) AS d FROM orders")
def timestamp_add(t):
    d = c("o_orderdate")
    add = lambda p, n: datetimes.add(p, F.lit(n), d)
    return t("orders").select("o_orderkey", add("YEAR", 1).alias("y"), add("QUARTER", 2).alias("q"), add("MONTH", -1).alias("m"), add("WEEK", 2).alias("w"), add("MINUTE", 90).alias("mi"), datetimes.floor_day(add("HOUR", 30)).cast("timestamp_ntz").alias("d"))


@query(
    """SELECT event_id, date_trunc('year', ts) + INTERVAL 4 MONTH * ((month(ts) - 1) // 4) AS third, time_bucket(INTERVAL 6 HOUR, ts, date_trunc('day', ts)) + INTERVAL 6 HOUR AS next6,
    CASE WHEN epoch_us(ts) % 900000000 < 450000000 THEN time_bucket(INTERVAL 15 MINUTE, ts, date_trunc('hour', ts)) ELSE time_bucket(INTERVAL 15 MINUTE, ts, date_trunc('hour', ts)) + INTERVAL 15 MINUTE END AS nearest FROM events"""
)
def round_calendar(t):
    r = lambda *a: datetimes.round_calendar(c("ts"), *a)
    return t("events").select("event_id", r("FLOOR", "MONTH", "YEAR", 4).alias("third"), r("CEIL", "HOUR", "DAY", 6).alias("next6"), r("ROUND_TIE_UP", "MINUTE", "HOUR", 15).alias("nearest"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, strftime(ts, '%d.%m.%y %I:%M %p') AS b, date_trunc('day', ts) AS parsed FROM events")
def timestamp_format_parse(t):
    day = datetimes.format(c("ts"), "yyyy-MM-dd")
    return t("events").select("event_id", datetimes.strftime(datetimes.micros(c("ts")), "%Y/%m/%d %H:%M:%S").alias("a"), datetimes.format(c("ts"), "dd.MM.yy hh:mm tt").alias("b"), datetimes.parse(day, "yyyy-MM-dd").cast("timestamp_ntz").alias("parsed"))


@query("SELECT n_nationkey, list_sort([n_regionkey, NULL, n_nationkey], 'ASC', 'NULLS LAST') AS sorted, CASE WHEN n_nationkey <> n_regionkey THEN n_nationkey END AS first_difference FROM nation")
def list_sort(t):
    a = F.array(c("n_regionkey"), F.lit(None).cast("int"), c("n_nationkey"))
    return t("nation").select("n_nationkey", lists.sort_asc_null_last(a).alias("sorted"), lists.first_difference(F.array(F.lit(1), c("n_nationkey")), F.array(F.lit(1), c("n_regionkey"))).alias("first_difference"))


@query("SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json, n_name AS back FROM nation")
def json_roundtrip(t):
    j = strings.to_json(F.struct(c("n_nationkey").alias("key"), c("n_name").alias("name")))
    return t("nation").select("n_nationkey", j.alias("json"), strings.from_json(j, "key int, name string")["name"].alias("back"))


@query("SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE value > 10 END AS a, user_id IS DISTINCT FROM 7 AS other, event_type IS NOT NULL AND (value > 90 OR event_type = 'click') AS kleene, (value > 50) <> (user_id % 2 = 0) AS either FROM events")
def boolean_logic(t):
    return t("events").select(
        "event_id", F.when(c("value") > 50, None).otherwise(c("value") > 10).alias("a"), (~c("user_id").eqNullSafe(7)).alias("other"), (c("event_type").isNotNull() & ((c("value") > 90) | (c("event_type") == "click"))).alias("kleene"),
        math.xor(c("value") > 50, c("user_id") % 2 == 0).alias("either"),
    )


@query("SELECT n_nationkey, n_nationkey AS a, n_regionkey AS b FROM nation")
def nested_values(t):
    s = F.named_struct(F.lit("a"), c("n_nationkey"), F.lit("m"), F.create_map(F.lit("b"), c("n_regionkey")))
    return t("nation").withColumn("s", s).select("n_nationkey", "s.a", c("s")["m"]["b"].alias("b"))


# shapes of the streaming benchmark, on events (bids), orders (auctions) and customers (persons)


@query("SELECT event_id, user_id, ts, value FROM events")
def nexmark_q0(t):
    return t("events").select("event_id", "user_id", "ts", "value")


@query("SELECT event_id, user_id, round(0.908 * value, 6) AS value, ts FROM events")
def nexmark_q1(t):
    return t("events").select("event_id", "user_id", F.round(0.908 * c("value"), 6).alias("value"), "ts")


@query("SELECT event_id, value FROM events WHERE event_id % 123 = 0")
def nexmark_q2(t):
    return t("events").filter(c("event_id") % 123 == 0).select("event_id", "value")


@query("SELECT c_name, n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND n_regionkey IN (0, 2)")
def nexmark_q3(t):
    o, n = t("orders").filter(c("o_orderpriority") == "1-URGENT"), t("nation").filter(c("n_regionkey").isin(0, 2))
    return o.join(t("customer"), c("o_custkey") == c("c_custkey")).join(n, c("c_nationkey") == c("n_nationkey")).select("c_name", "n_name", "o_orderkey")


@query("SELECT priority, round(avg(final), 4) AS average FROM (SELECT o_orderkey, o_orderpriority AS priority, max(l_extendedprice) AS final FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey, o_orderpriority) GROUP BY priority")
def nexmark_q4(t):
    j = t("orders").join(t("lineitem"), (c("l_orderkey") == c("o_orderkey")) & c("l_shipdate").between(c("o_orderdate"), c("o_orderdate") + F.expr("INTERVAL 60 DAYS")))
    return j.groupBy("o_orderkey", c("o_orderpriority").alias("priority")).agg(F.max("l_extendedprice").alias("final")).groupBy("priority").agg(F.round(F.avg("final"), 4).alias("average"))


_Q5 = f"SELECT ws, event_type, count(*) AS n FROM ({_HOP.format(h=360, s=1440, n=3)}) GROUP BY ws, event_type"


@query(f"SELECT event_type, ws AS window_start, n FROM (SELECT *, max(n) OVER (PARTITION BY ws) AS most FROM ({_Q5})) WHERE n >= most")
def nexmark_q5(t):
    counts = tablefuncs.hopping_window(t("events"), "ts", 6, "HOUR", 24, "HOUR").groupBy("window_start", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("most", F.max("n").over(Window.partitionBy("window_start"))).filter("n >= most").select("event_type", "window_start", "n")


@query(
    """SELECT l_suppkey, l_orderkey, sum(cents) OVER w / (100.0::DOUBLE * count(*) OVER w) AS average FROM
    (SELECT l_suppkey, l_orderkey, l_shipdate, round(l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 1
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""
)
def nexmark_q6(t):
    """Whole cents are summed, so the average is the same whatever the order of additions."""
    best = t("lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))).filter("rn <= 1")
    w = windows.window(["l_suppkey"], ["l_shipdate", "l_orderkey"], (-10, 0))
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    return best.select("l_suppkey", "l_orderkey", (F.sum(cents).over(w) / (100.0 * F.count("*").over(w))).alias("average"))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '0001-01-01') AS ws, max(value) AS highest FROM events GROUP BY 1)
    SELECT e.event_id, e.user_id, e.value, e.ts, w.ws + INTERVAL 10 MINUTE AS window_end FROM events e JOIN w ON e.value = w.highest AND e.ts BETWEEN w.ws AND w.ws + INTERVAL 10 MINUTE - INTERVAL 1 MICROSECOND"""
)
def nexmark_q7(t):
    highest = tablefuncs.tumbling_window(t("events"), "ts", 10, "MINUTE").groupBy("window_start", "window_end").agg(F.max("value").alias("highest"))
    return joins.window_band_join(t("events"), highest, "ts", "window_start", 10, "MINUTE", c("value") == c("highest")).select("event_id", "user_id", "value", "ts", "window_end")


@query(
    """SELECT DISTINCT p.user_id, p.ws AS window_start FROM (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '0001-01-01') AS ws FROM events WHERE event_type = 'signup') p
    JOIN (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '0001-01-01') AS ws FROM events WHERE event_type <> 'signup') a ON p.user_id = a.user_id AND p.ws = a.ws"""
)
def nexmark_q8(t):
    e = tablefuncs.tumbling_window(t("events"), "ts", 12, "HOUR")
    new, active = e.filter(c("event_type") == "signup"), e.filter(c("event_type") != "signup")
    return new.select("user_id", "window_start").distinct().join(active.select("user_id", "window_start"), ["user_id", "window_start"], "left_semi")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def smoke_count_by_flag(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
