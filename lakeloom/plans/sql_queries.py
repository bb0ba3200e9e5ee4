"""Queries in the SQL dialect, and views maintained from changes, with the DuckDB SQL that they equal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import checks, hashing, strings
from lakeloom.operators import joins, sets
from lakeloom.operators.recursion import shared_folder
from lakeloom.plans import queries, samples, substrait
from lakeloom.plans.engine import Engine
from lakeloom.session import register, settings_kept, table
from lakeloom.sources import permissions
from lakeloom.sources.registry import Registry
from lakeloom.streaming.stateful import stateful_aggregate
from lakeloom.streaming.views import KeyedSink, View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
_BUCKET = "time_bucket(INTERVAL {n} MINUTE, ts, TIMESTAMP '0001-01-01')"


def _sql(name: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings") if t in text])
        with settings_kept(spark):
            return Engine(spark).query(text)

    QUERIES[name], ORACLES[name] = run, oracle


_sql("sql_top", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql(
    "sql_alias_in_where",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE rn <= 2 AND event_id > 0",
    "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rn FROM events WHERE event_id > 0) WHERE rn <= 2",
)
_sql(
    "sql_aggregates",
    "SELECT c_nationkey, list_agg(c_mktsegment) AS segments, string_agg(c_mktsegment, '|') AS joined, sum0(c_custkey) FILTER (WHERE c_acctbal < 0) AS poor, min_by(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, list_sort(list(c_mktsegment)) AS segments, string_agg(c_mktsegment, '|' ORDER BY c_mktsegment) AS joined, coalesce(sum(c_custkey) FILTER (WHERE c_acctbal < 0), 0)::BIGINT AS poor, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey",
)
_sql(
    "sql_tumbling",
    "SELECT window_start, window_end, count(*) AS n FROM events e INNER JOIN tumbling_window(e.ts, 30, 'MINUTE') GROUP BY window_start, window_end",
    f"SELECT {_BUCKET.format(n=30)} AS window_start, {_BUCKET.format(n=30)} + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM events GROUP BY 1, 2",
)
_sql(
    "sql_hopping_left",
    "SELECT event_id, window_start FROM events e LEFT JOIN hopping_window(e.ts, 60, 'MINUTE', 20, 'MINUTE')",
    f"SELECT event_id, CASE WHEN ts < {_BUCKET.format(n=60)} + INTERVAL 20 MINUTE THEN {_BUCKET.format(n=60)} END AS window_start FROM events",
)
_sql(
    "sql_session",
    "SELECT user_id, window_start, count(*) AS n FROM events GROUP BY user_id, SESSION(ts, 6, 'HOUR')",
    """SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, TRUE) AS fresh FROM events)) GROUP BY user_id, s""",
)
_sql(
    "sql_recursive",
    "WITH tree AS (SELECT n_nationkey, 0 AS depth FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN tree t ON n.n_nationkey = 2 * t.n_nationkey OR n.n_nationkey = 2 * t.n_nationkey + 1) SELECT n_nationkey, depth FROM tree",
    "WITH RECURSIVE tree AS (SELECT n_nationkey, 0 AS depth FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN tree t ON n.n_nationkey = 2 * t.n_nationkey OR n.n_nationkey = 2 * t.n_nationkey + 1) SELECT n_nationkey, depth FROM tree",
)
_sql(
    "sql_views",
    """CREATE VIEW urgent WITH (BUFFERED = true) AS SELECT o_custkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '[12]%';
    SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM urgent u JOIN customer c ON u.o_custkey = c.c_custkey WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_mktsegment""",
    "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority[1:1] IN ('1', '2') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_mktsegment",
)
_sql(
    "sql_unnest",
    "SELECT n_name, x FROM nation LEFT JOIN UNNEST(list(n_regionkey, n_nationkey)) x ON x > 20",
    "SELECT n_name, x FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest([n_regionkey, n_nationkey]) AS x FROM nation) ON k = n_nationkey AND x > 20",
)
_sql(
    "sql_dates",
    "SELECT o_orderkey, timestamp_add('MONTH', 2, o_orderdate) AS later, datediff('WEEK', o_orderdate, timestamp_add('DAY', 30, o_orderdate)) AS weeks, timestamp_extract('ISO_WEEK', o_orderdate) AS iso, timestamp_format(o_orderdate, 'yyyy-MM') AS month, round_calendar(o_orderdate, 'FLOOR', 'MONTH', 'YEAR', 3) AS quarter FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH AS later, (floor(((o_orderdate + INTERVAL 30 DAY)::DATE - DATE '1970-01-04') / 7.0) - floor((o_orderdate::DATE - DATE '1970-01-04') / 7.0))::BIGINT AS weeks, week(o_orderdate)::INTEGER AS iso, strftime(o_orderdate, '%Y-%m') AS month, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter FROM orders",
)


# the same functions in SQL as in the frames of `queries`, against the same DuckDB SQL
_D = "TIMESTAMP_NTZ '2023-12-31 23:59:59'"
_sql("sql_datediff", f"SELECT event_id, {', '.join(f"datediff('{p}', {_D}, ts) AS {p.lower()}s" for p in 'YEAR QUARTER MONTH DAY HOUR MINUTE SECOND WEEK'.split())} FROM events", queries.ORACLES["datediff_boundary"])
_sql(
    "sql_timestamp_extract",
    f"SELECT event_id, {', '.join(f"timestamp_extract('{p}', ts) AS {p.lower()}" for p in 'YEAR ISO_YEAR QUARTER MONTH DAY DAY_OF_YEAR MONDAY_DAY_OF_WEEK SUNDAY_DAY_OF_WEEK ISO_WEEK HOUR MINUTE SECOND MONDAY_WEEK SUNDAY_WEEK US_YEAR US_WEEK'.split())} FROM events",
    queries.ORACLES["timestamp_extract"],
)
_sql(
    "sql_timestamp_add",
    """SELECT o_orderkey, timestamp_add('YEAR', 1, o_orderdate) AS y, timestamp_add('QUARTER', 2, o_orderdate) AS q, timestamp_add('MONTH', -1, o_orderdate) AS m, timestamp_add('WEEK', 2, o_orderdate) AS w,
    timestamp_add('MINUTE', 90, o_orderdate) AS mi, floor_timestamp_day(timestamp_add('HOUR', 30, o_orderdate)) AS d FROM orders""",
    queries.ORACLES["timestamp_add"],
)
_sql(
    "sql_round_calendar",
    "SELECT event_id, round_calendar(ts, 'FLOOR', 'MONTH', 'YEAR', 4) AS third, round_calendar(ts, 'CEIL', 'HOUR', 'DAY', 6) AS next6, round_calendar(ts, 'ROUND_TIE_UP', 'MINUTE', 'HOUR', 15) AS nearest FROM events",
    queries.ORACLES["round_calendar"],
)
_sql(
    "sql_format_parse",
    "SELECT event_id, strftime(unix_micros(CAST(ts AS TIMESTAMP)), '%Y/%m/%d %H:%M:%S') AS a, timestamp_format(ts, 'dd.MM.yy hh:mm tt') AS b, CAST(timestamp_parse(timestamp_format(ts, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS TIMESTAMP_NTZ) AS parsed FROM events",
    queries.ORACLES["timestamp_format_parse"],
)
_sql(
    "sql_string_functions",
    """SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed, len(c_name) AS len, strpos(c_name, '#') AS at, substring(c_name, 3, 4) AS part, replace(c_name, '0', 'o') AS replaced,
    starts_with(c_name, 'Customer#0000') AS starts, c_name || ':' || c_custkey AS joined, string_base64_encode(c_name) AS b64, string_split(c_name, '#') AS parts, c_mktsegment LIKE '%B_IL%' AS matches, string_join('-', list('x', c_mktsegment, NULL)) AS dashed FROM customer""",
    queries.ORACLES["string_fns"],
)
_sql("sql_like", "SELECT p_partkey, p_brand LIKE 'Brand#[1-3][^5]' AS in_set, p_type LIKE '%!_%' ESCAPE '!' AS escaped, NOT (p_name LIKE '%a') AS no_a FROM part", queries.ORACLES["like_escape"])
_sql(
    "sql_lists",
    "SELECT n_nationkey, list_sort_asc_null_last(list(n_regionkey, NULL, n_nationkey)) AS sorted, list_first_difference(list(1, n_nationkey), list(1, n_regionkey)) AS first_difference FROM nation",
    queries.ORACLES["list_sort"],
)
_sql("sql_comma_join", "SELECT n_name, r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> n.n_name", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> n_name")
_sql("sql_without_from", "SELECT 1 + 1 AS two, 'x' AS letter", "SELECT 2 AS two, 'x' AS letter")
_sql("sql_limit", "SELECT o_orderkey, twice FROM (SELECT o_orderkey, o_custkey * 2 AS twice FROM orders WHERE o_custkey > 5) d ORDER BY twice DESC, o_orderkey LIMIT 40", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders WHERE o_custkey > 5 ORDER BY twice DESC, o_orderkey LIMIT 40")
_sql("sql_values", "SELECT n_name, v.col2 AS label FROM nation n JOIN (VALUES (1, 'one'), (2, 'two')) v ON v.col1 = n.n_regionkey", "SELECT n_name, label FROM nation JOIN (VALUES (1, 'one'), (2, 'two')) v(k, label) ON k = n_regionkey")
_sql(
    "sql_strings",
    "SELECT c_custkey, to_string(c_acctbal) AS shown, to_string(c_custkey % 2 * 1.5) AS half, regexp_string_split(c_name, '[#_ ]') AS parts, string_join('-', list(c_name, NULL, c_mktsegment)) AS joined FROM customer",
    "SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN floor(c_acctbal)::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS shown, CASE WHEN c_custkey % 2 = 0 THEN '0.0' ELSE '1.5' END AS half, regexp_split_to_array(c_name, '[#_ ]') AS parts, c_name || '-' || c_mktsegment AS joined FROM customer",
)
_CHECKED = """SELECT check_value(c_acctbal, c_acctbal >= 0, 'balance of {c_custkey} is negative', c_custkey) AS balance FROM customer WHERE CHECK_TRUE(c_nationkey % 2 = 0, 'odd nation of {c_custkey}', c_custkey);
WITH small AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey)
SELECT nation, CHECK_VALUE(max(n), max(n) % 2 = 0, 'nation {nation}: odd', nation) AS n FROM small WHERE nation > 3 GROUP BY nation"""
_sql(
    "sql_check_values",
    _CHECKED.split(";")[0],
    "SELECT c_acctbal AS balance FROM customer WHERE c_nationkey % 2 = 0",
)


def _add(oracle: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return take


def _batches(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    part = F.pmod(c(key), F.lit(n))
    return [df.filter(part == i) for i in range(n)]


@_add("SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 GROUP BY c_nationkey")
def maintained_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and aggregate kept up to date over four batches, one of them deletes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    def build(t: dict[str, DataFrame]) -> DataFrame:
        return t["orders"].join(t["customer"], c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))

    view = View(spark, f"{shared_folder(spark)}/view-{uuid.uuid4().hex}", {"orders": ["o_orderkey"], "customer": ["c_custkey"]}, build)
    for i, part in enumerate(_batches(orders, "o_orderkey", 2)):
        view.process(i, {"orders": part} | ({"customer": customers} if i == 0 else {}))
    view.process(2, {"orders": orders.filter("o_orderkey % 7 = 0").withColumn("gone", F.lit(True))}, deleted="gone")
    return view.result()


@_add("SELECT user_id, count(*) AS n, max(value) AS most FROM events WHERE event_id % 5 <> 1 GROUP BY user_id")
def maintained_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the users that a batch touches are recomputed; the sink follows the output changes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    folder = f"{shared_folder(spark)}/view-{uuid.uuid4().hex}"
    view = View(spark, f"{folder}/state", {"events": None}, lambda t: t["events"].groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most")), affected={"events": ["user_id"]})
    sink = KeyedSink(spark, f"{folder}/sink", ["user_id"])
    steps = [events.withColumn("_weight", F.lit(1)), events.filter("event_id % 5 = 1").withColumn("_weight", F.lit(-1))]
    for i, step in enumerate(steps):
        sink(view.process(i, {"events": step}), i)
    return sink.rows()


@_add("SELECT n_nationkey, n_name FROM nation")
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = joins.exchange(table(spark, sf_dir, "nation"), "scatter", ["n_regionkey"], 4)
    r = joins.exchange(table(spark, sf_dir, "region"), "broadcast")
    return joins.exchange(n.join(r, c("n_regionkey") == c("r_regionkey")), "single").select("n_nationkey", "n_name")


@_add("SELECT 'check_0' AS check, 'balance of ' || c_custkey || ' is negative' AS message FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'check_1', 'odd nation' FROM customer WHERE c_nationkey % 2 = 1")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = checks.Checks()
    rules.value(c("c_acctbal"), c("c_acctbal") >= 0, "balance of {key} is negative", key=c("c_custkey"))
    rules.true(c("c_nationkey") % 2 == 0, "odd nation")
    return rules.violations(table(spark, sf_dir, "customer")).select("check", "message")


@_add(
    """SELECT 'odd nation of ' || c_custkey AS message, c_custkey::VARCHAR AS who FROM customer WHERE c_nationkey % 2 = 1
    UNION ALL SELECT 'balance of ' || c_custkey || ' is negative', c_custkey::VARCHAR FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal < 0
    UNION ALL SELECT 'nation ' || c_nationkey || ': odd', c_nationkey::VARCHAR FROM customer WHERE c_acctbal < 0 AND c_nationkey > 3 GROUP BY c_nationkey HAVING count(*) % 2 = 1"""
)
def sql_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and groups that fail the data checks of two statements."""
    register(spark, sf_dir, ["customer"])
    with settings_kept(spark):
        engine = Engine(spark)
        engine.sql(_CHECKED)
        return engine.violations().select("message", F.map_values("tags")[0].alias("who"))


@_add("SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '1998-09-02')::BIGINT AS days FROM orders WHERE o_orderdate <= TIMESTAMP '1998-09-02 10:00:00'")
def sql_gettimestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's clock is set; the second reading is within the tick, so the first counts."""
    register(spark, sf_dir, ["orders"])
    times = iter([datetime(1998, 9, 2, 10), datetime(1998, 9, 2, 10, 59)])
    with settings_kept(spark):
        engine = Engine(spark, clock=lambda: next(times))
        engine.now()
        return engine.query("SELECT o_orderkey, datediff('DAY', o_orderdate, gettimestamp()) AS days FROM orders WHERE o_orderdate <= gettimestamp()")


@_add("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS id FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def guid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("c_custkey") % 2 == 0, F.upper(F.md5("c_name"))).otherwise(c("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.guid(text).alias("id"))


#: Of each nation, by the xxhash library over (key as eight bytes, name) and name.
_HASHES = """(VALUES
    (0, 966995755627709633, '57388591-5342-67c2-0225-37ac7cc2486e'), (1, 189211655109771075, '46d2fe89-e446-c6be-b699-33aec6e1d045'), (2, 3787162612412228283, 'f5fc8c97-2b80-f7f6-7e8d-5949a9b12f72'),
    (3, -7987879249090914122, 'd185b5ec-6e98-6421-3625-c2210aba0c5f'), (4, 1362285735966043858, '5a02605c-d139-a074-bffd-5d1430a7699e'), (5, -1074104026076079642, '86379d16-53a4-222d-5f2c-ec7345dd89de'),
    (6, -3101446423778394399, '58b6c8e1-b1ae-8da8-a185-2cc9159f5fe5'), (7, -2201725399339888515, '4546574d-9f1a-3352-5fa5-b43380d211af'), (8, 7860267570494139788, 'd7518bf6-2536-e697-1e30-86876d232517'),
    (9, -5887332904866116552, '1a29715b-e0e5-dc31-a2e5-78d74987b04e'), (10, -5880855144029854532, '1aafc172-c291-42eb-7e25-49f71b0297ea'), (11, 4935735730532634448, 'd42572af-2a14-81e7-c3bf-84bea66969bd'),
    (12, 1385475138448811901, '77e906d9-93b4-ab83-df7e-7d996f9b0ec1'), (13, 5296532487749057411, '7e29ef6c-1a0e-5132-82e3-77bb4ae02045'), (14, 1239304341873766905, '0e7e7d2b-17d1-2756-8389-0abbc3d10ad2'),
    (15, 3065105854610438564, 'a6614ccd-bbbf-3b3c-1ba9-647beecebf58'), (16, -5922895969324411908, '45230d82-4df6-70d8-fca8-d29354a626b9'), (17, -5670404874411111689, 'b15cebd4-cd5d-effd-6505-87eb1050acfd'),
    (18, -7528471689064576088, '83fa8e4e-7d04-5a2f-6da8-2c64e6796536'), (19, 1793948990928197205, '1c69aa16-4d4f-bbfd-aff1-db0db5671b80'), (20, -3533706489213486840, '2ea0026d-b494-d8de-0cc2-595b6a502856'),
    (21, -8403562760122534551, '3c00c7d5-8ee1-afc6-5907-93253ee86b14'), (22, 8019573985568990467, 'aa0f82a7-09de-e3f5-03b9-3e3e55539602'), (23, -6170266130693923132, '20d04a83-b3e9-26d7-6899-93eae842c910'),
    (24, 6186681733773701731, 'd8b494f9-a0c7-85f0-3e64-833800f4161a')
)"""


@_add(f"SELECT n.n_nationkey, h64::BIGINT AS h64, h128 FROM nation n LEFT JOIN {_HASHES} h(k, h64, h128) ON n.n_nationkey = k")
def hash_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-exact hashes."""
    return table(spark, sf_dir, "nation").select("n_nationkey", hashing.xxhash64(c("n_nationkey").cast("bigint"), c("n_name")).alias("h64"), hashing.xxhash128_guid(c("n_name")).alias("h128"))


@_add(
    """WITH RECURSIVE m AS (SELECT o_orderkey AS g, o_custkey AS u FROM orders
    UNION SELECT p.o_orderkey // 2, m.u FROM m JOIN orders p ON p.o_orderkey = m.g WHERE m.g // 2 >= 1)
    SELECT g::VARCHAR AS object_id, 'user' AS subject_type, u::VARCHAR AS subject_id FROM m"""
)
def permission_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups that are members of groups: half of an order's key is its parent group."""
    o = table(spark, sf_dir, "orders")
    row = lambda obj, kind, sub, rel: o.select(F.lit("group").alias("object_type"), obj.cast("string").alias("object_id"), F.lit("member").alias("relation"), F.lit(kind).alias("subject_type"), sub.cast("string").alias("subject_id"), F.lit(rel).cast("string").alias("subject_relation"))
    parents = row(F.floor(c("o_orderkey") / 2), "group", c("o_orderkey"), "member").filter("object_id >= 1")
    return permissions.materialize_permission(row(c("o_orderkey"), "user", c("o_custkey"), None).unionByName(parents), {}, "group", "member")


@_add("SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS total, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey > 3 AND o_orderkey % 9 <> 0 GROUP BY o_custkey HAVING count(*) > 2")
def incremental_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL that is maintained from the changes alone, over three batches; the last one deletes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    with settings_kept(spark):
        sql = "SELECT o.o_custkey AS o_custkey, count(*) AS n, sum(o.o_orderkey) AS total, max(o_totalprice) AS most FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_nationkey > 3 GROUP BY o.o_custkey HAVING count(*) > 2"
        view = Engine(spark).maintain(sql, {"orders": ["o_orderkey"], "customer": ["c_custkey"]}, f"{shared_folder(spark)}/view-{uuid.uuid4().hex}")
        for i, part in enumerate(_batches(orders, "o_orderkey", 2)):
            view.process(i, {"orders": part} | ({"customer": customers} if i == 0 else {}))
        view.process(2, {"orders": orders.filter("o_orderkey % 9 = 0").withColumn("gone", F.lit(True))}, deleted="gone")
        return view.result()


@_add("SELECT time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '0001-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows take late rows: even events come last, and change the windows that the others made."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    with settings_kept(spark):
        sql = "SELECT window_start, count(*) AS n FROM events e INNER JOIN tumbling_window(e.ts, 60, 'MINUTE') GROUP BY window_start"
        view = Engine(spark).maintain(sql, {"events": ["event_id"]}, f"{shared_folder(spark)}/view-{uuid.uuid4().hex}")
        view.process(0, {"events": events.filter("event_id % 2 = 1")})
        view.process(1, {"events": events.filter("event_id % 2 = 0")})
        return view.result()


@_add("SELECT user_id, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view fed from a stream that is stopped and started again: every row counts once."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    view = View(spark, f"{at}/state", {"events": ["event_id"]}, lambda t: t["events"].groupBy("user_id").agg(F.sum("event_id").alias("total")), affected={"events": ["user_id"]})
    for half in (0, 1):
        events.filter(c("event_id") % 2 == half).write.parquet(f"{at}/in/{half}")
        view.start("events", spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    return view.result()


@_add("SELECT user_id, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY user_id")
def stateful_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate function with a state of its own: rows seen, least and greatest value."""

    def step(state, rows):
        return int(state[0] + len(rows)), float(min(state[1], rows["value"].min())), float(max(state[2], rows["value"].max()))

    events = table(spark, sf_dir, "events").select("user_id", "value")
    return stateful_aggregate(events, ["user_id"], (0, float("inf"), float("-inf")), step, lambda s: (s[0], s[2] - s[1]), "n bigint, spread double", "n bigint, lo double, hi double")


@_add(
    """SELECT c_custkey, c_custkey * 2 AS twice, upper(c_name) AS loud, bal, word FROM
    (SELECT c_custkey, c_name, max(c_custkey) OVER (PARTITION BY c_nationkey)::BIGINT AS bal, unnest(string_split(c_mktsegment, 'I')) AS word FROM customer)"""
)
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions by row and by batch, an aggregate function over a window and a table function, by name in SQL."""
    register(spark, sf_dir, ["customer"])
    with settings_kept(spark):
        engine = Engine(spark)
        for f in (samples.twice_py, samples.loud_py, samples.most_py):
            engine.function(f.__name__, f)
        engine.function("cut_py", samples.CutPy)
        return engine.query(
            """SELECT c_custkey, twice_py(c_custkey) AS twice, loud_py(c_name) AS loud, bal, word
            FROM (SELECT c_custkey, c_name, c_mktsegment, most_py(c_custkey) OVER (PARTITION BY c_nationkey) AS bal FROM customer) m, LATERAL cut_py(m.c_mktsegment, 'I')"""
        )


@_add("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 3")
def insert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE and INSERT with a primary key: the sink keeps one row per key, deletes included."""
    register(spark, sf_dir, ["supplier"])
    sink = KeyedSink(spark, f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}", ["s_suppkey"])
    batch = iter(range(9))
    weighted = lambda df: df if "_weight" in df.columns else df.withColumn("_weight", F.lit(1))
    registry = Registry().add_sink("out", lambda s, name, df, key, overwrite: sink(weighted(df), next(batch)))
    with settings_kept(spark):
        Engine(spark, registry).sql(
            """CREATE TABLE out (s_suppkey INT, s_nationkey INT);
            INSERT INTO out (s_suppkey, s_nationkey) PRIMARY KEY (s_suppkey) SELECT s_suppkey, -1 FROM supplier;
            INSERT INTO out PRIMARY KEY (s_suppkey) SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 3 THEN -1 ELSE 1 END AS _weight FROM supplier"""
        )
    return sink.rows()


@_add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30")
def fetch_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.fetch(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 30, F.asc("o_totalprice"))


@_add(
    """SELECT n_name AS nation, count(*) AS n, max(o_totalprice) AS most, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, CASE WHEN count(*) > 600 THEN 'many' ELSE 'few' END AS label
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND n_regionkey + 1 < 4 GROUP BY n_name ORDER BY n DESC, nation LIMIT 9"""
)
def substrait_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan document: joins, filters, an aggregate with a filtered measure, expressions, sort and fetch."""
    field = lambda i: {"selection": {"directReference": {"structField": {"field": i}}, "rootReference": {}}}
    names = ["equal:any_any", "lt:any_any", "gt:any_any", "add:i64_i64", "count:", "max:fp64"]
    call = lambda name, *a: {"scalarFunction": {"functionReference": [n.partition(":")[0] for n in names].index(name), "arguments": [{"value": x} for x in a]}}
    read = lambda name, *cols: {"read": {"baseSchema": {"names": list(cols)}, "namedTable": {"names": [name]}}}
    text = lambda x: {"literal": {"string": x}}
    orders = read("orders", "o_custkey", "o_orderpriority", "o_totalprice")
    orders["read"]["filter"] = {"singularOrList": {"value": field(1), "options": [text("1-URGENT"), text("2-HIGH")]}}
    join = lambda left, right, a, b: {"join": {"left": left, "right": right, "type": "JOIN_TYPE_INNER", "expression": call("equal", field(a), field(b))}}
    joined = join(join(orders, read("customer", "c_custkey", "c_nationkey"), 0, 3), read("nation", "n_nationkey", "n_name", "n_regionkey"), 4, 5)
    some = {"filter": {"input": joined, "condition": call("lt", call("add", field(7), {"literal": {"i64": "1"}}), {"literal": {"i64": "4"}})}}
    measure = lambda name, *a, **more: {"measure": {"functionReference": [n.partition(":")[0] for n in names].index(name), "arguments": [{"value": x} for x in a]}} | more
    grouped = {"aggregate": {"input": some, "groupings": [{"groupingExpressions": [field(6)]}], "measures": [measure("count"), measure("max", field(2)), measure("count", filter=call("gt", field(2), {"literal": {"fp64": 100000.0}}))]}}
    label = {"ifThen": {"ifs": [{"if": call("gt", field(1), {"literal": {"i64": "600"}}), "then": text("many")}], "else": text("few")}}
    shown = {"project": {"input": grouped, "expressions": [label], "common": {"emit": {"outputMapping": [0, 1, 2, 3, 4]}}}}
    ordered = {"sort": {"input": shown, "sorts": [{"expr": field(1), "direction": "SORT_DIRECTION_DESC_NULLS_LAST"}, {"expr": field(0), "direction": "SORT_DIRECTION_ASC_NULLS_FIRST"}]}}
    plan = {
        "extensions": [{"extensionFunction": {"functionAnchor": i, "name": n}} for i, n in enumerate(names)],
        "relations": [{"root": {"input": {"fetch": {"input": ordered, "offset": "0", "count": "9"}}, "names": ["nation", "n", "most", "dear", "label"]}}],
    }
    return substrait.frame(spark, json.dumps(plan), lambda name: table(spark, sf_dir, name))
