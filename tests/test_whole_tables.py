"""Queries that once had an id filter: the whole table counts, and a part of it gives what their earlier SQL gave."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import rows

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

#: The earlier SQL, and the part of each table that it read.
EARLIER = {
    "permission_expansion": (
        """WITH RECURSIVE m AS (SELECT o_orderkey AS g, o_custkey AS u FROM orders WHERE o_orderkey < 400
    UNION SELECT p.o_orderkey // 2, m.u FROM m JOIN orders p ON p.o_orderkey = m.g WHERE m.g // 2 >= 1 AND p.o_orderkey < 400)
    SELECT g::VARCHAR AS object_id, 'user' AS subject_type, u::VARCHAR AS subject_id FROM m""",
        {"orders": "o_orderkey < 400"},
    ),
    "sql_aggregates": (
        "SELECT c_nationkey, list_sort(list(c_mktsegment)) AS segments, string_agg(c_mktsegment, '|' ORDER BY c_mktsegment) AS joined, coalesce(sum(c_custkey) FILTER (WHERE c_acctbal < 0), 0)::BIGINT AS poor, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer WHERE c_custkey < 300 GROUP BY c_nationkey",
        {"customer": "c_custkey < 300"},
    ),
    "full_join": (
        "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON c_custkey = s_suppkey",
        {"customer": "c_custkey % 3 = 0", "supplier": "s_suppkey % 2 = 0"},
    ),
    "range_band_join": (
        "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_extendedprice BETWEEN p_retailprice AND p_retailprice + 50 WHERE p_size = 10 AND l_quantity < 3",
        {"part": "p_size = 10", "lineitem": "l_quantity < 3"},
    ),
}


@pytest.mark.parametrize("name", EARLIER)
def test_part_equals_earlier_sql(spark, name, tmp_path):
    sql, parts = EARLIER[name]
    con = duckdb.connect()
    for path in Path(LARGER).glob("*.parquet"):
        if path.stem not in parts:
            (tmp_path / path.name).symlink_to(path)
    for t, kept in parts.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
        spark.read.parquet(f"{LARGER}/{t}.parquet").filter(kept).write.parquet(f"{tmp_path}/{t}.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    a, b = rows(df.columns, df.collect()), rows(columns, cur.fetchall())
    assert [x.replace(".0,", ",").replace(".0)", ")") for x in a] == [x.replace(".0,", ",").replace(".0)", ")") for x in b]


def test_permissions_of_all_orders(spark):
    """Every order's customer is a member of the order's group and of all its halves."""
    want = set()
    for key, user in duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{DATA}/orders.parquet'").fetchall():
        want.add((str(key), "user", str(user)))
        while key > 1:
            key //= 2
            want.add((str(key), "user", str(user)))
    got = entry.queries()["permission_expansion"](spark, DATA).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_aggregates_of_all_customers(spark):
    """At sf0.01, where the former bound of 300 lay below the number of customers."""
    got = entry.queries()["sql_aggregates"](spark, LARGER).collect()
    n = spark.read.parquet(f"{LARGER}/customer.parquet").count()
    assert n > 300 and sum(len(r["segments"]) for r in got) == sum(len(r["joined"].split("|")) for r in got) == n


def test_joins_of_all_rows(spark):
    customers = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert entry.queries()["full_join"](spark, DATA).filter("c_custkey is not null").count() == customers
    pairs = duckdb.sql(f"SELECT count(*) FROM '{DATA}/lineitem.parquet' JOIN '{DATA}/part.parquet' ON l_extendedprice BETWEEN p_retailprice AND p_retailprice + 50").fetchall()[0][0]
    assert entry.queries()["range_band_join"](spark, DATA).count() == pairs
