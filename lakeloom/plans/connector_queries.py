"""Queries that take tables through the connectors and back, with the DuckDB SQL that they equal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.recursion import shared_folder
from lakeloom.plans.engine import Engine
from lakeloom.session import settings_kept, table
from lakeloom.sources import files, generic, stores
from lakeloom.sources.delta import DeltaTable
from lakeloom.sources.registry import Registry
from lakeloom.streaming.exchange import Exchange

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def _query(oracle: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read as CSV, the reading by a table name of the registry."""
    at = _place(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).csv(at)
    registry = Registry().add_source("people", lambda s, name, schema: files.csv(s, at, schema))
    with settings_kept(spark):
        return Engine(spark, registry).query("CREATE TABLE people (c_custkey INT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING); SELECT * FROM people")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n FROM customer")
def csv_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial files and files of deletions."""
    at = _place(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    rows.write.option("header", True).csv(f"{at}/initial")
    rows.filter("c_custkey % 3 = 0").write.option("header", True).csv(f"{at}/deltas")
    both = files.csv_with_deltas(spark, f"{at}/initial", f"{at}/deltas", "c_custkey bigint", F.lit(-1))
    return both.groupBy("c_custkey").agg(F.sum("_weight").cast("int").alias("n"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "xml")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(at)
    return files.xml(spark, at, "nation", nation.schema.simpleString()[7:-1].replace(":", " "))


@_query("SELECT c_name AS line, count(*) AS n FROM customer GROUP BY c_name")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "text")
    table(spark, sf_dir, "customer").select("c_name").write.text(at)
    return files.text(spark, at, "line").groupBy("line").agg(F.count("file_name").alias("n"))


@_query("SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders")
def delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits to a partitioned table; all partitions are read in one scan."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    t = DeltaTable(spark, _place(spark, "delta"))
    t.write(orders.filter("o_orderkey % 2 = 0"), partition_by=["o_orderstatus"])
    t.write(orders.filter("o_orderkey % 2 = 1"))
    return t.read()


@_query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE 1 END AS weight FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 = 1)")
def delta_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of an overwrite that keeps half of the rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    t = DeltaTable(spark, _place(spark, "delta"))
    t.write(rows.filter("c_custkey % 4 <> 1"))
    t.write(rows.filter("c_custkey % 4 <> 0"), overwrite=True)
    return t.changes(0).withColumnRenamed("_weight", "weight")


@_query("SELECT p::INTEGER AS part, (p * 1000 + i)::BIGINT AS x FROM range(4) a(p), range(500) b(i) WHERE i % 2 = 0")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python source in four partitions, filtered in SQL and computed twice (once into nothing)."""
    registry = Registry().add_source("numbers", lambda s, name, schema: generic.object_source(s, "lakeloom_numbers", "part int, x bigint", lambda p: ((p, p * 1000 + i) for i in range(500)), 4))
    with settings_kept(spark):
        out = Engine(spark, registry).query("SELECT part, x FROM numbers WHERE x % 2 = 0")
    generic.blackhole(out)
    return out


@_query("SELECT c_custkey::VARCHAR AS key, c_custkey % 5 = 0 AS deleted, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name FROM customer")
def kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as messages and back, as a broker would hand them over."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(c("c_custkey") % 5 == 0, -1).otherwise(1).alias("_weight"))
    sent = stores.kafka_messages(rows, ["c_custkey"])
    raw = sent.select(c("key").cast("binary").alias("key"), c("value").cast("binary").alias("value"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))
    return stores.kafka_rows(raw, "c_name string").select(c("_key").alias("key"), c("_deleted").alias("deleted"), "c_name")


@_query(
    """SELECT service, c_custkey::VARCHAR AS key, c_custkey % 7 <> 0 AS upsert FROM customer, (VALUES ('elasticsearch'), ('starrocks'), ('cosmosdb'), ('mongodb'), ('qdrant')) s(service)
    WHERE service <> 'qdrant' OR c_custkey % 7 <> 0"""
)
def service_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sinks of services would send: every key once to each, as an upsert or a delete."""
    changed = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(c("c_custkey") % 7 == 0, -1).otherwise(1).alias("_weight"))
    old = changed.filter("_weight > 0").select("c_custkey", F.lit("old").alias("c_name"), F.lit(-1).alias("_weight"))  # replaced, so not sent
    rows, key = changed.unionByName(old), ["c_custkey"]
    sinks = {
        "elasticsearch": stores.elasticsearch("i", key),
        "starrocks": stores.starrocks("d", "t"),
        "cosmosdb": stores.cosmosdb("c", key),
        "mongodb": stores.mongodb("c", key),
        "qdrant": stores.qdrant("c", key, "c_name", lambda texts: [[float(len(t))] for t in texts]),
    }
    out = None
    for name, build in sinks.items():
        part = stores.requests(rows, build, key).select(F.lit(name).alias("service"), F.explode(_sent(name)).alias("s")).select("service", c("s.key").cast("string").alias("key"), "s.upsert")
        out = part if out is None else out.unionByName(part)
    return out


def _sent(service: str):
    """key and upsert of what a request carries."""
    pair = lambda key, upsert: F.struct(key.alias("key"), upsert.alias("upsert"))
    body = c("body")
    if service == "elasticsearch":
        lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.from_json(x, "index struct<_id:string>, delete struct<_id:string>")), lambda x: x["index"].isNotNull() | x["delete"].isNotNull())
        return F.transform(lines, lambda x: pair(F.coalesce(x["index"]["_id"], x["delete"]["_id"]), x["index"].isNotNull()))
    if service == "starrocks":
        return F.transform(F.from_json(body, "array<struct<c_custkey:string,__op:int>>"), lambda x: pair(x["c_custkey"], x["__op"] == 0))
    if service == "cosmosdb":
        return F.array(pair(F.coalesce(F.get_json_object(body, "$.id"), F.substring_index("path", "/", -1)), c("method") == "POST"))
    if service == "mongodb":
        ops = F.from_json(body, "array<struct<replaceOne:struct<filter:struct<c_custkey:string>>,deleteOne:struct<filter:struct<c_custkey:string>>>>")
        return F.transform(ops, lambda x: pair(F.coalesce(x["replaceOne"]["filter"]["c_custkey"], x["deleteOne"]["filter"]["c_custkey"]), x["replaceOne"].isNotNull()))
    points = F.coalesce(F.from_json(body, "points array<struct<payload:struct<_key:string>>>")["points"], F.array())
    return F.transform(points, lambda x: pair(x["payload"]["_key"], F.lit(True)))


@_query("SELECT service, n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS region FROM nation, (VALUES ('openfga'), ('spicedb'), ('permify'), ('sharepoint')) s(service)")
def service_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships as the services would answer, page by page, in the form that the sinks give them."""
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]  # 25 rows
    rows = [{"resource_type": "nation", "resource_id": str(n), "relation": "part", "subject_type": "region", "subject_id": str(r), "subject_relation": None} for n, r in nations]
    tuples = [{"user_type": "region", "user_id": str(r), "user_relation": None, "relation": "part", "object_type": "nation", "object_id": str(n)} for n, r in nations]
    fga = json.loads(stores.openfga("s")(tuples, [])[0][2])["writes"]["tuple_keys"]
    spice = [u["relationship"] for u in json.loads(stores.spicedb()(rows, [])[0][2])["updates"]]
    perm = json.loads(stores.permify("t")(rows, [])[0][2])["tuples"]
    size = 10

    def page(request: stores.Request, token: str) -> tuple[int, str]:
        at = int(json.loads(request[2]).get(token) or 0)
        return at, str(at + size) if at + size < len(rows) else ""

    def answer_fga(request: stores.Request) -> str:
        at, after = page(request, "continuation_token")
        return json.dumps({"tuples": [{"key": k} for k in fga[at : at + size]], "continuation_token": after})

    def answer_spice(request: stores.Request) -> str:
        at = int((json.loads(request[2]).get("optionalCursor") or {}).get("token") or 0)
        return "\n".join(json.dumps({"result": {"relationship": r, "afterResultCursor": {"token": str(at + i + 1)}}}) for i, r in enumerate(spice[at : at + size]))

    def answer_permify(request: stores.Request) -> str:
        at, after = page(request, "continuous_token")
        return json.dumps({"tuples": perm[at : at + size], "continuous_token": after})

    def answer_items(request: stores.Request) -> str:
        at = int(request[1].partition("skip=")[2] or 0)
        more = {"@odata.nextLink": f"/next?skip={at + size}"} if at + size < len(rows) else {"@odata.deltaLink": "/delta"}
        return json.dumps({"value": [{"id": r["resource_id"], "fields": {"region": r["subject_id"]}} for r in rows[at : at + size]]} | more)

    named = lambda df, service: df.select(F.lit(service).alias("service"), c("resource_id").alias("id"), c("subject_id").alias("region"))
    out = stores.openfga_source(spark, "s", answer_fga, page=size).select(F.lit("openfga").alias("service"), c("object_id").alias("id"), c("user_id").alias("region"))
    out = out.unionByName(named(stores.spicedb_source(spark, ["nation"], answer_spice, page=size), "spicedb"))
    out = out.unionByName(named(stores.permify_source(spark, "t", ["nation"], answer_permify, page=size), "permify"))
    return out.unionByName(stores.sharepoint_source(spark, "l", "region string", answer_items).select(F.lit("sharepoint").alias("service"), "id", "region"))


@_query("SELECT c_custkey::BIGINT AS c_custkey, c_nationkey::BIGINT AS c_nationkey, 1 AS readers FROM customer UNION ALL SELECT n_nationkey, -1, 4 FROM nation UNION ALL SELECT r_regionkey, -2, 1 FROM region")
def bucket_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scattered over four buckets, nations broadcast to all, regions to one; every bucket is pulled."""
    ex = Exchange(spark, _place(spark, "exchange"), 4)
    ex.publish(0, table(spark, sf_dir, "customer").select(c("c_custkey").cast("bigint"), c("c_nationkey").cast("bigint")), "scatter", ["c_nationkey"])
    ex.publish(1, table(spark, sf_dir, "nation").select(c("n_nationkey").cast("bigint").alias("c_custkey"), F.lit(-1).cast("bigint").alias("c_nationkey")), "broadcast")
    ex.publish(2, table(spark, sf_dir, "region").select(c("r_regionkey").cast("bigint").alias("c_custkey"), F.lit(-2).cast("bigint").alias("c_nationkey")), "single")
    out = None
    for bucket in range(4):
        first, at = ex.pull(bucket, -1, most=2)
        rest, _ = ex.pull(bucket, at)
        part = first.unionByName(rest).withColumn("bucket", F.lit(bucket))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("c_custkey", "c_nationkey").agg(F.count_distinct("bucket").cast("int").alias("readers"))
