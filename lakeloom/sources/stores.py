"""Databases and services: requests are built per batch of rows and sent, or fetched, by executors.

Sinks are given weighted changes or plain rows: rows of weight above 0 are upserted by primary
key, the others deleted. Each format function turns one batch into requests (method, path, body);
``send`` is a picklable callable of those, so any HTTP client can be used. Sources get a picklable
``fetch`` that returns the answer of a request.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources import generic

Request = tuple[str, str, str]
Rows = list[dict[str, Any]]


def _json(x: Any) -> str:
    return json.dumps(x, default=str, sort_keys=True, separators=(",", ":"))


def _key(row: dict, key: list[str]) -> str:
    return "|".join(str(row[k]) for k in key)


def elasticsearch(index: str, key: list[str]) -> Callable[[Rows, Rows], list[Request]]:
    """One bulk request."""

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        lines = []
        for r in upserts:
            lines += [_json({"index": {"_index": index, "_id": _key(r, key)}}), _json({k: v for k, v in r.items() if k != "_id"})]
        lines += [_json({"delete": {"_index": index, "_id": _key(r, key)}}) for r in deletes]
        return [("POST", "/_bulk", "\n".join(lines) + "\n")] if lines else []

    return build


def starrocks(database: str, table: str) -> Callable[[Rows, Rows], list[Request]]:
    """Stream load into a primary key table; __op 0 upserts, 1 deletes."""

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        rows = [r | {"__op": 0} for r in upserts] + [r | {"__op": 1} for r in deletes]
        return [("PUT", f"/api/{database}/{table}/_stream_load", _json(rows))] if rows else []

    return build


def cosmosdb(container: str, key: list[str]) -> Callable[[Rows, Rows], list[Request]]:
    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        return [("POST", f"/colls/{container}/docs", _json(r | {"id": _key(r, key)})) for r in upserts] + [("DELETE", f"/colls/{container}/docs/{_key(r, key)}", "") for r in deletes]

    return build


def mongodb(collection: str, key: list[str]) -> Callable[[Rows, Rows], list[Request]]:
    """One bulk write of replacements (upsert) and deletes."""

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        ops = [{"replaceOne": {"filter": {k: r[k] for k in key}, "replacement": r, "upsert": True}} for r in upserts]
        ops += [{"deleteOne": {"filter": {k: r[k] for k in key}}} for r in deletes]
        return [("BULK", collection, _json(ops))] if ops else []

    return build


def chunks(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Pieces of ``size`` characters that share ``overlap`` with the one before."""
    if not text:
        return []
    step = max(1, size - overlap)
    return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]


def qdrant(collection: str, key: list[str], text: str, embed: Callable[[list[str]], list[list[float]]], size: int = 1000, overlap: int = 100) -> Callable[[Rows, Rows], list[Request]]:
    """Old points of the keys are deleted, then each text's chunks are embedded and added."""
    import uuid

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        keys = [_key(r, key) for r in [*upserts, *deletes]]
        if not keys:
            return []
        out = [("POST", f"/collections/{collection}/points/delete", _json({"filter": {"must": [{"key": "_key", "match": {"any": keys}}]}}))]
        points = []
        for r in upserts:
            parts = chunks(r[text] or "", size, overlap)
            for i, (p, v) in enumerate(zip(parts, embed(parts) if parts else [])):
                points.append({"id": str(uuid.uuid5(uuid.NAMESPACE_OID, f"{_key(r, key)}#{i}")), "vector": v, "payload": {k: x for k, x in r.items() if k != text} | {"_key": _key(r, key), "chunk": p, "chunk_no": i}})
        return out + ([("PUT", f"/collections/{collection}/points", _json({"points": points}))] if points else [])

    return build


def sharepoint(list_name: str, key: list[str]) -> Callable[[Rows, Rows], list[Request]]:
    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        path = lambda r: f"/lists/{list_name}/items({_key(r, key)})"
        return [("PATCH", path(r), _json({"fields": r})) for r in upserts] + [("DELETE", path(r), "") for r in deletes]

    return build


def openfga(store: str) -> Callable[[Rows, Rows], list[Request]]:
    """Tuples: user_type, user_id, user_relation, relation, object_type, object_id."""

    def item(r: dict) -> dict:
        user = f"{r['user_type']}:{r['user_id']}" + (f"#{r['user_relation']}" if r.get("user_relation") else "")
        return {"user": user, "relation": r["relation"], "object": f"{r['object_type']}:{r['object_id']}"}

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        body = {}
        if upserts:
            body["writes"] = {"tuple_keys": [item(r) for r in upserts]}
        if deletes:
            body["deletes"] = {"tuple_keys": [item(r) for r in deletes]}
        return [("POST", f"/stores/{store}/write", _json(body))] if body else []

    return build


def _relationship(r: dict) -> dict:
    subject = {"object": {"objectType": r["subject_type"], "objectId": r["subject_id"]}}
    if r.get("subject_relation"):
        subject["optionalRelation"] = r["subject_relation"]
    return {"resource": {"objectType": r["resource_type"], "objectId": r["resource_id"]}, "relation": r["relation"], "subject": subject}


def spicedb() -> Callable[[Rows, Rows], list[Request]]:
    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        updates = [{"operation": "OPERATION_TOUCH", "relationship": _relationship(r)} for r in upserts] + [{"operation": "OPERATION_DELETE", "relationship": _relationship(r)} for r in deletes]
        return [("POST", "/v1/relationships/write", _json({"updates": updates}))] if updates else []

    return build


def permify(tenant: str) -> Callable[[Rows, Rows], list[Request]]:
    def item(r: dict) -> dict:
        return {"entity": {"type": r["resource_type"], "id": r["resource_id"]}, "relation": r["relation"], "subject": {"type": r["subject_type"], "id": r["subject_id"], "relation": r.get("subject_relation") or ""}}

    def build(upserts: Rows, deletes: Rows) -> list[Request]:
        out = []
        if upserts:
            out.append(("POST", f"/v1/tenants/{tenant}/data/write", _json({"tuples": [item(r) for r in upserts]})))
        return out + [("POST", f"/v1/tenants/{tenant}/data/delete", _json({"tuples": [item(r)]})) for r in deletes]

    return build


# reading services: pages are fetched by executors, one task per part of the service


Fetch = Callable[[Request], str]


def _pages(fetch: Fetch, first: Request, following: Callable[[dict, Request], "Request | None"]) -> Iterator[dict]:
    request: Request | None = first
    while request is not None:
        page = json.loads(fetch(request) or "{}")
        yield page
        request = following(page, request)


def sharepoint_source(spark: SparkSession, list_name: str, schema: str, fetch: Fetch, since: str | None = None) -> DataFrame:
    """The items of a list: id, the fields of ``schema`` and _weight (-1 for items deleted since).

    ``since`` is the link for changes that `sharepoint_token` gave; without it all items are read.
    """
    first = since or f"/lists/{list_name}/items/delta?expand=fields"

    def read(_: int) -> Iterator[tuple]:
        for page in _pages(fetch, ("GET", first, ""), lambda p, r: ("GET", p["@odata.nextLink"], "") if p.get("@odata.nextLink") else None):
            for item in page.get("value", []):
                yield str(item["id"]), _json(item.get("fields") or {}), -1 if "deleted" in item else 1

    raw = generic.object_source(spark, f"sharepoint_{_name(list_name)}", "id string, fields string, _weight int", read)
    return raw.select("id", F.from_json("fields", schema).alias("_f"), "_weight").select("id", "_f.*", "_weight")


def sharepoint_token(list_name: str, fetch: Fetch, since: str | None = None) -> str | None:
    """The link from which later changes of a list can be read."""
    last: dict = {}
    for last in _pages(fetch, ("GET", since or f"/lists/{list_name}/items/delta?expand=fields", ""), lambda p, r: ("GET", p["@odata.nextLink"], "") if p.get("@odata.nextLink") else None):
        pass
    return last.get("@odata.deltaLink")


_TUPLE = "user_type string, user_id string, user_relation string, relation string, object_type string, object_id string"


def openfga_source(spark: SparkSession, store: str, fetch: Fetch, types: list[str] | None = None, changes: bool = False, page: int = 100) -> DataFrame:
    """Relationship tuples; with ``changes`` all changes in order (_no within a type) with _weight.

    Each object type of ``types`` is read by a task of its own; without types one task reads all.
    """

    def split(key: dict) -> tuple:
        user, _, relation = key["user"].partition("#")
        kind, _, name = user.partition(":")
        object_type, _, object_id = key["object"].partition(":")
        return kind, name, relation or None, key["relation"], object_type, object_id

    def read(part: int) -> Iterator[tuple]:
        kind = types[part] if types else None
        if changes:
            at = lambda token: ("GET", f"/stores/{store}/changes?page_size={page}" + (f"&type={kind}" if kind else "") + (f"&continuation_token={token}" if token else ""), "")
            number = 0
            for p in _pages(fetch, at(""), lambda p, r: at(p["continuation_token"]) if p.get("continuation_token") and p.get("changes") else None):
                for c in p.get("changes", []):
                    yield *split(c["tuple_key"]), number, -1 if c["operation"].endswith("DELETE") else 1
                    number += 1
            return
        body = {"page_size": page} | ({"tuple_key": {"object": f"{kind}:"}} if kind else {})
        path = f"/stores/{store}/read"
        for p in _pages(fetch, ("POST", path, _json(body)), lambda p, r: ("POST", path, _json(body | {"continuation_token": p["continuation_token"]})) if p.get("continuation_token") else None):
            for t in p.get("tuples", []):
                yield split(t["key"])

    more = ", _no bigint, _weight int" if changes else ""
    return generic.object_source(spark, f"openfga_{_name(store)}{'_changes' if changes else ''}", _TUPLE + more, read, len(types) if types else 1)


_RELATIONSHIP = "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string"


def spicedb_source(spark: SparkSession, types: list[str], fetch: Fetch, page: int = 1000) -> DataFrame:
    """Relationships of resource ``types``, each read by a task of its own, page by page.

    An answer has one JSON object per line; the last one's cursor begins the next page.
    """

    def read(part: int) -> Iterator[tuple]:
        cursor = None
        while True:
            body = {"relationshipFilter": {"resourceType": types[part]}, "optionalLimit": page} | ({"optionalCursor": {"token": cursor}} if cursor else {})
            lines = [json.loads(x)["result"] for x in fetch(("POST", "/v1/relationships/read", _json(body))).splitlines() if x.strip()]
            for x in lines:
                r = x["relationship"]
                s = r["subject"]
                yield r["resource"]["objectType"], r["resource"]["objectId"], r["relation"], s["object"]["objectType"], s["object"]["objectId"], s.get("optionalRelation") or None
            cursor = (lines[-1].get("afterResultCursor") or {}).get("token") if len(lines) >= page else None
            if not cursor:
                return

    return generic.object_source(spark, f"spicedb_{_name('_'.join(types))}", _RELATIONSHIP, read, len(types))


def permify_source(spark: SparkSession, tenant: str, types: list[str], fetch: Fetch, page: int = 100) -> DataFrame:
    """Relationships of entity ``types``, each read by a task of its own, page by page."""
    path = f"/v1/tenants/{tenant}/data/relationships/read"

    def read(part: int) -> Iterator[tuple]:
        body = {"metadata": {"snap_token": ""}, "filter": {"entity": {"type": types[part], "ids": []}}, "page_size": page}
        for p in _pages(fetch, ("POST", path, _json(body)), lambda p, r: ("POST", path, _json(body | {"continuous_token": p["continuous_token"]})) if p.get("continuous_token") else None):
            for t in p.get("tuples", []):
                yield t["entity"]["type"], t["entity"]["id"], t["relation"], t["subject"]["type"], t["subject"]["id"], t["subject"].get("relation") or None

    return generic.object_source(spark, f"permify_{_name(tenant)}", _RELATIONSHIP, read, len(types))


def _name(text: str) -> str:
    return re.sub(r"\W", "_", text)


def http_fetcher(base: str, headers: dict[str, str] | None = None) -> Fetch:
    """Fetches with the standard library; a link that is complete is followed as it is."""

    def fetch(request: Request) -> str:
        import urllib.request

        method, path, body = request
        url = path if "://" in path else base + path
        with urllib.request.urlopen(urllib.request.Request(url, body.encode() or None, {"Content-Type": "application/json"} | (headers or {}), method=method), timeout=60) as answer:
            return answer.read().decode()

    return fetch


def http_sender(base: str, headers: dict[str, str] | None = None) -> Callable[[Request], None]:
    """Sends requests with the standard library."""

    def send(request: Request) -> None:
        import urllib.request

        method, path, body = request
        kind = {"Content-Type": "application/x-ndjson" if path == "/_bulk" else "application/json"}
        urllib.request.urlopen(urllib.request.Request(base + path, body.encode() or None, kind | (headers or {}), method=method), timeout=60).close()

    return send


def batches(rows: Iterator, size: int) -> Iterator[tuple[Rows, Rows]]:
    upserts, deletes = [], []
    for d in rows:
        (upserts if d.pop("_weight", 1) > 0 else deletes).append(d)
        if len(upserts) + len(deletes) >= size:
            yield upserts, deletes
            upserts, deletes = [], []
    if upserts or deletes:
        yield upserts, deletes


def net_changes(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: of weighted changes, deletes of rows that are replaced are left out."""
    if "_weight" not in df.columns:
        return df
    best = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), "_weight").alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)


def requests(df: DataFrame, build: Callable[[Rows, Rows], list[Request]], key: list[str], size: int = 1000) -> DataFrame:
    """The requests (method, path, body) that `send_changes` would send."""

    def run(frames: Iterator) -> Iterator:
        rows = (r for batch in frames for r in batch.to_pylist())
        for up, down in batches(rows, size):
            out = build(up, down)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("method", "path", "body"), r)) for r in out], pa.schema([(n, pa.string()) for n in ("method", "path", "body")]))

    return net_changes(df, key).mapInArrow(run, "method string, path string, body string")


def send_changes(df: DataFrame, build: Callable[[Rows, Rows], list[Request]], send: Callable[[Request], None], key: list[str], size: int = 1000) -> None:
    """Send every row from the executors, the rows of one key by one task."""

    def run(rows: Iterator) -> None:
        for up, down in batches((r.asDict(True) for r in rows), size):
            for request in build(up, down):
                send(request)

    net_changes(df, key).foreachPartition(run)


# Kafka and JDBC, by Spark's own formats


def kafka_source(spark: SparkSession, servers: str, topic: str, value_schema: str | None = None, stream: bool = True, starting: str = "earliest") -> DataFrame:
    """_key, the value's fields (JSON) or value, and _deleted (a null value). Needs Spark's Kafka package."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return kafka_rows(reader.load(), value_schema)


def kafka_rows(raw: DataFrame, value_schema: str | None = None) -> DataFrame:
    value = F.col("value").cast("string")
    out = raw.select(F.col("key").cast("string").alias("_key"), F.col("value").isNull().alias("_deleted"), (F.from_json(value, value_schema) if value_schema else value).alias("value"), "partition", "offset")
    return out.select("_key", "_deleted", "value.*", "partition", "offset") if value_schema else out


def kafka_messages(df: DataFrame, key: list[str]) -> DataFrame:
    """key and value of messages for weighted changes; deletes have a null value."""
    fields = [c for c in df.columns if c != "_weight"]
    value = F.to_json(F.struct(*fields))
    if "_weight" in df.columns:
        value = F.when(F.col("_weight") > 0, value)
    return df.select(F.to_json(F.struct(*key)).alias("key") if len(key) != 1 else F.col(key[0]).cast("string").alias("key"), value.alias("value"))


def kafka_sink(df: DataFrame, servers: str, topic: str, key: list[str]) -> None:
    kafka_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def jdbc_source(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC; with a numeric column and bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def jdbc_changes(spark: SparkSession, url: str, table: str, since: int, key: list[str], **options: str) -> DataFrame:
    """Change-tracking rows after a version: current values with _weight 1, deleted keys with -1."""
    on = " AND ".join(f"t.{k} = c.{k}" for k in key)
    keys = ", ".join(f"c.{k} AS _key_{k}" for k in key)
    sql = f"SELECT {keys}, t.*, c.SYS_CHANGE_OPERATION AS _op FROM CHANGETABLE(CHANGES {table}, {int(since)}) AS c LEFT JOIN {table} AS t ON {on}"
    df = spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    return df.withColumn("_weight", F.when(F.col("_op") == "D", -1).otherwise(1)).drop("_op")


def jdbc_sink(df: DataFrame, url: str, table: str, overwrite: bool = False, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite" if overwrite else "append").save()


def merge_statement(table: str, staging: str, key: list[str], columns: list[str]) -> str:
    """T-SQL that upserts and deletes from a staging table with _weight."""
    on = " AND ".join(f"t.[{k}] = s.[{k}]" for k in key)
    sets = ", ".join(f"t.[{c}] = s.[{c}]" for c in columns if c not in key)
    names = ", ".join(f"[{c}]" for c in columns)
    values = ", ".join(f"s.[{c}]" for c in columns)
    update = f"WHEN MATCHED THEN UPDATE SET {sets} " if sets else ""
    return f"MERGE INTO {table} AS t USING {staging} AS s ON {on} WHEN MATCHED AND s._weight < 0 THEN DELETE {update}WHEN NOT MATCHED AND s._weight > 0 THEN INSERT ({names}) VALUES ({values});"


def mongodb_source(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """By the MongoDB connector, if it is on the class path."""
    return spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection).load()


def basic_auth(user: str, password: str) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()}
