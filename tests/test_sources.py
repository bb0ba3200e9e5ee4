"""Connectors: files, delta tables, requests to services, Python sources, permissions."""

import datetime
import json
import random
import struct
import uuid

import numpy as np
from pyspark.sql import functions as F

from lakeloom.sources import delta, files, generic, permissions, stores
from lakeloom.sources.delta import DeltaTable
from lakeloom.sources.registry import Registry


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hello;world;123\nx;y;bad\n")
    (tmp_path / "d.csv").write_text("hello;world;123\n")
    schema = "a string, b string, c int"
    assert rows(files.csv(spark, str(tmp_path / "a.csv"), schema, header=False, delimiter=";")) == [("hello", "world", 123), ("x", "y", None)]
    both = files.csv_with_deltas(spark, str(tmp_path / "a.csv"), str(tmp_path / "d.csv"), schema, F.lit(-1), header=False, delimiter=";")
    assert sorted(r["_weight"] for r in both.collect()) == [-1, 1, 1]
    (tmp_path / "x.xml").write_text("<root><item><id>1</id><n>one</n></item><item><id>2</id></item></root>")
    assert rows(files.xml(spark, str(tmp_path / "x.xml"), "item", "id int, n string")) == [(1, "one"), (2, None)]
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert [r[0] for r in files.text(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]


def test_delta(spark, tmp_path):
    t = DeltaTable(spark, f"file://{tmp_path}/delta")
    assert t.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")) == 0
    assert t.write(spark.createDataFrame([(3, "c")], "id int, v string")) == 1
    assert t.write(spark.createDataFrame([(1, "a"), (4, "d")], "id int, v string"), overwrite=True) == 2
    assert rows(t.read()) == [(1, "a"), (4, "d")]
    assert rows(t.read(1)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(t.changes(1)) == [(2, "b", -1), (3, "c", -1), (4, "d", 1)]
    assert rows(t.changes(2)) == []


def z85(data):
    signs = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
    data += b"\0" * (-len(data) % 4)
    out = ""
    for i in range(0, len(data), 4):
        n = int.from_bytes(data[i : i + 4], "big")
        out += "".join(signs[n // 85**k % 85] for k in (4, 3, 2, 1, 0))
    return out


def vector(positions, runs=False):
    """A deletion vector: array and bitmap containers, or runs."""
    out = struct.pack("<IQ", 1681511377, len({p >> 32 for p in positions}))
    for high in sorted({p >> 32 for p in positions}):
        low = sorted(p & 0xFFFFFFFF for p in positions if p >> 32 == high)
        keys = sorted({p >> 16 for p in low})
        own = [[p & 0xFFFF for p in low if p >> 16 == k] for k in keys]
        heads = b"".join(struct.pack("<HH", k, len(v) - 1) for k, v in zip(keys, own))
        bodies = []
        for v in own:
            if runs:
                cuts = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1] + 1] + [len(v)]
                bodies.append(struct.pack("<H", len(cuts) - 1) + b"".join(struct.pack("<HH", v[a], b - a - 1) for a, b in zip(cuts, cuts[1:])))
            elif len(v) <= 4096:
                bodies.append(struct.pack(f"<{len(v)}H", *v))
            else:
                bits = np.zeros(65536, np.uint8)
                bits[v] = 1
                bodies.append(np.packbits(bits, bitorder="little").tobytes())
        offsets = b"\0" * 4 * len(keys)  # not needed to read in order
        if runs:
            flags = sum(1 << i for i in range(len(keys)))
            out += struct.pack("<I", high) + struct.pack("<I", 12347 | (len(keys) - 1) << 16) + flags.to_bytes((len(keys) + 7) // 8, "little") + heads + (offsets if len(keys) >= 4 else b"")
        else:
            out += struct.pack("<I", high) + struct.pack("<II", 12346, len(keys)) + heads + offsets
        out += b"".join(bodies)
    return out


def test_roaring_positions():
    rng = random.Random(0)
    for positions in ([], [0], [3, 70_000, 1 << 33], list(range(5000)), rng.sample(range(300_000), 9000), [*range(10, 500), *range(66_000, 66_010), 200_000, 270_000, 400_000]):
        for runs in (False, True):
            assert delta.roaring_positions(vector(positions, runs)).tolist() == sorted(positions)


def commit(path, version, *actions):
    (path / "_delta_log" / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions))


def test_delta_deletion_vectors(spark, tmp_path):
    root = tmp_path / "delta"
    t = DeltaTable(spark, f"file://{root}")
    t.write(spark.range(10_000).selectExpr("id", "id % 3 AS g").coalesce(1))
    add = next(json.loads(x)["add"] for x in (root / "_delta_log" / f"{0:020d}.json").read_text().splitlines() if "add" in json.loads(x))
    remove = lambda old: {"remove": {"path": add["path"], "dataChange": True} | old}
    inline = vector([1, 5])
    one = {"deletionVector": {"storageType": "i", "pathOrInlineDv": z85(inline), "sizeInBytes": len(inline), "cardinality": 2}}
    commit(root, 1, {"add": add | one}, remove({}))  # the order of actions doesn't count
    name = uuid.uuid4()
    (root / "ab").mkdir()
    data = vector([1, 5, *range(100, 9000)])
    (root / "ab" / f"deletion_vector_{name}.bin").write_bytes(b"\1" + b"junk" + struct.pack(">I", len(data)) + data + b"crc4")
    two = {"deletionVector": {"storageType": "u", "pathOrInlineDv": "ab" + z85(name.bytes), "offset": 5, "sizeInBytes": len(data), "cardinality": 8902}}
    commit(root, 2, remove(one), {"add": add | two})
    assert t.read(0).count() == 10_000
    assert sorted(r[0] for r in t.read(1).collect()) == [i for i in range(10_000) if i not in (1, 5)]
    assert sorted(r[0] for r in t.read().collect()) == [i for i in range(10_000) if i not in (1, 5) and not 100 <= i < 9000]
    assert rows(t.changes(0, 1)) == [(1, 1, -1), (5, 2, -1)]
    assert t.changes(1).count() == 8900 and t.changes(1).filter("_weight > 0").count() == 0
    t.write(spark.range(3).selectExpr("id", "id AS g"), overwrite=True)
    assert rows(t.read()) == [(0, 0), (1, 1), (2, 2)]
    assert t.changes(2).filter("_weight < 0").count() == 1098 - 2  # (0, 0) and (2, 2) are in both


def test_delta_partitions(spark, tmp_path):
    t = DeltaTable(spark, f"file://{tmp_path}/delta")
    schema = "k string, day date, v int"
    day = datetime.date(2024, 5, 1)
    first = [("a b/c=d%+é", day, 1), (None, day, 2), ("x", None, 3), ("", day, 4)]
    t.write(spark.createDataFrame(first, schema), partition_by=["k", "day"])
    t.write(spark.createDataFrame([("x", day, 5)], schema))
    want = [("a b/c=d%+é", day, 1), (None, day, 2), ("x", None, 3), (None, day, 4), ("x", day, 5)]  # an empty value is stored as null
    assert rows(t.read()) == sorted(want, key=repr)
    assert t.read().schema.simpleString() == "struct<k:string,day:date,v:int>"
    assert rows(t.changes(0)) == [("x", day, 5, 1)]
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    t.write(spark.createDataFrame([("y", day, 6)], schema), overwrite=True, partition_by=["v"])
    assert rows(t.read()) == [("y", day, 6)] and rows(t.read(1)) == sorted(want, key=repr)


def test_delta_checkpoint_and_column_mapping(spark, tmp_path):
    root = tmp_path / "delta"
    t = DeltaTable(spark, f"file://{root}")
    t.write(spark.createDataFrame([(1, "a")], "c1 int, c2 string").coalesce(1))
    log = [json.loads(x) for x in (root / "_delta_log" / f"{0:020d}.json").read_text().splitlines()]
    meta = next(a["metaData"] for a in log if "metaData" in a)
    add = next(a["add"] for a in log if "add" in a)
    fields = [{"name": n, "type": kind, "nullable": True, "metadata": {"delta.columnMapping.id": i, "delta.columnMapping.physicalName": f"c{i}"}} for i, n, kind in ((1, "id", "integer"), (2, "full name", "string"))]
    meta |= {"schemaString": json.dumps({"type": "struct", "fields": fields}), "configuration": {"delta.columnMapping.mode": "name"}}
    schema = "metaData struct<id string, schemaString string, partitionColumns array<string>, configuration map<string,string>>, add struct<path string, partitionValues map<string,string>, size bigint>"
    spark.createDataFrame([((meta["id"], meta["schemaString"], [], meta["configuration"]), None), (None, (add["path"], {}, add["size"]))], schema).coalesce(1).write.parquet(f"file://{root}/cp")
    (part,) = (root / "cp").glob("*.parquet")
    part.rename(root / "_delta_log" / f"{5:020d}.checkpoint.parquet")
    commit(root, 5, {"commitInfo": {}})
    commit(root, 6, {"commitInfo": {}})
    got = t.read()
    assert got.columns == ["id", "full name"] and rows(got) == [(1, "a")]


def test_delta_change_files(spark, tmp_path):
    root = tmp_path / "delta"
    t = DeltaTable(spark, f"file://{root}")
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.write(spark.createDataFrame([(1, "A"), (2, "b")], "id int, v string"), overwrite=True)
    spark.createDataFrame([(1, "a", "update_preimage"), (1, "A", "update_postimage")], "id int, v string, _change_type string").coalesce(1).write.parquet(f"file://{root}/_change_data")
    (name,) = (p.name for p in (root / "_change_data").glob("*.parquet"))
    log = root / "_delta_log" / f"{1:020d}.json"
    (log.parent / f".{log.name}.crc").unlink()
    log.write_text(log.read_text() + "\n" + json.dumps({"cdc": {"path": f"_change_data/{name}", "partitionValues": {}, "dataChange": False}}))
    assert rows(t.changes(0)) == [(1, "A", 1), (1, "a", -1)]


def answers(pages):
    """A service of prepared answers by (method, path, body)."""
    table = {(m, p, json.dumps(json.loads(b), sort_keys=True) if b else ""): a if isinstance(a, str) else json.dumps(a) for (m, p, b), a in pages.items()}

    def fetch(request):
        m, p, b = request
        return table[m, p, json.dumps(json.loads(b), sort_keys=True) if b else ""]

    return fetch


def test_sharepoint_source(spark):
    first, token = "/lists/l/items/delta?expand=fields", "/lists/l/items/delta?token=t"
    fetch = answers({("GET", first, ""): {"value": [{"id": "1", "fields": {"name": "one", "n": 1}}], "@odata.nextLink": "/next"}, ("GET", "/next", ""): {"value": [{"id": "2", "fields": {"name": "two"}}], "@odata.deltaLink": token}, ("GET", token, ""): {"value": [{"id": "1", "deleted": {"state": "deleted"}}]}})
    assert rows(stores.sharepoint_source(spark, "l", "name string, n int", fetch)) == [("1", "one", 1, 1), ("2", "two", None, 1)]
    since = stores.sharepoint_token("l", fetch)
    assert since == token and rows(stores.sharepoint_source(spark, "l", "name string, n int", fetch, since)) == [("1", None, None, -1)]


def test_openfga_source(spark):
    key = lambda u, o: {"user": u, "relation": "viewer", "object": o}
    body = lambda kind, **more: json.dumps({"page_size": 100, "tuple_key": {"object": f"{kind}:"}} | more)
    path, log = "/stores/s/read", "/stores/s/changes?page_size=100"
    fetch = answers(
        {
            ("POST", path, body("doc")): {"tuples": [{"key": key("user:ann", "doc:1")}], "continuation_token": "x"},
            ("POST", path, body("doc", continuation_token="x")): {"tuples": [{"key": key("group:g#member", "doc:2")}], "continuation_token": ""},
            ("POST", path, body("folder")): {"tuples": [{"key": key("user:bob", "folder:a:b")}]},
            ("GET", log, ""): {"changes": [{"tuple_key": key("user:ann", "doc:1"), "operation": "TUPLE_OPERATION_WRITE"}], "continuation_token": "y"},
            ("GET", log + "&continuation_token=y", ""): {"changes": [{"tuple_key": key("user:ann", "doc:1"), "operation": "TUPLE_OPERATION_DELETE"}], "continuation_token": "z"},
            ("GET", log + "&continuation_token=z", ""): {"changes": [], "continuation_token": "z"},
        }
    )
    assert rows(stores.openfga_source(spark, "s", fetch, ["doc", "folder"])) == [("group", "g", "member", "viewer", "doc", "2"), ("user", "ann", None, "viewer", "doc", "1"), ("user", "bob", None, "viewer", "folder", "a:b")]
    assert rows(stores.openfga_source(spark, "s", fetch, changes=True).select("_no", "_weight")) == [(0, 1), (1, -1)]


def test_spicedb_and_permify_sources(spark):
    line = lambda i, token, rel="": json.dumps({"result": {"relationship": stores._relationship({"resource_type": "doc", "resource_id": str(i), "relation": "viewer", "subject_type": "user", "subject_id": "a", "subject_relation": rel}), "afterResultCursor": {"token": token}}})
    body = lambda **more: json.dumps({"relationshipFilter": {"resourceType": "doc"}, "optionalLimit": 2} | more)
    fetch = answers({("POST", "/v1/relationships/read", body()): line(1, "p") + "\n" + line(2, "q", "member"), ("POST", "/v1/relationships/read", body(optionalCursor={"token": "q"})): line(3, "r")})
    want = [("doc", "1", "viewer", "user", "a", None), ("doc", "2", "viewer", "user", "a", "member"), ("doc", "3", "viewer", "user", "a", None)]
    assert rows(stores.spicedb_source(spark, ["doc"], fetch, page=2)) == sorted(want, key=repr)
    item = lambda i, rel: {"entity": {"type": "doc", "id": str(i)}, "relation": "viewer", "subject": {"type": "user", "id": "a", "relation": rel}}
    ask = lambda **more: json.dumps({"metadata": {"snap_token": ""}, "filter": {"entity": {"type": "doc", "ids": []}}, "page_size": 100} | more)
    path = "/v1/tenants/t/data/relationships/read"
    fetch = answers({("POST", path, ask()): {"tuples": [item(1, ""), item(2, "member")], "continuous_token": "c"}, ("POST", path, ask(continuous_token="c")): {"tuples": [item(3, "")], "continuous_token": ""}})
    assert rows(stores.permify_source(spark, "t", ["doc"], fetch)) == sorted(want, key=repr)


def test_requests():
    up, down = [{"id": 1, "v": "x"}], [{"id": 2, "v": None}]
    method, path, body = stores.elasticsearch("i", ["id"])(up, down)[0]
    lines = [json.loads(x) for x in body.strip().split("\n")]
    assert path == "/_bulk" and lines[0]["index"]["_id"] == "1" and lines[2]["delete"]["_id"] == "2"
    assert [r["__op"] for r in json.loads(stores.starrocks("d", "t")(up, down)[0][2])] == [0, 1]
    assert [r[0] for r in stores.cosmosdb("c", ["id"])(up, down)] == ["POST", "DELETE"]
    assert len(json.loads(stores.mongodb("c", ["id"])(up, down)[0][2])) == 2
    assert [r[0] for r in stores.sharepoint("l", ["id"])(up, down)] == ["PATCH", "DELETE"]
    q = stores.qdrant("c", ["id"], "v", lambda texts: [[float(len(t))] for t in texts], 4, 1)([{"id": 1, "v": "abcdefgh"}], down)
    assert len(json.loads(q[1][2])["points"]) == 3 and json.loads(q[0][2])["filter"]["must"][0]["match"]["any"] == ["1", "2"]
    rel = {"resource_type": "doc", "resource_id": "1", "relation": "viewer", "subject_type": "user", "subject_id": "a", "subject_relation": None}
    assert json.loads(stores.spicedb()([rel], [rel])[0][2])["updates"][1]["operation"] == "OPERATION_DELETE"
    assert len(stores.permify("t")([rel], [rel])) == 2
    fga = {"user_type": "user", "user_id": "a", "user_relation": None, "relation": "viewer", "object_type": "doc", "object_id": "1"}
    assert json.loads(stores.openfga("s")([fga], [])[0][2])["writes"]["tuple_keys"][0]["user"] == "user:a"
    assert "WHEN MATCHED AND s._weight < 0 THEN DELETE" in stores.merge_statement("t", "s", ["id"], ["id", "v"])


def test_send_changes_from_executors(spark, tmp_path):
    folder = str(tmp_path)

    def send(request):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(request[2])

    df = spark.createDataFrame([(1, "old", -1), (1, "new", 1), (2, "gone", -1)], "id int, v string, _weight int")
    stores.send_changes(df, stores.starrocks("d", "t"), send, ["id"])
    sent = [r for p in tmp_path.iterdir() for r in json.loads(p.read_text())]
    assert sorted((r["id"], r["v"], r["__op"]) for r in sent) == [(1, "new", 0), (2, "gone", 1)]


def test_kafka_rows(spark):
    raw = spark.createDataFrame([(b"1", b'{"a":5}', 0, 0), (b"2", None, 0, 1)], "key binary, value binary, partition int, offset bigint")
    assert rows(stores.kafka_rows(raw, "a int").select("_key", "_deleted", "a")) == [("1", False, 5), ("2", True, None)]
    out = stores.kafka_messages(spark.createDataFrame([(1, "x", 1), (2, "y", -1)], "id int, v string, _weight int"), ["id"])
    assert rows(out) == [("1", '{"id":1,"v":"x"}'), ("2", None)]


def test_generic(spark, capsys):
    df = generic.object_source(spark, "numbers", "part int, x int", lambda p: [(p, i) for i in range(2)], 2)
    assert rows(df) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert rows(generic.configuration(spark, [{"name": "a", "on": True}])) == [("a", True)]
    generic.blackhole(df)
    generic.console(df)
    assert "part" in capsys.readouterr().out
    assert rows(generic.full_load_changes(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int"))) == [(1, -1), (2, 1)]


def test_registry_catalogs(spark):
    inner = Registry().add_source("t.*", lambda s, name, schema: s.createDataFrame([(name,)], "n string"))
    r = Registry().add_catalog("cat", inner)
    assert rows(r.read(spark, "cat.t1")) == [("t1",)] and r.source_for("other") is None


def test_permissions(spark):
    rel = spark.createDataFrame(
        [("doc", "d1", "viewer", "user", "ann", None), ("doc", "d1", "viewer", "group", "g1", "member"), ("group", "g1", "member", "user", "bob", None), ("group", "g1", "member", "group", "g2", "member"), ("group", "g2", "member", "user", "cid", None), ("doc", "d1", "banned", "user", "bob", None), ("doc", "d1", "parent", "folder", "f1", None), ("folder", "f1", "parent", "folder", "f0", None), ("folder", "f0", "owner", "user", "dan", None)],
        "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string",
    )
    model = {"doc": {"view": "(viewer - banned) + parent->view"}, "folder": {"view": "owner + parent->view"}}
    got = rows(permissions.materialize_permission(rel, model, "doc", "view"))
    assert got == [("d1", "user", "ann"), ("d1", "user", "cid"), ("d1", "user", "dan")]
    assert rows(permissions.materialize_permission(rel, model, "folder", "view")) == [("f0", "user", "dan"), ("f1", "user", "dan")]


def test_jdbc_round_trip(spark):
    """Against the database that Spark itself ships; skipped where it is missing."""
    import pytest

    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:  # noqa: BLE001 - py4j wraps ClassNotFoundException
        pytest.skip("no database on the class path")
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    more = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string")
    stores.jdbc_sink(df.repartition(2), url, "things", **more)
    stores.jdbc_sink(df.limit(0), url, "things", **more)
    got = stores.jdbc_source(spark, url, "things", "id", (0, 50), 4, **more)
    assert got.rdd.getNumPartitions() == 4 and rows(got.filter("id >= 45").selectExpr("id", "name")) == [(i, f"n{i}") for i in range(45, 50)]
    stores.jdbc_sink(df.limit(3), url, "things", overwrite=True, **more)
    assert stores.jdbc_source(spark, url, "things", **more).count() == 3


def test_inherited_members_of_any_graph(spark, monkeypatch, tmp_path):
    """Trees, several parents, cycles and long chains, numbers and texts as ids: all pairs, each once,."""
    rng = random.Random(5)
    graphs = [
        [(i // 2, i) for i in range(2, 60)],
        [(rng.randrange(i), i) for i in range(1, 40) for _ in range(3)],
        [(i, i + 1) for i in range(12)] + [(12, 4), (3, 3), (20, 4)],
        [(f"g{i // 3}", f"g{i}") for i in range(1, 30)] + [("g5", "g5"), ("7", "07"), ("g1", None)],
        [(None, "2"), (1, 2), (2, 3)],
    ]
    for edges in graphs:
        nodes = sorted({x for e in edges for x in e if x is not None}, key=str) + ["007"]
        direct = [(rng.choice(nodes), f"u{rng.randrange(9)}") for _ in range(50)]
        text = lambda x: None if x is None else str(x)
        want, more = {(text(a), u) for a, u in direct}, True
        while more:
            more = {(text(a), u) for a, b in edges if b is not None for g, u in want if g == text(b)} - want
            want |= more
        out = spark.createDataFrame([(text(a), "user", u) for a, u in direct], "object_id string, subject_type string, subject_id string")
        links = spark.createDataFrame([(text(a), text(b)) for a, b in edges * 2], "object_id string, _via string")
        for most in (100_000, 2):
            monkeypatch.setattr(permissions, "ABOVE", most)
            got = [(a, b) for a, _, b in map(tuple, permissions._inherited(out, links).collect())]
            assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pairs_of_a_deep_hierarchy_are_not_moved(spark):
    """Rows that the last step shuffles are as many as the subjects' objects, not as the pairs."""
    links = spark.createDataFrame([(str(i // 2), str(i)) for i in range(2, 512)], "object_id string, _via string")
    out = spark.createDataFrame([(str(i), "user", f"u{i}") for i in range(1, 512)], "object_id string, subject_type string, subject_id string")
    found = permissions._inherited(out, links) if hasattr(permissions, "_inherited") else permissions.iterate(out, lambda new: links.join(new.withColumnRenamed("object_id", "_o"), F.col("_via") == F.col("_o")).select(*permissions.PAIR), distinct=True)
    plan = found.distinct()._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(i.bit_length() for i in range(1, 512))
    assert "Generate explode" in plan and "Exchange" not in plan[: plan.index("Generate explode")]
