"""Delta tables by their published log protocol, without an extension on the class path.

Reads snapshots (JSON commits and Parquet checkpoints, partition values, column mapping by name
or id, deletion vectors) and changes between versions, and commits appends and overwrites,
partitioned or not. If the delta format is installed, that does the reading.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def installed(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
    except Exception:  # noqa: BLE001 - py4j wraps ClassNotFoundException
        return False
    return True


#: Up to so many files a table of their partition values is broadcast.
BROADCAST_FILES = 100_000
_SCHEME = re.compile("^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+")
_Z85 = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#")}


def z85_decode(text: str) -> bytes:
    """Base 85 as ZeroMQ defines it: five signs are four bytes."""
    out = b""
    for i in range(0, len(text), 5):
        n = 0
        for c in text[i : i + 5]:
            n = n * 85 + _Z85[c]
        out += n.to_bytes(4, "big")
    return out


def roaring_positions(data: bytes) -> np.ndarray:
    """The row numbers of a deletion vector: a magic number, then 32-bit Roaring bitmaps by high word."""
    if int.from_bytes(data[:4], "little") != 1681511377:
        raise ValueError("not a deletion vector in the portable format")
    out, at = [np.zeros(0, np.int64)], 12
    for _ in range(int.from_bytes(data[4:12], "little")):
        high = int.from_bytes(data[at : at + 4], "little") << 32
        low, at = _roaring(data, at + 4)
        out.append(low + high)
    return np.concatenate(out)


def _roaring(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """(values, where the bitmap ends) of one bitmap in the portable format."""
    word = lambda i, n: int.from_bytes(data[i : i + n], "little")
    cookie, runs, start = word(at, 4), b"", at
    if cookie & 0xFFFF == 12347:
        n = (cookie >> 16) + 1
        runs, at = data[at + 4 : at + 4 + (n + 7) // 8], at + 4 + (n + 7) // 8
    elif cookie == 12346:
        n, at = word(at + 4, 4), at + 8
    else:
        raise ValueError(f"unknown bitmap at {start}")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n + (4 * n if not runs or n >= 4 else 0)
    out = [np.zeros(0, np.int64)]
    for i, (key, count) in enumerate(heads.tolist()):
        if runs and runs[i // 8] >> (i % 8) & 1:
            k = word(at, 2)
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs.tolist()]) if k else out[0]
            at += 2 + 4 * k
        elif count < 4096:
            low = np.frombuffer(data, "<u2", count + 1, at).astype(np.int64)
            at += 2 * (count + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(low + (key << 16))
    return np.concatenate(out), at


class DeltaTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_delta_log")
        self._fs = self._fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log_files(self) -> list[str]:
        if not self._fs.exists(self._fs_path):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._fs_path))

    def versions(self) -> list[int]:
        return [int(f[:20]) for f in self._log_files() if f.endswith(".json") and f[:20].isdigit()]

    def _actions(self, version: int) -> list[dict]:
        rows = self.spark.read.text(f"{self.path}/_delta_log/{version:020d}.json").collect()  # one commit
        return [json.loads(r[0]) for r in rows if r[0].strip()]

    def _state(self, version: int | None) -> tuple[dict, dict[str, dict], int]:
        """(metadata, active files by path, version)."""
        versions = self.versions()
        last = version if version is not None else max(versions, default=-1)
        points = sorted({int(f[:20]) for f in self._log_files() if ".checkpoint" in f and f[:20].isdigit() and int(f[:20]) <= last})
        meta, files, start = {}, {}, 0
        if points:
            start = points[-1] + 1
            rows = self.spark.read.parquet(f"{self.path}/_delta_log/{points[-1]:020d}.checkpoint*.parquet")
            for r in rows.select(*[c for c in ("metaData", "add") if c in rows.columns]).collect():
                d = r.asDict(True)
                if d.get("metaData"):
                    meta = d["metaData"]
                if d.get("add"):
                    files[d["add"]["path"]] = d["add"]
        for v in range(start, last + 1):
            if v not in versions:
                raise FileNotFoundError(f"version {v} of {self.path}")
            actions = self._actions(v)
            for a in actions:  # a commit may add a file again with another deletion vector
                if "metaData" in a:
                    meta = a["metaData"]
                elif "remove" in a:
                    files.pop(a["remove"]["path"], None)
            files |= {a["add"]["path"]: a["add"] for a in actions if "add" in a}
        return meta, files, last

    def _frame(self, meta: dict, files: list[dict]) -> DataFrame:
        """One scan of all files; partition values and deletion vectors are joined by file."""
        schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        parts = list(meta.get("partitionColumns") or [])
        physical = {f.name: (f.metadata or {}).get("delta.columnMapping.physicalName", f.name) for f in schema}
        stored = T.StructType([T.StructField(physical[f.name], f.dataType, True) for f in schema if f.name not in parts])
        paths = [self._at(f["path"]) for f in files]
        rows = self.spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*paths)
        marked = [f for f in files if f.get("deletionVector")]
        if parts or marked:
            at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            rows = rows.select(*[F.col(f"`{n}`") for n in stored.names], F.regexp_replace(at, _SCHEME.pattern, "/").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if marked:
            rows = rows.join(self._deleted(marked), ["_file", "_row"], "left_anti")
        if parts:
            values = []
            for f, path in zip(files, paths):
                own = dict(f.get("partitionValues") or {})
                values.append((_SCHEME.sub("/", path), *[own.get(physical[p], own.get(p)) for p in parts]))
            of_file = self.spark.createDataFrame(values, ", ".join(["_file string", *[f"_p{i} string" for i in range(len(parts))]]))
            rows = rows.join(F.broadcast(of_file) if len(values) <= BROADCAST_FILES else of_file, "_file")
        return rows.select(*[(F.col(f"_p{parts.index(f.name)}").cast(f.dataType) if f.name in parts else F.col(f"`{physical[f.name]}`")).alias(f.name) for f in schema])

    def _at(self, path: str) -> str:
        """The location of a file of the log, whose names are URL-encoded."""
        path = unquote(path)
        return path if "://" in path or path.startswith("/") else f"{self.path}/{path}"

    def _deleted(self, files: list[dict]) -> DataFrame:
        """_file and _row of the rows that deletion vectors mark; they are decoded on the executors."""
        inline, stored = [], []
        for f in files:
            d, name = f["deletionVector"], _SCHEME.sub("/", self._at(f["path"]))
            if d["storageType"] == "i":
                inline.append((name, bytearray(z85_decode(d["pathOrInlineDv"]))))
                continue
            at = self._at(d["pathOrInlineDv"])
            if d["storageType"] == "u":
                prefix, code = d["pathOrInlineDv"][:-20], d["pathOrInlineDv"][-20:]
                at = "/".join(x for x in (self.path, prefix, f"deletion_vector_{uuid.UUID(bytes=z85_decode(code))}.bin") if x)
            stored.append((name, at, _SCHEME.sub("/", at), int(d.get("offset") or 0) + 5, int(d["sizeInBytes"])))
        vectors = self.spark.createDataFrame(inline, "_file string, vector binary")
        if stored:
            where = self.spark.createDataFrame(stored, "_file string, at string, name string, start int, size int")
            content = self.spark.read.format("binaryFile").load(sorted({x[1] for x in stored}))
            content = content.select(F.regexp_replace("path", _SCHEME.pattern, "/").alias("name"), "content")
            vectors = vectors.unionByName(where.join(content, "name").select("_file", F.expr("substring(content, start, size)").alias("vector")))

        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    rows_ = roaring_positions(bytes(batch["vector"].iloc[i]))
                    yield pd.DataFrame({"_file": batch["_file"].iloc[i], "_row": rows_})

        return vectors.mapInPandas(run, "_file string, _row bigint")

    def read(self, version: int | None = None) -> DataFrame:
        if installed(self.spark):
            reader = self.spark.read.format("delta")
            return (reader.option("versionAsOf", version) if version is not None else reader).load(self.path)
        meta, files, _ = self._state(version)
        return self._frame(meta, list(files.values()))

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Rows with _weight that lead from version ``start`` to ``end``: change files if a commit has
        them, else the rows of added and removed files; rewritten equal rows cancel out."""
        end = end if end is not None else max(self.versions())
        meta, _, _ = self._state(end)
        out = None
        for v in range(start + 1, end + 1):
            actions = self._actions(v)
            cdc = [a["cdc"] for a in actions if "cdc" in a]
            if cdc:
                schema = json.loads(meta["schemaString"])
                schema["fields"] = schema["fields"] + [{"name": "_change_type", "type": "string", "nullable": True, "metadata": {}}]
                df = self._frame(meta | {"schemaString": json.dumps(schema)}, cdc).filter(F.col("_change_type") != "none")
                sign = F.when(F.col("_change_type").isin("insert", "update_postimage"), 1).otherwise(-1)
                steps = [df.withColumn("_weight", sign).drop("_change_type")]
            else:
                steps = []
                for kind, w in (("add", 1), ("remove", -1)):
                    files = [a[kind] for a in actions if kind in a and a[kind].get("dataChange", True)]
                    if files:
                        steps.append(self._frame(meta, files).withColumn("_weight", F.lit(w)))
            for s in steps:
                out = s if out is None else out.unionByName(s)
        if out is None:
            return self.read(end).limit(0).withColumn("_weight", F.lit(1))
        names = [c for c in out.columns if c != "_weight"]
        return out.groupBy(*names).agg(F.sum("_weight").cast("int").alias("_weight")).filter("_weight <> 0")

    def write(self, df: DataFrame, overwrite: bool = False, partition_by: list[str] | None = None) -> int:
        """Commit an append or an overwrite; the version written. The commit file must not exist.

        A new or overwritten table is partitioned by ``partition_by``; appends follow the table.
        """
        versions = self.versions()
        version = max(versions, default=-1) + 1
        meta, files, _ = self._state(None) if versions else ({}, {}, -1)
        parts = list(meta.get("partitionColumns") or []) if versions and not overwrite else list(partition_by or [])
        folder = f"part-{uuid.uuid4().hex}"
        (df.write.partitionBy(*parts) if parts else df.write).parquet(f"{self.path}/{folder}")
        now = int(time.time() * 1000)
        actions: list[dict] = [{"commitInfo": {"timestamp": now, "operation": "WRITE"}}]
        if not versions:
            actions.append({"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}})
        if not versions or overwrite:
            actions.append({"metaData": {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": parts, "configuration": {}, "createdTime": now}})
        if overwrite:
            actions += [{"remove": {"path": p, "deletionTimestamp": now, "dataChange": True, "partitionValues": f.get("partitionValues") or {}} | ({"deletionVector": f["deletionVector"]} if f.get("deletionVector") else {})} for p, f in files.items()]
        found = self._fs.listFiles(self._fs_path.getParent().suffix("/" + folder), True)
        while found.hasNext():
            status = found.next()
            name = status.getPath().toUri().getPath()
            name = name[name.index(folder) :]
            if not name.endswith(".parquet"):
                continue
            values = {}
            for piece in name.split("/")[1:-1]:
                k, v = (unquote(x) for x in piece.split("=", 1))
                values[k] = None if v == "__HIVE_DEFAULT_PARTITION__" else v
            actions.append({"add": {"path": quote(name, safe="/=-_."), "partitionValues": values, "size": status.getLen(), "modificationTime": now, "dataChange": True}})
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_delta_log/{version:020d}.json")
        stream = self._fs.create(target, False)
        stream.write(bytearray("\n".join(json.dumps(a) for a in actions).encode()))
        stream.close()
        return version


def source(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return DeltaTable(spark, path).read(version)
