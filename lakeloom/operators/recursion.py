"""Fixpoint iteration: the recursive part is applied to the new rows until none is left."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_paths: list = []


def _release() -> None:
    """Delete the tables that iterations left in the shared folder."""
    for spark, path in _paths:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; only a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_release)
    _paths.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, max_iterations: int | None = None, until: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``start`` and all that ``step`` derives from it, semi-naively: each round sees only new rows.

    UNION ALL semantics end on acyclic data, or after ``max_iterations``; ``distinct`` drops rows
    (or ``keys``) seen before and so ends on cycles too. Rows that ``until`` drops are returned
    but not iterated further (the skip condition).
    """
    new = written(start.distinct() if distinct else start, "iteration")
    parts, rounds = [(new, 0)], 0
    while (max_iterations is None or rounds < max_iterations) and not new.isEmpty():
        more = step(until(new) if until else new)
        if distinct:
            names = keys or more.columns
            seen = _union(p for p, _ in parts)
            more = more.dropDuplicates(names)
            condition = [more[c].eqNullSafe(F.col(f"_s_{c}")) for c in names]
            more = more.join(seen.select(*[F.col(c).alias(f"_s_{c}") for c in names]), condition, "left_anti")
        new = written(more.select(*start.columns), "iteration")
        parts.append((new, 0))
        # as in a binary counter: there are as many tables as the number of rounds has digits
        while len(parts) > 1 and parts[-1][1] == parts[-2][1]:
            (a, level), (b, _) = parts[-2:]
            parts[-2:] = [(written(a.unionByName(b), "iteration"), level + 1)]
        rounds += 1
    return _union(p for p, _ in parts)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out
