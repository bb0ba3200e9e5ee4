"""Incrementally maintained views on Structured Streaming.

A view is a batch query over sources. Each micro-batch brings changes of one or more sources; the
processor derives what the result changes by, and emits that. State is a log of changes per source
and one of the result: a batch writes only its own changes, and every COMPACT batches a log is
merged into a base table. A batch that is replayed after a failure finds itself committed and does
nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators.normalize import consolidate, differences, latest
from lakeloom.streaming.changes import WEIGHT, apply, upserts_to_changes

#: Batches between merges of a log into its base.
COMPACT = 16


def gathered(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of one folder together, but a large folder's rows in several tasks (and files)."""
    return df.hint("rebalance", *[F.col(c) for c in by])


class State:
    """Logs of weighted rows in a shared folder, and the batches that are committed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}")

    def _numbers(self, folder: str) -> list[int]:
        at = self._p(folder)
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit())

    def committed(self) -> int:
        """The last committed batch, -1 for none."""
        return max(self._numbers("commits"), default=-1)

    def commit(self, batch: int) -> None:
        self._fs.create(self._p(f"commits/{batch}")).close()

    def number(self, name: str, value: int) -> int:
        """A number that is set once for the life of the state."""
        at = self._p("settings")
        if self._fs.exists(at):
            for f in self._fs.listStatus(at):
                found, _, n = f.getPath().getName().rpartition("-")
                if found == name:
                    return int(n)
        self._fs.create(self._p(f"settings/{name}-{value}")).close()
        return value

    def names(self) -> list[str]:
        """The logs that there are."""
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(self._p(""))) if n != "commits" and self._fs.exists(self._p(f"{n}/log")))

    def append(self, name: str, batch: int, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Write one batch's rows, in folders ``by`` columns; they count once the batch is committed."""
        at = f"{self.path}/{name}/log/{batch}"
        (gathered(df, by).write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(at)
        if not self._fs.exists(self._p(f"{name}/schema")):
            self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/{name}/schema")
        return self.spark.read.schema(df.schema).parquet(at)

    def rows(self, name: str) -> DataFrame | None:
        """The base and all committed batches since; None before the first."""
        last = self.committed()
        base = max((b for b in self._numbers(f"{name}/base") if b <= last), default=-1)
        logs = [b for b in self._numbers(f"{name}/log") if base < b <= last]
        paths = [f"{self.path}/{name}/log/{b}" for b in logs] + ([f"{self.path}/{name}/base/{base}"] if base >= 0 else [])
        if not paths:
            return None
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/{name}/schema").first()[0]))
        if "_bucket" not in schema.names:
            return self.spark.read.schema(schema).parquet(*paths)
        out = None  # folders by bucket in every path, at most COMPACT paths and a base
        for p in paths:
            part = self.spark.read.schema(schema).parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def compact(self, name: str, merge: Callable[[DataFrame], DataFrame], by: list[str] | None = None) -> None:
        """Merge a log that has grown long; the base before it and its batches are then deleted.

        Runs after a commit. A failure in between leaves the old base and logs in use.
        """
        last = self.committed()
        bases, logs = self._numbers(f"{name}/base"), self._numbers(f"{name}/log")
        if len([b for b in logs if b > max(bases, default=-1)]) < COMPACT:
            return
        target = f"{self.path}/{name}/base"
        merged = merge(self.rows(name))
        (gathered(merged, by).write.partitionBy(*by) if by else merged.write).mode("overwrite").parquet(f"{target}/_merging")
        self._fs.rename(self._p(f"{name}/base/_merging"), self._p(f"{name}/base/{last}"))
        for old in bases:
            self._fs.delete(self._p(f"{name}/base/{old}"), True)
        for old in logs:
            if old < last:  # the last one may still be read as the batch's output
                self._fs.delete(self._p(f"{name}/log/{old}"), True)


def offsets(spark: SparkSession, checkpoint: str) -> dict[int, object]:
    """The watermark of a stream: how far each of its sources (by number) has been taken in.

    All changes up to these offsets are in the view. Empty before the first batch is committed.
    """
    jvm = spark.sparkContext._jvm
    at = lambda rest: jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/{rest}")
    fs = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at("commits")):
        return {}
    done = [int(n) for n in (f.getPath().getName() for f in fs.listStatus(at("commits"))) if n.isdigit()]
    if not done:
        return {}
    lines = [r[0] for r in spark.read.text(f"{checkpoint.rstrip('/')}/offsets/{max(done)}", wholetext=True).collect()][0].splitlines()
    return {i: None if x == "-" else json.loads(x) for i, x in enumerate(lines[2:])}


class View:
    """A maintained query.

    ``build`` maps snapshots by name to the result. ``affected`` (optional) maps a source's name
    to the result columns that its rows have under the same names: a batch then recomputes only
    the result rows (and reads only source rows) of the keys that changed. Without it the whole
    result is recomputed and compared. ``sources`` gives the primary key of upsert sources, or
    None for sources that carry weights. ``clock`` gives the time that the query reads, if it does:
    when that has moved, all rows may have changed, and a batch without changes is a tick.
    """

    def __init__(self, spark: SparkSession, path: str, sources: dict[str, list[str] | None], build: Callable[[dict[str, DataFrame]], DataFrame], affected: dict[str, list[str]] | None = None, clock: Callable[[], object] | None = None) -> None:
        self.spark, self.sources, self.build, self.affected = spark, sources, build, affected or {}
        self.clock, self._time = clock, None
        self.state = State(spark, path)

    def process(self, batch: int, changes: dict[str, DataFrame], deleted: str | None = None) -> DataFrame | None:
        """Apply one batch; its output changes (with _weight), None if it was committed before."""
        if batch <= self.state.committed():
            return None
        logs = {n: self.state.rows(n) for n in self.sources}
        deltas: dict[str, DataFrame] = {}
        for name, df in changes.items():
            key = self.sources[name]
            if key is not None and WEIGHT not in df.columns:
                df = upserts_to_changes(self._part(logs[name], df, key), df, key, deleted if deleted in df.columns else None)
            deltas[name] = self.state.append(name, batch, df)
        now = {n: deltas.get(n) if log is None else log.unionByName(deltas[n]) if n in deltas else log for n, log in logs.items()}
        if any(t is None for t in now.values()):  # no result before every source has brought something
            self._finish(batch)
            return None
        before = self.state.rows("result")
        keys = self._changed_keys(deltas)
        if self.clock is not None and self.clock() != self._time:
            self._time, keys = self.clock(), None
        if before is None or keys is None:
            result = self.build({n: apply(None, t) for n, t in now.items()})
            out = result.withColumn(WEIGHT, F.lit(1)) if before is None else differences(apply(None, before), result)
        else:
            names = keys.columns
            part = {n: apply(None, t.join(keys, names, "left_semi") if self.affected.get(n) == names else t) for n, t in now.items()}
            fresh = self.build(part).join(keys, names, "left_semi")
            out = differences(apply(None, before.join(keys, names, "left_semi")), fresh)
        out = self.state.append("result", batch, out)
        self._finish(batch)
        return out

    @staticmethod
    def _part(log: DataFrame | None, updates: DataFrame, key: list[str]) -> DataFrame | None:
        """The current rows of the updated keys."""
        return None if log is None else apply(None, log.join(updates.select(*key).distinct(), key, "left_semi"))

    def _finish(self, batch: int) -> None:
        self.state.commit(batch)
        for n in [*self.sources, "result"]:
            if batch >= COMPACT:
                self.state.compact(n, consolidate)

    def _changed_keys(self, deltas: dict[str, DataFrame]) -> DataFrame | None:
        keys = None
        for name, d in deltas.items():
            if name not in self.affected:
                return None
            k = d.select(*self.affected[name]).distinct()
            if keys is not None and keys.columns != k.columns:
                return None
            keys = k if keys is None else keys.unionByName(k).distinct()
        return keys

    def result(self) -> DataFrame | None:
        log = self.state.rows("result")
        return None if log is None else apply(None, log)

    def start(self, name: str, stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, order: str | None = None, trigger: dict | None = None):
        """Feed one source from a stream; ``sink`` gets each batch's output changes.

        Rows of one key within a batch are reduced to the last by ``order``. Before a trigger that
        goes on (such as a processing time), a stream without a checkpoint is first read to its
        present end, so the first checkpoint comes after the initial load.
        """

        def run(df: DataFrame, batch: int) -> None:
            key = self.sources[name]
            if key is not None and order is not None:
                df = latest(df, key, F.col(order))
            out = self.process(batch, {name: df})
            if out is not None and sink is not None:
                sink(out, batch)

        writer = lambda when: stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**when).start()
        if trigger and "availableNow" not in trigger and not offsets(self.spark, checkpoint):
            writer({"availableNow": True}).awaitTermination()
        return writer(trigger or {"availableNow": True})


class KeyedSink:
    """A table by primary key, fed by a change stream: a log of upserts and deletes, merged at times."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.state, self.key = State(spark, path), key

    def __call__(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.state.committed():
            return
        self.state.append("rows", batch, changes.withColumn("_batch", F.lit(batch).cast("bigint")))
        self.state.commit(batch)
        self.state.compact("rows", self._last)

    def _last(self, log: DataFrame) -> DataFrame:
        """The last row of each key; a batch's insert comes after its delete."""
        return latest(log, self.key, F.struct("_batch", WEIGHT), F.col(WEIGHT) < 0)

    def rows(self) -> DataFrame | None:
        log = self.state.rows("rows")
        return None if log is None else self._last(log).drop("_batch", WEIGHT)
