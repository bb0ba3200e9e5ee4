"""Runs dialect statements: tables from connectors, views, inserts into sinks, queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import dialect
from lakeloom.session import configure
from lakeloom.sources.registry import Registry
from lakeloom.streaming.incremental import BUCKETS, IncrementalView, shape_of
from lakeloom.streaming.views import View


class Engine:
    """One session's tables, views, functions and sinks.

    ``registry`` finds sources and sinks by table name; names that it doesn't know must be tables
    or views of the session. Python scalar, aggregate, window and table functions are registered
    with ``function`` and used by name; names that stand for SQL with ``expression``.

    gettimestamp() is the time of ``clock`` (UTC), taken again once ``tick`` seconds have passed: all
    of a query, and of a maintained view's batch, see one time. Failures of check_value and
    check_true in the statements of the last `sql` are rows of `violations`.

    ``substream`` runs only the statements of that SUBSTREAM (and those before the first); others'
    are left to the engines that share the work.
    """

    def __init__(self, spark: SparkSession, registry: Registry | None = None, clock: Callable[[], datetime] | None = None, tick: float = 3600, substream: str | None = None) -> None:
        self.spark = configure(spark)
        self.registry = registry or Registry()
        self.schemas: dict[str, str] = {}
        self.clock, self.tick, self.substream = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None)), tick, substream
        self._now: datetime | None = None
        self._checks: list[str] = []
        self._hints: dict[str, dict[str, str]] = {}

    def function(self, name: str, f: Callable) -> None:
        """Register a (pandas) UDF, grouped-aggregate UDF or UDTF for SQL."""
        if hasattr(f, "_judf") or hasattr(f, "evalType"):
            (self.spark.udtf if type(f).__name__ == "UserDefinedTableFunction" else self.spark.udf).register(name, f)
        else:
            self.spark.udf.register(name, f)

    @staticmethod
    def expression(name: str, to_sql: Callable, kind: str = "scalar") -> None:
        """Let a name stand for a scalar, aggregate or window expression (see `dialect.register`)."""
        dialect.register(name, to_sql, kind)

    def now(self) -> datetime:
        """The time that gettimestamp() has: of the clock, at most ``tick`` seconds old."""
        time = self.clock()
        if self._now is None or (time - self._now).total_seconds() >= self.tick:
            self._now = time
        return self._now

    def violations(self) -> DataFrame:
        """message and tags of the rows that failed a data check in the last `sql`."""
        out = self.spark.createDataFrame([], "message string, tags map<string,string>")
        for check in self._checks:
            out = out.unionByName(self.frame(check))
        return out

    def sql(self, text: str) -> list[DataFrame]:
        """Run all statements; the frames of the queries, and what was inserted, in order."""
        out, current = [], None
        self._checks = []
        for s in dialect.statements(text):
            if s.kind == "substream":
                current = s.name
            elif self.substream is not None and current is not None and current.lower() != self.substream.lower():
                continue
            self._checks += s.checks
            self._hints = s.hints
            if s.kind == "create_table":
                self._create_table(s)
            elif s.kind == "create_view":
                df = self.frame(s.sql)
                if s.options.get("SCATTER_BY"):
                    df = df.repartition(*([int(s.options["PARTITION_COUNT"])] if "PARTITION_COUNT" in s.options else []), s.options["SCATTER_BY"])
                df.createOrReplaceTempView(s.name)
            elif s.kind == "insert":
                df = self.frame(s.sql)
                if s.columns:
                    df = df.toDF(*[c for c, _ in s.columns])
                self._validate_key(s, df)
                self.registry.write(self.spark, s.name, df, s.primary_key, s.overwrite)
                out.append(df)
            elif s.kind == "query":
                out.append(self.frame(s.sql))
        return out

    def query(self, text: str) -> DataFrame:
        """The frame of the last query."""
        return self.sql(text)[-1]

    def maintain(self, text: str, sources: dict[str, list[str] | None], path: str, affected: dict[str, list[str]] | None = None, buckets: int = BUCKETS) -> View:
        """A view that keeps the last query of ``text`` up to date as its sources change.

        ``sources`` names the tables that change with their primary keys (None: they carry
        weights); ``path`` holds the state. Feed it with `View.process` or `View.start`. Joins,
        filters and a grouping are maintained from the changes alone, and a batch reads only some of
        the state's ``buckets`` (see `incremental`). For other queries ``affected`` may tell which
        result columns a source's rows have, so that only their rows are computed again.
        """
        *before, last = dialect.statements(text)
        shape = shape_of(last.sql, list(sources), [s.name for s in before if s.kind == "create_view"]) if affected is None else None
        if shape is not None:
            return IncrementalView(self.spark, path, sources, shape, self._table, buckets)

        def build(tables: dict[str, DataFrame]) -> DataFrame:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            for s in before:
                if s.kind == "create_view":
                    self.frame(s.sql).createOrReplaceTempView(s.name)
            return self.frame(last.sql)

        timed = any(dialect.NOW in s.sql for s in [*before, last])
        return View(self.spark, path, sources, build, affected, self.now if timed else None)

    def frame(self, sql: str) -> DataFrame:
        """A rewritten query; select aliases may appear in WHERE."""
        if dialect.NOW in sql:
            sql = sql.replace(dialect.NOW, f"TIMESTAMP_NTZ '{self.now():%Y-%m-%d %H:%M:%S.%f}'")
        for name in re.findall(r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)", sql):
            self._resolve(name)
        try:
            return self.spark.sql(sql)
        except AnalysisException as e:
            moved = dialect.aliases_in_where(sql) if "UNRESOLVED_COLUMN" in str(e) or "WINDOW" in str(e).upper() else None
            if not moved:
                raise
            return self.spark.sql(moved)

    def _table(self, name: str) -> DataFrame:
        self._resolve(name)
        return self.spark.table(name)

    def _resolve(self, name: str) -> None:
        """Make a registry table readable by name."""
        view = name.replace(".", "_") if "." in name else name
        hints = self._hints.get(name.lower())
        if self.registry.source_for(name) and (hints or not self.spark.catalog.tableExists(view)):
            self.registry.read(self.spark, name, self.schemas.get(name.lower()), hints).createOrReplaceTempView(view)

    def _create_table(self, s: dialect.Statement) -> None:
        self.schemas[s.name.lower()] = ", ".join(f"`{c}` {dialect.spark_type(t)}" for c, t in s.columns)
        if self.registry.source_for(s.name):
            self.registry.read(self.spark, s.name, self.schemas[s.name.lower()]).createOrReplaceTempView(s.name)

    @staticmethod
    def _validate_key(s: dialect.Statement, df: DataFrame) -> None:
        missing = [k for k in s.primary_key if k not in df.columns]
        if missing:
            raise dialect.DialectError(f"primary key columns {missing} aren't among the inserted")
