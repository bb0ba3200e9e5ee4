"""Finds sources and sinks by table name."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[..., DataFrame]
Writer = Callable[[SparkSession, str, DataFrame, "list[str]", bool], None]


class Registry:
    """Regular expressions of table names with their readers and writers; catalogs by prefix.

    A reader gets (spark, table, schema or None), and the hints of FROM table WITH (…) if it has a
    fourth parameter; a writer (spark, table, frame, primary key,
    overwrite). Patterns match whole names, without case; the first that matches wins.
    """

    def __init__(self) -> None:
        self.sources: list[tuple[re.Pattern, Reader]] = []
        self.sinks: list[tuple[re.Pattern, Writer]] = []
        self.catalogs: dict[str, Registry] = {}

    def add_source(self, pattern: str, reader: Reader) -> Registry:
        self.sources.append((re.compile(pattern, re.I), reader))
        return self

    def add_sink(self, pattern: str, writer: Writer) -> Registry:
        self.sinks.append((re.compile(pattern, re.I), writer))
        return self

    def add_catalog(self, name: str, registry: Registry) -> Registry:
        """Tables ``name.*`` are looked up in ``registry`` by the rest of their name."""
        self.catalogs[name.lower()] = registry
        return self

    def _find(self, name: str, kind: str):
        head, _, rest = name.partition(".")
        if rest and head.lower() in self.catalogs:
            return self.catalogs[head.lower()]._find(rest, kind)
        return next(((f, name) for p, f in getattr(self, kind) if p.fullmatch(name)), None)

    def source_for(self, name: str) -> Reader | None:
        found = self._find(name, "sources")
        return found and found[0]

    def sink_for(self, name: str) -> Writer | None:
        found = self._find(name, "sinks")
        return found and found[0]

    def read(self, spark: SparkSession, name: str, schema: str | None = None, hints: dict[str, str] | None = None) -> DataFrame:
        found = self._find(name, "sources")
        if not found:
            raise LookupError(f"no source for {name}")
        takes_hints = len(inspect.signature(found[0]).parameters) > 3
        return found[0](spark, found[1], schema, hints or {}) if takes_hints else found[0](spark, found[1], schema)

    def write(self, spark: SparkSession, name: str, df: DataFrame, key: list[str], overwrite: bool) -> None:
        found = self._find(name, "sinks")
        if not found:
            raise LookupError(f"no sink for {name}")
        found[0](spark, found[1], df, key, overwrite)
