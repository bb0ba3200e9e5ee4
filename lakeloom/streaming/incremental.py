"""Views that are maintained from the changes alone, for joins and groupings.

A query of inner joins on equal columns, filters, expressions and one grouping is linear in each of
its tables, so its changes follow from a table's changes joined to the rows of the others that match
them: weights multiply along joins and add up within groups. Tables are kept as logs, once for every
column that joins look up, in buckets by that column; partial sums and result rows are kept in
buckets of their groups. A batch reads the buckets that its keys fall into, not the state.

Least and greatest values aren't linear; of the groups that a batch touches their values are kept
with weights. `shape_of` says whether a query is of this kind; others are left to `View`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.normalize import consolidate
from lakeloom.plans import dialect
from lakeloom.streaming.changes import WEIGHT, upserts_to_changes
from lakeloom.streaming.views import View

#: Buckets of a new view's logs: folders that a batch writes, and what a key's share of the state is. Shuffled bytes of a task.
BUCKETS = 16
TASK_BYTES = 4 << 20
LINEAR, ORDERED = ("count", "sum", "avg"), ("min", "max")
_NAME = re.compile(r"[A-Za-z_][\w]*")
_WORDS = set("AND OR NOT CASE WHEN THEN ELSE END AS CAST IS NULL TRUE FALSE BETWEEN LIKE RLIKE IN BIGINT INT DOUBLE STRING DECIMAL DATE TIMESTAMP TIMESTAMP_NTZ BOOLEAN INTERVAL".split())


@dataclass
class Shape:
    """tables: (name, alias); edges: (alias, column, alias, column) of equal columns; aggregates: (function, argument)."""

    tables: list[tuple[str, str]]
    edges: list[tuple[str, str, str, str]]
    conditions: list[str]
    items: list[tuple[str, str]]
    groups: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str]] = field(default_factory=list)
    having: str | None = None


def _bare(text: str) -> str:
    return "".join(text.split()).lower()


def shape_of(sql: str, sources: list[str], views: list[str]) -> Shape | None:
    """The shape of a rewritten query over ``sources`` (and tables that don't change), None for others."""
    toks = dialect.tokens(sql)
    words = [t.upper() for t in toks if not t.isspace()]
    if not words or words[0] != "SELECT" or words.count("SELECT") > 1 or {"OVER", "DISTINCT", "UNION", "EXCEPT", "INTERSECT", "EXISTS", "LEFT", "RIGHT", "FULL", "LATERAL", "CROSS", "FILTER", "LIMIT", "ORDER", "SESSION_WINDOW", dialect.NOW.upper()} & set(words) or dialect.NOW in sql:
        return None
    parts = dialect.clauses(toks)
    if "FROM" not in parts:
        return None
    source = "".join(parts["FROM"])
    pieces = re.split(r"(?i)\b(?:INNER\s+)?JOIN\b", source)
    tables, conditions = [], []
    for i, piece in enumerate(pieces):
        head, *on = re.split(r"(?i)\bON\b", piece, maxsplit=1)
        m = re.fullmatch(r"(?is)\s*([A-Za-z_]\w*)(?:\s+(?:AS\s+)?([A-Za-z_]\w*))?\s*", head)
        if not m or bool(i) != bool(on):
            return None
        tables.append((m.group(1), (m.group(2) or m.group(1)).lower()))
        conditions += [dialect.text(c) for c in dialect._conjuncts(dialect.tokens(on[0]))] if on else []
    names = [a for _, a in tables]
    known = {s.lower() for s in sources}
    if len(set(names)) < len(names) or len({t.lower() for t, _ in tables}) < len(tables) or not known & {t.lower() for t, _ in tables} or {v.lower() for v in views} & {t.lower() for t, _ in tables}:
        return None
    edges, seen = [], {names[0]}
    for c in conditions:
        m = re.fullmatch(r"(?i)\s*([A-Za-z_]\w*)\.(\w+)\s*=\s*([A-Za-z_]\w*)\.(\w+)\s*", c)
        if m and m.group(1).lower() != m.group(3).lower() and {m.group(1).lower(), m.group(3).lower()} <= set(names):
            edges.append((m.group(1).lower(), m.group(2), m.group(3).lower(), m.group(4)))
    while True:
        more = {x for a, _, b, _ in edges for x in (a, b) if {a, b} & seen} - seen
        if not more:
            break
        seen |= more
    if seen != set(names):
        return None
    if "WHERE" in parts:
        conditions.append(dialect.text(parts["WHERE"]))
    groups = []
    if "GROUP" in parts:
        by = re.sub(r"(?i)^\s*BY\b", "", "".join(parts["GROUP"]))
        groups = [dialect.text(g) for g in dialect.split_at(dialect.tokens(by))]
    shape = Shape(tables, edges, conditions, [], groups)
    for text, alias in dialect.select_items(parts["SELECT"]):
        alias = (alias or text.split(".")[-1]).strip("`\"")
        if "*" in _bare(text).replace("count(*)", "") and re.fullmatch(r"(\w+\.)?\*", _bare(text)) or not _NAME.fullmatch(alias):
            return None
        done = _replaced(text, shape)
        if done is None:
            return None
        shape.items.append((done, alias))
    if "HAVING" in parts:
        shape.having = _replaced(dialect.text(parts["HAVING"]), shape)
        if shape.having is None:
            return None
    return None if shape.aggregates and not groups else shape


def _replaced(text: str, shape: Shape) -> str | None:
    """The expression over _g0.. (groups) and _a0.. (aggregates); unchanged if nothing is grouped."""
    toks = dialect.tokens(text)
    out, i = [], 0
    grouped = {_bare(g): k for k, g in enumerate(shape.groups)}
    grouped |= {_bare(g).split(".")[-1]: k for k, g in enumerate(shape.groups) if re.fullmatch(r"[\w.]+", _bare(g)) and _bare(g).split(".")[-1] not in grouped}
    while i < len(toks):
        low = toks[i].lower()
        if low in (*LINEAR, *ORDERED) and i + 1 < len(toks) and toks[i + 1] == "(":
            end = dialect.closing(toks, i + 1)
            call = (low, dialect.text(toks[i + 2 : end]))
            if call not in shape.aggregates:
                shape.aggregates.append(call)
            out.append(f"_a{shape.aggregates.index(call)}")
            i = end + 1
            continue
        for n in range(len(toks) - i, 0, -1):
            if shape.groups and _bare("".join(toks[i : i + n])) in grouped and (i == 0 or toks[i - 1] != ".") and not toks[i].isspace():
                out.append(f"_g{grouped[_bare(''.join(toks[i : i + n]))]}")
                i += n
                break
        else:
            if shape.groups and _NAME.fullmatch(toks[i]) and toks[i].upper() not in _WORDS and (i + 1 >= len(toks) or toks[i + 1] != "("):
                return None
            out.append(toks[i])
            i += 1
    return "".join(out)


class IncrementalView(View):
    """A `View` whose batches read only the buckets of the keys that changed.

    ``buckets`` holds for a new state; one that is there keeps its number.

    Sums of doubles depend on the order of additions as in any system; decimals and integers don't.
    """

    def __init__(self, spark: SparkSession, path: str, sources: dict[str, list[str] | None], shape: Shape, table: Callable[[str], DataFrame], buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, sources, lambda t: None)
        self.buckets = self.state.number("buckets", buckets)
        self.shape, self.table = shape, table
        self.names = {s.lower(): s for s in sources}
        #: files read of the state by the last batch, and files of the state
        self.read = (0, 0)

    def _bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    # logs by column

    def _indexes(self, alias: str) -> list[str]:
        return sorted({c for a, c, b, d in self.shape.edges for x, c in ((a, c), (b, d)) if x == alias})

    def _lookup(self, alias: str, column: str, keys: DataFrame, key: str, fresh: dict[str, DataFrame], new: bool) -> DataFrame:
        """The rows of a table (with or without this batch) in the buckets of ``keys``."""
        name = dict((a, t) for t, a in self.shape.tables)[alias]
        source = self.names.get(name.lower())
        if source is None:
            return self.table(name).withColumn(WEIGHT, F.lit(1))
        rows = self._buckets(f"{source}@{column}", [r[0] for r in keys.select(self._bucket(F.col(key)).alias("b")).distinct().collect()])  # as many as buckets
        delta = fresh.get(alias)
        if rows is None:
            return delta if new and delta is not None else None
        rows = rows.drop("_bucket")
        return rows.unionByName(delta) if new and delta is not None else rows

    def _buckets(self, name: str, buckets: list[int]) -> DataFrame | None:
        rows = self.state.rows(name)
        if rows is None:
            return None
        some = rows.filter(F.col("_bucket").isin(buckets)) if buckets else rows.limit(0)
        self.read = (self.read[0] + sum(int(re.search(r"_bucket=(\d+)", f).group(1)) in buckets for f in rows.inputFiles()), self.read[1] + len(rows.inputFiles()))
        return some

    # a batch

    def process(self, batch: int, changes: dict[str, DataFrame], deleted: str | None = None) -> DataFrame | None:
        """As for any view. Tasks take TASK_BYTES of a shuffle at most, as they hold many sorted inputs at once."""
        conf, name = self.spark.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        before = conf.get(name)
        conf.set(name, str(min(TASK_BYTES, self.spark._jsparkSession.sessionState().conf().getConf(self.spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES()))))
        try:
            return self._process(batch, changes, deleted)
        finally:
            conf.set(name, before)

    def _process(self, batch: int, changes: dict[str, DataFrame], deleted: str | None) -> DataFrame | None:
        if batch <= self.state.committed():
            return None
        self.read = (0, 0)
        alias_of = {t.lower(): a for t, a in self.shape.tables}
        fresh: dict[str, DataFrame] = {}
        for name, df in changes.items():
            alias, key = alias_of[name.lower()], self.sources[name]
            if key is not None and WEIGHT not in df.columns:
                at = [r[0] for r in df.select(self._bucket(*[F.col(k) for k in key]).alias("b")).distinct().collect()]
                held = self._buckets(name, at)
                if held is not None:
                    held = self._part(held.drop("_bucket"), df, key)
                df = upserts_to_changes(held, df, key, deleted if deleted in df.columns else None)
            fresh[alias] = self.state.append(name, batch, df.withColumn("_bucket", self._bucket(*[F.col(k) for k in key or df.drop(WEIGHT).columns])), ["_bucket"]).drop("_bucket")
            for column in self._indexes(alias):
                self.state.append(f"{name}@{column}", batch, fresh[alias].withColumn("_bucket", self._bucket(F.col(column))), ["_bucket"])
        delta = None
        order = [a for _, a in self.shape.tables]
        for i, alias in enumerate(order):
            if alias in fresh:
                term = self._term(alias, fresh, {a for a in order[:i]})
                if term is not None:
                    delta = term if delta is None else delta.unionByName(term)
        out = None
        if delta is not None:
            out = self._grouped(batch, delta) if self.shape.groups else self.state.append("result", batch, consolidate(delta))
        self.state.commit(batch)
        self._compact(batch)
        return out

    def _term(self, alias: str, fresh: dict[str, DataFrame], updated: set[str]) -> DataFrame | None:
        """The changes of one table joined to the other tables, those in ``updated`` with their changes."""
        weight = lambda df, a: df.withColumnRenamed(WEIGHT, f"_w_{a}")
        out, seen = weight(fresh[alias], alias).alias(alias), {alias}
        while len(seen) < len(self.shape.tables):
            a, ca, b, cb = next((e if e[0] in seen else (e[2], e[3], e[0], e[1])) for e in self.shape.edges if (e[0] in seen) != (e[2] in seen))
            keys = out.select(F.col(f"{a}.{ca}").alias("_key"))
            rows = self._lookup(b, cb, keys, "_key", fresh, b in updated)
            if rows is None:
                return None
            out = out.join(weight(rows, b).alias(b), F.col(f"{a}.{ca}") == F.col(f"{b}.{cb}"))
            seen.add(b)
        for c in self.shape.conditions:
            out = out.filter(F.expr(c))
        product = F.lit(1)
        for a in seen:
            product = product * F.col(f"_w_{a}")
        if not self.shape.groups:
            return out.select(*[F.expr(t).alias(n) for t, n in self.shape.items], product.cast("int").alias(WEIGHT))
        given = [F.expr(g).alias(f"_g{i}") for i, g in enumerate(self.shape.groups)]
        args = [(F.lit(1) if x == "*" else F.expr(x)).alias(f"_x{i}") for i, (_, x) in enumerate(self.shape.aggregates)]
        return out.select(*given, *args, product.cast("bigint").alias(WEIGHT))

    def _grouped(self, batch: int, delta: DataFrame) -> DataFrame:
        groups = [f"_g{i}" for i in range(len(self.shape.groups))]
        w, x = F.col(WEIGHT), lambda i: F.col(f"_x{i}")
        key = F.to_json(F.struct(*groups))
        sums = [F.sum(w).alias("_n")]
        for i, (f, arg) in enumerate(self.shape.aggregates):
            if f in LINEAR:
                sums.append(F.coalesce(F.sum(F.when(x(i).isNotNull(), w)), F.lit(0)).alias(f"_c{i}"))
                if f != "count":
                    sums.append(F.sum(x(i) * w).alias(f"_s{i}"))
        parts = delta.groupBy(*groups).agg(*sums).withColumn("_k", key)
        parts = self.state.append("partials", batch, parts.withColumn("_bucket", self._bucket(F.col("_k"))), ["_bucket"])
        keys = parts.select("_k")  # one row a group
        at = [r[0] for r in parts.select("_bucket").distinct().collect()]
        own = self._buckets("partials", at)
        own = parts if own is None else own.unionByName(parts)
        sums = [c for c in parts.columns if c[:2] in ("_n", "_c", "_s")]
        total = own.join(keys, "_k", "left_semi").groupBy("_k", *groups).agg(*[F.sum(c).alias(c) for c in sums]).filter("_n > 0")
        ordered = [i for i, (f, _) in enumerate(self.shape.aggregates) if f in ORDERED]
        for i in ordered:
            values = delta.select(key.alias("_k"), x(i).alias("_x"), w).filter(x(i).isNotNull()).groupBy("_k", "_x").agg(F.sum(w).alias(WEIGHT))
            values = self.state.append(f"values{i}", batch, values.withColumn("_bucket", self._bucket(F.col("_k"))), ["_bucket"])
            held = self._buckets(f"values{i}", at)
            held = values if held is None else held.unionByName(values)
            alive = held.join(keys, "_k", "left_semi").groupBy("_k", "_x").agg(F.sum(WEIGHT).alias("_n")).filter("_n > 0")
            best = (F.min if self.shape.aggregates[i][0] == "min" else F.max)("_x")
            total = total.join(alive.groupBy("_k").agg(best.alias(f"_a{i}")), "_k", "left")
        for i, (f, _) in enumerate(self.shape.aggregates):
            some = F.col(f"_c{i}") > 0
            if f == "count":
                total = total.withColumn(f"_a{i}", F.col(f"_c{i}"))
            elif f == "sum":
                total = total.withColumn(f"_a{i}", F.when(some, F.col(f"_s{i}")))
            elif f == "avg":
                total = total.withColumn(f"_a{i}", F.when(some, F.col(f"_s{i}") / F.col(f"_c{i}")))
        if self.shape.having:
            total = total.filter(F.expr(self.shape.having))
        rows = total.select("_k", *[F.expr(t).alias(n) for t, n in self.shape.items], F.lit(1).alias(WEIGHT))
        before = self._buckets("result", at)
        if before is not None:
            before = before.drop("_bucket").join(keys, "_k", "left_semi")
            rows = rows.unionByName(before.withColumn(WEIGHT, -F.col(WEIGHT)))
        out = consolidate(rows).withColumn("_bucket", self._bucket(F.col("_k")))
        return self.state.append("result", batch, out, ["_bucket"]).drop("_k", "_bucket")

    def _compact(self, batch: int) -> None:
        for name in self.state.names():
            if name == "partials":
                groups = [f"_g{i}" for i in range(len(self.shape.groups))]
                merge = lambda df: df.groupBy("_k", "_bucket", *groups).agg(*[F.sum(c).alias(c) for c in df.columns if c[:2] in ("_n", "_c", "_s")]).filter("_n <> 0").select(df.columns)
            else:
                merge = lambda df: consolidate(df).select(df.columns)
            self.state.compact(name, merge, ["_bucket"] if name != "result" or self.shape.groups else [])

    def result(self) -> DataFrame | None:
        out = super().result()
        return out.drop("_k", "_bucket") if out is not None else None
