"""Plans in Substrait's JSON form as DataFrames.

Relations are read bottom up; columns are numbered, as references in plans are by position, and get
the root's names at the end. What a plan says is declared only: Catalyst chooses how to run it.
Functions are known by the name before the colon of their declaration.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import math, strings
from lakeloom.operators import aggregates


class PlanError(ValueError):
    """The plan isn't valid, or uses what isn't supported."""


JOINS = {"INNER": "inner", "OUTER": "full", "LEFT": "left", "RIGHT": "right", "LEFT_SEMI": "left_semi", "SEMI": "left_semi", "LEFT_ANTI": "left_anti", "ANTI": "left_anti"}
TYPES = {"bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "fp32": "float", "fp64": "double", "string": "string", "varchar": "string", "fixedChar": "string", "binary": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestampTz": "timestamp", "uuid": "string"}

SCALAR: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "is_not_distinct_from": lambda a, b: a.eqNullSafe(b),
    "is_distinct_from": lambda a, b: ~a.eqNullSafe(b),
    "and": lambda *a: reduce(lambda x, y: x & y, a),
    "or": lambda *a: reduce(lambda x, y: x | y, a),
    "not": lambda a: ~a,
    "xor": math.xor,
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": math.divide,
    "modulus": lambda a, b: a % b,
    "negate": lambda a: -a,
    "abs": F.abs,
    "power": F.pow,
    "sqrt": F.sqrt,
    "ceil": F.ceil,
    "floor": F.floor,
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
    "coalesce": F.coalesce,
    "nullif": F.nullif,
    "between": lambda x, lo, hi: x.between(lo, hi),
    "concat": F.concat,
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "char_length": F.char_length,
    "substring": F.substr,
    "replace": F.replace,
    "starts_with": strings.starts_with,
    "contains": F.contains,
    "strpos": strings.strpos,
    "least": F.least,
    "greatest": F.greatest,
}
AGGREGATE: dict[str, Callable[..., Column]] = {
    "count": lambda *x: F.count(x[0]) if x else F.count("*"),
    "sum": F.sum,
    "sum0": aggregates.sum0,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "any_value": F.any_value,
    "list_agg": aggregates.list_agg,
}
DISTINCT = {"count": F.count_distinct, "sum": F.sum_distinct}


class Reader:
    """One plan; ``table`` gives the frames of named tables."""

    def __init__(self, spark: SparkSession, plan: dict[str, Any] | str, table: Callable[[str], DataFrame] | None = None) -> None:
        self.spark, self.plan = spark, json.loads(plan) if isinstance(plan, str) else plan
        self.table = table or spark.table
        self.names: dict[int, str] = {}
        for x in self.plan.get("extensions", []):
            f = x.get("extensionFunction")
            if f:
                self.names[int(f.get("functionAnchor", 0))] = f["name"].partition(":")[0].lower()
        self.shared = [r for r in self.plan.get("relations", [])]

    def frame(self) -> DataFrame:
        """The result of the first root, with its names."""
        for r in self.shared:
            if "root" in r:
                df = self.relation(r["root"]["input"])
                names = r["root"].get("names") or df.columns
                if len(names) != len(df.columns):
                    raise PlanError(f"{len(names)} names for {len(df.columns)} columns")
                return df.toDF(*names)
        raise PlanError("the plan has no root")

    # relations

    def relation(self, rel: dict[str, Any]) -> DataFrame:
        kind = next((k for k in rel if hasattr(self, f"_{k}")), None)
        if kind is None:
            raise PlanError(f"unsupported relation {sorted(rel)}")
        body = rel[kind]
        df = getattr(self, f"_{kind}")(body)
        emit = (body.get("common") or {}).get("emit")
        if emit is not None:
            df = df.select(*[F.col(f"`{df.columns[int(i)]}`").alias(f"e{n}") for n, i in enumerate(emit.get("outputMapping", []))])
        return self._numbered(df)

    @staticmethod
    def _numbered(df: DataFrame) -> DataFrame:
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def _read(self, r: dict) -> DataFrame:
        names = (r.get("baseSchema") or {}).get("names", [])
        if "virtualTable" in r:
            kinds = [self.type_of(t) for t in r["baseSchema"]["struct"]["types"]]
            rows = [v.get("fields", []) for v in r["virtualTable"].get("values", [])]
            schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
            df = self.spark.createDataFrame([], schema)
            if rows:
                one = self.spark.range(1)
                cells = F.array(*[F.struct(*[self.literal(f).cast(k).alias(f"c{i}") for i, (f, k) in enumerate(zip(fields, kinds))]) for fields in rows])
                df = one.select(F.explode(cells).alias("v")).select("v.*")
        elif "namedTable" in r:
            df = self.table(".".join(r["namedTable"]["names"])).select(*[F.col(f"`{n}`") for n in names])
        else:
            raise PlanError("a read needs a named or virtual table")
        df = self._numbered(df)
        if r.get("filter"):
            df = df.filter(self.expression(r["filter"], df))
        items = ((r.get("projection") or {}).get("select") or {}).get("structItems")
        return df.select(*[df.columns[int(i.get("field", 0))] for i in items]) if items is not None else df

    def _filter(self, r: dict) -> DataFrame:
        df = self.relation(r["input"])
        return df.filter(self.expression(r["condition"], df))

    def _project(self, r: dict) -> DataFrame:
        df = self.relation(r["input"])
        return df.select("*", *[self.expression(e, df).alias(f"p{i}") for i, e in enumerate(r.get("expressions", []))])

    def _join(self, r: dict) -> DataFrame:
        left, right = self.relation(r["left"]), self.relation(r["right"])
        kind = JOINS.get(str(r.get("type", "")).removeprefix("JOIN_TYPE_"))
        if kind is None:
            raise PlanError(f"unsupported join {r.get('type')}")
        right = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
        names = [*left.columns, *right.columns]
        out = left.join(right, self.expression(r["expression"], names), kind)
        if r.get("postJoinFilter"):
            out = out.filter(self.expression(r["postJoinFilter"], names))
        return out

    def _cross(self, r: dict) -> DataFrame:
        right = self.relation(r["right"])
        return self.relation(r["left"]).join(right.toDF(*[f"r{i}" for i in range(len(right.columns))]))

    def _aggregate(self, r: dict) -> DataFrame:
        df = self.relation(r["input"])
        groupings = r.get("groupings") or [{}]
        if len(groupings) > 1:
            raise PlanError("one grouping only")
        shared = r.get("groupingExpressions", [])
        given = groupings[0].get("groupingExpressions") or [shared[int(i)] for i in groupings[0].get("expressionReferences", [])]
        keys = [self.expression(e, df).alias(f"g{i}") for i, e in enumerate(given)]
        measures = []
        for i, m in enumerate(r.get("measures", [])):
            f = m["measure"]
            name = self.names[int(f.get("functionReference", 0))]
            distinct = str(f.get("invocation", "")).endswith("DISTINCT")
            known = DISTINCT if distinct else AGGREGATE
            if name not in known:
                raise PlanError(f"unknown aggregate {name}")
            args = self.arguments(f, df)
            if m.get("filter"):
                condition = self.expression(m["filter"], df)
                args = [F.when(condition, x) for x in args or [F.lit(1)]]
            measures.append(known[name](*args).alias(f"m{i}"))
        if not measures:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*measures)

    def _sort(self, r: dict) -> DataFrame:
        df = self.relation(r["input"])
        return df.orderBy(*[self.order(s, df) for s in r.get("sorts", [])])

    def order(self, s: dict, df: DataFrame) -> Column:
        x, way = self.expression(s["expr"], df), str(s.get("direction", "SORT_DIRECTION_ASC_NULLS_FIRST")).removeprefix("SORT_DIRECTION_").lower()
        if way not in ("asc_nulls_first", "asc_nulls_last", "desc_nulls_first", "desc_nulls_last"):
            raise PlanError(f"unsupported direction {way}")
        return getattr(x, way)()

    def _fetch(self, r: dict) -> DataFrame:
        if "sort" not in r["input"]:
            raise PlanError("a fetch needs a sorted input")
        return self.relation(r["input"]).offset(int(r.get("offset", 0))).limit(int(r.get("count", 0)))

    def _set(self, r: dict) -> DataFrame:
        ops = {"UNION_ALL": "unionAll", "UNION_DISTINCT": "union", "INTERSECTION_MULTISET": "intersect", "INTERSECTION_MULTISET_ALL": "intersectAll", "MINUS_PRIMARY": "subtract", "MINUS_PRIMARY_ALL": "exceptAll"}
        op = str(r.get("op", "")).removeprefix("SET_OP_")
        if op not in ops:
            raise PlanError(f"unsupported set operation {op}")
        out = reduce(lambda a, b: getattr(a, ops[op])(b), [self.relation(x) for x in r["inputs"]])
        return out.distinct() if op == "UNION_DISTINCT" else out

    def _reference(self, r: dict) -> DataFrame:
        other = self.shared[int(r.get("subtreeOrdinal", 0))]
        return self.relation(other["rel"] if "rel" in other else other["root"]["input"])

    # expressions

    def expression(self, e: dict, of: DataFrame | list[str]) -> Column:
        names = of if isinstance(of, list) else of.columns
        if "literal" in e:
            return self.literal(e["literal"])
        if "selection" in e:
            at = (e["selection"].get("directReference") or {}).get("structField")
            if at is None:
                raise PlanError("only references to fields are supported")
            out = F.col(f"`{names[int(at.get('field', 0))]}`")
            while at.get("child"):
                raise PlanError("references into structs aren't supported")
            return out
        if "scalarFunction" in e:
            f = e["scalarFunction"]
            name = self.names[int(f.get("functionReference", 0))]
            if name not in SCALAR:
                raise PlanError(f"unknown function {name}")
            return SCALAR[name](*self.arguments(f, names))
        if "cast" in e:
            return self.expression(e["cast"]["input"], names).try_cast(self.type_of(e["cast"]["type"]))
        if "ifThen" in e:
            out = F
            for x in e["ifThen"]["ifs"]:
                out = out.when(self.expression(x["if"], names), self.expression(x["then"], names))
            return out.otherwise(self.expression(e["ifThen"]["else"], names)) if e["ifThen"].get("else") else out
        if "singularOrList" in e:
            return self.expression(e["singularOrList"]["value"], names).isin(*[self.expression(x, names) for x in e["singularOrList"]["options"]])
        raise PlanError(f"unsupported expression {sorted(e)}")

    def arguments(self, f: dict, of: DataFrame | list[str]) -> list[Column]:
        return [self.expression(a["value"], of) for a in f.get("arguments", []) if "value" in a] or [self.expression(a, of) for a in f.get("args", [])]

    def literal(self, x: dict) -> Column:
        kind = next((k for k in x if k not in ("nullable", "typeVariationReference")), None)
        value = x.get(kind)
        if kind == "null":
            return F.lit(None).cast(self.type_of(value))
        if kind in ("boolean", "string", "fixedChar"):
            return F.lit(value)
        if kind == "varChar":
            return F.lit(value["value"])
        if kind in ("i8", "i16", "i32", "i64"):
            return F.lit(int(value)).cast(TYPES[kind])
        if kind in ("fp32", "fp64"):
            return F.lit(float(value)).cast(TYPES[kind])
        if kind == "date":
            return F.lit(date(1970, 1, 1) + timedelta(days=int(value)))
        if kind in ("timestamp", "timestampTz"):
            moment = datetime(1970, 1, 1) + timedelta(microseconds=int(value))
            return F.lit(moment.isoformat(" ")).cast("timestamp_ntz").cast(TYPES[kind])
        raise PlanError(f"unsupported literal {kind}")

    @staticmethod
    def type_of(t: dict) -> str:
        kind = next(iter(t))
        if kind == "decimal":
            return f"decimal({t[kind].get('precision', 38)},{t[kind].get('scale', 0)})"
        if kind not in TYPES:
            raise PlanError(f"unsupported type {kind}")
        return TYPES[kind]


def frame(spark: SparkSession, plan: dict[str, Any] | str, table: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The frame of a plan (JSON text or its dictionary)."""
    return Reader(spark, plan, table).frame()
