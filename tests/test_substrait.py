"""Plan documents as frames."""

import pytest

from lakeloom.plans import substrait
from lakeloom.plans.substrait import PlanError

NAMES = ["equal:any", "sum:i64", "count:any", "add:i64", "coalesce:any"]


def field(i):
    return {"selection": {"directReference": {"structField": {"field": i} if i else {}}}}


def call(name, *args):
    return {"scalarFunction": {"functionReference": [n.split(":")[0] for n in NAMES].index(name), "arguments": [{"value": a} for a in args]}}


def values(*rows):
    cell = lambda x: {"null": {"i64": {}}} if x is None else {"string": x} if isinstance(x, str) else {"i64": str(x)}
    return {"read": {"baseSchema": {"names": ["a", "b"], "struct": {"types": [{"i64": {}}, {"string": {}}]}}, "virtualTable": {"values": [{"fields": [cell(x) for x in r]} for r in rows]}}}


def run(spark, rel, names=None):
    plan = {"extensions": [{"extensionFunction": {"functionAnchor": i, "name": n}} for i, n in enumerate(NAMES)], "relations": [{"root": {"input": rel} | ({"names": names} if names else {})}]}
    df = substrait.frame(spark, plan)
    return df.columns, sorted((tuple(r) for r in df.collect()), key=repr)


LEFT, RIGHT = values((1, "x"), (2, None), (2, None), (None, "z")), values((2, "p"), (3, "q"))


def test_values_projects_and_emits(spark):
    rel = {"project": {"input": LEFT, "expressions": [call("add", field(0), {"literal": {"i64": "1"}}), call("coalesce", field(1), {"literal": {"string": "-"}})], "common": {"emit": {"outputMapping": [2, 3]}}}}
    assert run(spark, rel, ["n", "s"]) == (["n", "s"], [(2, "x"), (3, "-"), (3, "-"), (None, "z")])
    assert run(spark, values())[1] == []
    assert run(spark, {"project": {"input": LEFT, "expressions": [{"cast": {"type": {"i64": {}}, "input": field(1)}}]}})[1][0] == (1, "x", None)


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        ("INNER", [(2, None, 2, "p"), (2, None, 2, "p")]),
        ("LEFT_SEMI", [(2, None), (2, None)]),
        ("LEFT_ANTI", [(1, "x"), (None, "z")]),
        ("RIGHT", [(2, None, 2, "p"), (2, None, 2, "p"), (None, None, 3, "q")]),
    ],
)
def test_joins(spark, kind, want):
    rel = {"join": {"left": LEFT, "right": RIGHT, "type": f"JOIN_TYPE_{kind}", "expression": call("equal", field(0), field(2))}}
    assert run(spark, rel)[1] == want


def test_aggregates(spark):
    measure = lambda name, **more: {"measure": {"functionReference": [n.split(":")[0] for n in NAMES].index(name), "arguments": [{"value": field(0)}]} | more}
    rel = {"aggregate": {"input": LEFT, "groupings": [{"groupingExpressions": [field(1)]}], "measures": [measure("sum"), measure("count", invocation="AGGREGATION_INVOCATION_DISTINCT")]}}
    assert run(spark, rel)[1] == [("x", 1, 1), ("z", None, 0), (None, 4, 1)]
    assert run(spark, {"aggregate": {"input": LEFT, "measures": [measure("sum")]}})[1] == [(5,)]


@pytest.mark.parametrize(
    ("op", "want"),
    [("UNION_ALL", 6), ("UNION_DISTINCT", 5), ("MINUS_PRIMARY", 3), ("MINUS_PRIMARY_ALL", 4), ("INTERSECTION_MULTISET", 0)],
)
def test_sets(spark, op, want):
    assert len(run(spark, {"set": {"inputs": [LEFT, RIGHT], "op": f"SET_OP_{op}"}})[1]) == want


def test_sort_fetch_and_references(spark):
    ordered = {"sort": {"input": LEFT, "sorts": [{"expr": field(0), "direction": "SORT_DIRECTION_DESC_NULLS_FIRST"}]}}
    assert run(spark, {"fetch": {"input": ordered, "count": "1", "offset": "0"}})[1] == [(None, "z")]
    plan = {"relations": [{"rel": LEFT}, {"root": {"input": {"reference": {"subtreeOrdinal": 0}}, "names": ["a", "b"]}}]}
    assert substrait.frame(spark, plan).count() == 4


@pytest.mark.parametrize("rel", [{"fetch": {"input": LEFT, "count": "1"}}, {"write": {}}, {"join": {"left": LEFT, "right": RIGHT, "type": "JOIN_TYPE_ODD", "expression": field(0)}}, {"filter": {"input": LEFT, "condition": {"subquery": {}}}}, {"read": {"baseSchema": {"names": []}}}])
def test_what_is_refused(spark, rel):
    with pytest.raises(PlanError):
        run(spark, rel)
