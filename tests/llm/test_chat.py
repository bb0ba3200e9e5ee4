"""Chat formatting: linking, order, validation, canonical JSON."""

import json

from lakeloom.llm import chat_format, queries

DATA = "/root/testdata/sf0.001"
TYPE = "conv_id long, turn long, role string, text string, message int, position string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TYPE).repartition(3)


def calls(*items, **more):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in items]} | more)


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def by_position(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["position"]))


def test_linking_and_order(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", result("b", {"z": 1, "a": [1]})), (1, 2, "assistant", calls(("a", "f", {"x": 1}), ("b", "f", '{"x": 2}'))), (1, 3, "tool", result("nobody", "?")), (2, 0, "tool", result("a", "other conversation"))]
    out = by_position(chat_format.format_chat(frame(spark, rows)))
    assert [(r["conv_id"], r["position"], r["turn"], r["n_calls"], r["n_linked"]) for r in out] == [(1, 0, 0, 0, 0), (1, 1, 2, 2, 1), (1, 2, 1, 0, 1), (1, 3, 3, 0, 0), (2, 0, 0, 0, 0)]
    assert out[1]["message"] == '{"role":"assistant","tool_calls":[{"arguments":{"x":1},"id":"a","name":"f"},{"arguments":{"x":2},"id":"b","name":"f"}]}'
    assert out[2]["message"] == '{"content":{"a":[1],"z":1},"role":"tool","tool_call_id":"b"}'


def test_validation(spark):
    schemas = spark.createDataFrame([("f", ["x"], {"x": "integer", "s": "string", "o": "object", "l": "array", "n": "number", "b": "boolean"})], chat_format.SCHEMAS)
    good = [{"x": 1}, {"x": 1, "s": "t", "o": {}, "l": [], "n": 1.5, "b": True}, '{"x": 3}']
    bad = [{}, {"x": "1"}, {"x": 1, "more": 2}, {"x": 1, "s": 5}, {"x": 1, "b": "true"}, "not json", None]
    rows = [(1, i, "assistant", calls((str(i), "f", a))) for i, a in enumerate(good + bad)] + [(1, 99, "assistant", calls(("u", "unknown", {})))]
    out = by_position(chat_format.format_chat(frame(spark, rows), schemas))
    assert [r["n_invalid"] for r in out] == [0] * len(good) + [1] * (len(bad) + 1)


def test_edge_cases(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, 5, "user", 'quote " and \\ and \n'), (1, 5, "user", "same"), (1, 5, "user", "same"), (1, None, "user", "no turn"), (2, 0, "user", '{"tool_calls": broken'), (3, 0, "user", "w " * 200_000)]
    out = by_position(chat_format.format_chat(frame(spark, rows)))
    assert len(out) == len(rows)
    assert [r["position"] for r in out if r["conv_id"] == 1] == [0, 1, 2, 3] and [r["turn"] for r in out if r["conv_id"] == 1][0] is None
    assert out[0]["message"] == "{}" and all(json.loads(r["message"]) is not None for r in out)
    assert {json.loads(r["message"])["content"] for r in out if r["conv_id"] == 1} == {'quote " and \\ and \n', "same", "no turn"}
    assert [json.loads(r["message"])["content"] for r in out if r["conv_id"] == 2] == ['{"tool_calls": broken']
    assert chat_format.format_chat(frame(spark, rows).limit(0)).count() == 0


def test_positions_over_blocks(spark):
    rows = [(7, (i * 37) % 500, "user", f"m{i}") for i in range(500)]
    out = by_position(chat_format.format_chat(frame(spark, rows)))
    assert [r["position"] for r in out] == list(range(500)) == [r["turn"] for r in out]


def in_order(spark, rows, schemas=None):
    return [(r["turn"], r["n_calls"], r["n_linked"]) for r in by_position(chat_format.format_chat(frame(spark, rows), schemas))]


def test_chain_of_results(spark):
    """A result that calls goes behind its own call, and its results behind it, whatever their turns."""
    rows = [
        (1, 0, "tool", result("b", "of b")),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "of a", "tool_calls": [{"id": "b", "name": "f", "arguments": {}}]})),
        (1, 2, "assistant", calls(("a", "f", {}))),
        (1, 3, "user", "thanks"),
    ]
    assert in_order(spark, rows) == [(2, 1, 1), (1, 1, 2), (0, 0, 1), (3, 0, 0)]


def test_long_chain(spark):
    """Forty links, all in reverse."""
    n = 40
    rows = [(1, n - i, "tool", json.dumps({"tool_call_id": f"x{i - 1}", "tool_calls": [{"id": f"x{i}", "name": "f"}]})) for i in range(1, n)] + [(1, n, "assistant", calls(("x0", "f", {})))]
    assert [t for t, _, _ in in_order(spark, rows)] == list(range(n, 0, -1))


def test_cycles(spark):
    """The earliest link of a cycle doesn't count for the order; all count as links."""
    both = lambda of, own: json.dumps({"tool_call_id": of, "tool_calls": [{"id": own, "name": "f"}]})
    rows = [(1, 5, "tool", both("c", "a")), (1, 3, "tool", both("a", "b")), (1, 4, "tool", both("b", "c")), (1, 1, "tool", both("c", "tail")), (1, 2, "tool", both("self", "self")), (1, 9, "tool", result("tail", ""))]
    # b's call (turn 3) is first; its result (4) follows, then c's results: turn 5, and turn 1 with what it called
    assert in_order(spark, rows) == [(2, 1, 2), (3, 1, 2), (4, 1, 2), (1, 1, 2), (5, 1, 2), (9, 0, 1)]


def test_callers_of_one_turn_and_repeated_identifiers(spark):
    rows = [(1, 0, "assistant", calls(("a", "f", {}))), (1, 0, "assistant", calls(("b", "f", {}), ("b", "f", {}))), (1, 1, "assistant", calls(("a", "f", {}))), (1, 2, "tool", result("a", 1))]
    assert in_order(spark, rows) == [(0, 1, 1), (0, 2, 0), (1, 1, 0), (2, 0, 1)]
    schemas = spark.createDataFrame([("f", ["x"], {"x": "integer"})], chat_format.SCHEMAS)
    out = by_position(chat_format.format_chat(frame(spark, rows), schemas))
    assert [r["n_invalid"] for r in out] == [1, 2, 1, 0]


def test_repeated_rows(spark):
    """Of equal rows the first has the links; each result is one."""
    rows = [(1, 0, "assistant", calls(("a", "f", {})))] * 3 + [(1, 1, "tool", result("a", 1))] * 2
    assert in_order(spark, rows) == [(0, 1, 1), (0, 1, 0), (0, 1, 0), (1, 0, 1), (1, 0, 1)]


def test_large_blocks_are_split(spark, monkeypatch):
    """One conversation without turns, and a hot turn."""
    monkeypatch.setattr(chat_format, "LARGE_BLOCK", 20)
    rows = [(1, None, "user", f"m{i % 70:03}") for i in range(100)] + [(2, 7, "user", f"m{i:03}") for i in range(90)] + [(2, i, "user", "x") for i in range(15)]
    out = by_position(chat_format.format_chat(frame(spark, rows)))
    one, two = ([r for r in out if r["conv_id"] == c] for c in (1, 2))
    assert [r["position"] for r in one] == list(range(100)) and [r["position"] for r in two] == list(range(105))
    assert [json.loads(r["message"])["content"] for r in one] == sorted(r[3] for r in rows[:100])
    assert [r["turn"] for r in two] == sorted(r[1] for r in rows[100:])


def check_sql(spark, query, sql):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    df = query(spark, DATA)
    found = duckdb.sql(sql)
    names = [d[0] for d in found.description]
    want = sorted(repr(sorted(dict(zip(names, r)).items())) for r in found.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equals_sql_and_is_native(spark):
    check_sql(spark, queries.op3_chat_formatting, chat_format.ORACLE_SQL)


def test_tool_table_equals_sql_and_is_native(spark):
    check_sql(spark, queries.chat_with_tools, chat_format.TOOLS_SQL)
    out = queries.chat_with_tools(spark, DATA)
    assert out.filter("n_linked > 0").count() > 50 and out.filter("n_invalid > 0").count() > 10
