"""Chat formatting with tool-call linking, in DataFrame operations only.

A message is plain text, or JSON: ``{"tool_calls": [{"id", "name", "arguments"}, ...]}`` (maybe
with "content") from an assistant, ``{"tool_call_id", "content"}`` from a tool; a result may call
tools itself. Calls and results are linked by a hash join on conversation and identifier, messages
are put into topological order, arguments are validated against the tools' schemas, and each
message is written as canonical JSON: sorted keys, no blanks, absent fields left out.

Order: a result belongs to one call, so results and their calls form chains. A message's time is
the latest turn of its chain up to the first call; messages are ordered by time, then by the number
of calls before them in the chain, then by turn. Times and numbers come from doubling: each round
joins every open chain to the one that it leads to, so rounds grow with the logarithm of the longest
chain. Links that form a cycle have no such order: of each cycle the link of its earliest message
(by turn, then digest) doesn't count for the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import join_salted, materialize

#: Turns per block when positions are counted; only a block is sorted in one task.
BLOCK = 1024
#: Rows of a block from which it is split further.
LARGE_BLOCK = 1 << 17
#: name string, required array<string>, types map<string,string> (string, integer, number, boolean, object, array)
SCHEMAS = "name string, required array<string>, types map<string,string>"
_CALL = "struct<tool_calls: array<struct<id: string, name: string, arguments: variant>>, tool_call_id: string, content: variant>"


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def parse(messages: DataFrame) -> DataFrame:
    """Add _m (null for plain text): calls, result identifier and content; and _id, a digest, if not null."""
    looks = F.ltrim(F.col("text")).startswith("{") & (F.col("text").contains('"tool_calls"') | F.col("text").contains('"tool_call_id"'))
    body = F.when(looks, F.from_json("text", _CALL, {"mode": "PERMISSIVE"}))
    out = messages.withColumn("_m", F.when(body["tool_calls"].isNotNull() | body["tool_call_id"].isNotNull(), body))
    return out.withColumn("_id", F.when(F.col("_m").isNotNull(), F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")))))


def _kind_ok(kind: Column, found: Column) -> Column:
    whole = found.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = whole | found.isin("DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    return (
        F.when(kind == "integer", whole)
        .when(kind == "number", number)
        .when(kind == "string", found == "STRING")
        .when(kind == "boolean", found == "BOOLEAN")
        .when(kind == "object", found.startswith("OBJECT"))
        .when(kind == "array", found.startswith("ARRAY"))
        .otherwise(F.lit(True))
    )


def calls_of(parsed: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per call: message (conv_id, turn, role, text, _id), place, id, name, arguments (canonical) and valid.

    Valid: the tool is in ``schemas``, the arguments are a JSON object (or a string that holds
    one) with every required name, no name without a type, and values of the types; null without
    ``schemas``.
    """
    rows = parsed.filter(F.col("_m")["tool_calls"].isNotNull()).select("conv_id", "turn", "role", "text", "_id", F.posexplode(F.col("_m")["tool_calls"]).alias("call_no", "_c"))
    raw = F.to_json(F.col("_c")["arguments"])
    args = F.when(F.schema_of_variant(F.col("_c")["arguments"]) == "STRING", F.try_variant_get(F.col("_c")["arguments"], "$", "string")).otherwise(raw)
    rows = rows.select("conv_id", "turn", "role", "text", "_id", "call_no", F.col("_c")["id"].alias("call_id"), F.col("_c")["name"].alias("name"), canonical(args).alias("arguments"))
    if schemas is None:
        return rows.withColumn("valid", F.lit(None).cast("boolean"))
    known = schemas.select(F.col("name").alias("_tool"), F.coalesce("required", F.array().cast("array<string>")).alias("_required"), F.coalesce("types", F.create_map().cast("map<string,string>")).alias("_types"))
    rows = rows.join(known, F.col("name") == F.col("_tool"), "left")
    given = F.from_json("arguments", "map<string,variant>")
    rows = rows.withColumn("_given", given)
    names = F.map_keys("_given")
    good = F.forall(names, lambda k: F.map_contains_key(F.col("_types"), k) & _kind_ok(F.element_at("_types", k), F.schema_of_variant(F.element_at("_given", k))))
    valid = F.col("_tool").isNotNull() & F.col("_given").isNotNull() & (F.size(F.array_except("_required", names)) == 0) & good
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_tool", "_required", "_types", "_given")


def linked(parsed: DataFrame, calls: DataFrame) -> DataFrame:
    """_id of each result with a call, turn, _call (the calling message), call_turn and call_no; written.

    An identifier that several calls of a conversation have belongs to the first (by turn, role,
    text and place). A hot identifier is salted. Rows equal in everything are one message here.
    """
    key = lambda name: F.md5(F.to_json(F.struct("conv_id", F.col(name).alias("i"))))
    place = F.struct("turn", "role", "text", "call_no", "_id")
    owners = calls.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(place).alias("_o"))
    owners = owners.select(key("call_id").alias("_k"), F.col("_o")["_id"].alias("_call"), F.col("_o")["turn"].alias("call_turn"), F.col("_o")["call_no"].alias("call_no"))
    results = parsed.filter(F.col("_m")["tool_call_id"].isNotNull()).withColumn("_of", F.col("_m")["tool_call_id"])
    results = materialize(results.select("_id", key("_of").alias("_k"), "conv_id", "turn").distinct(), "results")
    return materialize(join_salted(results, owners, "_k", "_id", "inner").drop("_k"), "toollinks")


def chains(links: DataFrame) -> DataFrame:
    """_id, _at and _after of each linked result: the latest turn and the number of calls of its chain."""
    state = links.select("_id", F.col("_call").alias("_to"), F.greatest("turn", "call_turn").alias("_at"), F.lit(1).cast("long").alias("_after"), F.struct("turn", "_id").alias("_low"))
    state = materialize(state, "chains")
    longest = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    length = 1
    while state.filter(F.col("_to").isNotNull()).limit(1).count():
        if length > longest:
            # what is still open leads into a cycle, and each _to is on one: its _low is the cycle's
            on = state.filter(F.col("_to").isNotNull()).select(F.col("_to").alias("_id")).distinct()
            cut = state.join(on, "_id", "left_semi").select(F.col("_low")["_id"].alias("_id")).distinct()
            rest = materialize(links.join(cut, "_id", "left_anti"), "toollinks")
            return chains(rest)
        following = state.select(F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_at").alias("_at2"), F.col("_after").alias("_after2"), F.col("_low").alias("_low2"))
        open_ = materialize(state.filter(F.col("_to").isNotNull()), "chains")
        moved = join_salted(open_, following, "_to", "_id", "left").select(
            "_id",
            F.col("_next").alias("_to"),
            F.greatest("_at", "_at2").alias("_at"),
            (F.col("_after") + F.coalesce("_after2", F.lit(0))).alias("_after"),
            F.least("_low", "_low2").alias("_low"),
        )
        state = materialize(state.filter(F.col("_to").isNull()).unionByName(moved), "chains")
        length *= 2
    return state.select("_id", "_at", "_after")


def tool_facts(parsed: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """One row per message with calls or a result: _id, n_answered, n_invalid, _at and _after."""
    calls = calls_of(parsed.filter(F.col("_m").isNotNull()), schemas)
    links = linked(parsed, calls)
    answered = links.select(F.col("_call").alias("_id"), "call_no").distinct().groupBy("_id").agg(F.count("*").alias("n_answered"))
    invalid = calls.dropDuplicates(["_id", "call_no"]).groupBy("_id").agg((F.count_if(~F.col("valid")) if schemas is not None else F.lit(None).cast("long")).alias("n_invalid"))
    order = chains(links).select("_id", "_at", "_after")
    all_ = links.select("_id", F.lit(True).alias("_linked"))
    parts = answered.unionByName(invalid, allowMissingColumns=True).unionByName(order, allowMissingColumns=True).unionByName(all_, allowMissingColumns=True)
    return materialize(parts.groupBy("_id").agg(*[F.max(c).alias(c) for c in ("n_answered", "n_invalid", "_at", "_after", "_linked")]), "toolfacts")


def format_chat(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per message, in topological order within its conversation.

    Columns: conv_id, position (from 0), turn, role, n_calls, n_linked (its calls that have a
    result, and one more if it is itself the result of a call), n_invalid (null without
    ``schemas``), and message (canonical JSON). A call identifier that repeats within a conversation
    belongs to its first call; of rows equal in everything the first has the calls' links. A result
    of its own call, and one link of any cycle, count as links but not for the order. A null conv_id
    is a conversation of its own, a null turn comes first, null text is an absent content. Messages
    equal in time and turn are ordered by role and text; rows equal in everything have consecutive
    positions. Nothing gathers a conversation in one task: positions are counted per block.
    """
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    m = F.col("_m")
    plain = parsed.filter(m.isNull())
    facts = {"n_answered": "bigint", "n_invalid": "bigint", "_at": None, "_after": "bigint", "_linked": "boolean"}
    out = plain.select("*", *[F.lit(None).cast(t or parsed.schema["turn"].dataType).alias(c) for c, t in facts.items()])
    talk = parsed.filter(m.isNotNull())
    if talk.limit(1).count():
        out = out.unionByName(talk.join(tool_facts(parsed, schemas), "_id", "left").select(out.columns))
    out = out.withColumn("_has_calls", m["tool_calls"].isNotNull()).withColumn("_result_of", m["tool_call_id"])
    content = F.when(m.isNull(), F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(m["content"].alias("text"))))
    content = F.when(F.length(content) > 2, F.substring(content, F.lit(9), F.length(content) - 9))
    call_json = F.transform(
        m["tool_calls"],
        lambda c: F.to_json(F.struct(F.coalesce(F.try_parse_json(F.try_variant_get(c["arguments"], "$", "string")), c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))),
    )
    parts = [
        F.concat(F.lit('"content":'), content),
        F.concat(F.lit('"role":'), F.expr("substring(to_json(struct(role)), 9, length(to_json(struct(role))) - 9)")),
        F.concat(F.lit('"tool_call_id":'), F.expr("substring(to_json(struct(_result_of)), 15, length(to_json(struct(_result_of))) - 15)")),
        F.concat(F.lit('"tool_calls":['), F.array_join(call_json, ","), F.lit("]")),
    ]
    parts = [F.when(F.col("role").isNotNull(), p) if i == 1 else F.when(F.col("_result_of").isNotNull(), p) if i == 2 else F.when(F.col("_has_calls"), p) if i == 3 else p for i, p in enumerate(parts)]
    n_calls = F.greatest(F.coalesce(F.size(m["tool_calls"]).cast("long"), F.lit(0)), F.lit(0))
    out = out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(F.col("_after") > 0, F.col("_at")).otherwise(F.col("turn")).alias("_at"),
        F.coalesce("_after", F.lit(0)).alias("_after"),
        n_calls.alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).alias("_answered"),
        F.coalesce(F.col("_linked").cast("long"), F.lit(0)).alias("_linked"),
        (F.coalesce("n_invalid", F.lit(0)) if schemas is not None else F.lit(None).cast("long")).alias("n_invalid"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("message"),
    )
    out = number(out).withColumn("n_linked", F.col("_linked") + F.when(F.col("_copy") == 0, F.col("_answered")).otherwise(0))
    return out.select("conv_id", "position", "turn", "role", "n_calls", "n_linked", "n_invalid", "message")


def number(rows: DataFrame) -> DataFrame:
    """Add position, counted over (_at, _after, turn, role, text) within conv_id, and _copy.

    Rows are counted per block of BLOCK turns (a partial aggregation), blocks are prefix-summed
    per conversation, and rows are numbered within their block. A block of more than LARGE_BLOCK
    rows (many rows of one turn, or without turns) is split by ranges of the whole order. ``_copy``
    numbers rows equal in all of these, from 0.
    """
    order = ["_at", "_after", "turn", "role", "text"]
    rows = rows.withColumn("_block", F.floor(F.col("_at") / BLOCK)).withColumn("_sub", F.lit(0))
    counts = materialize(rows.groupBy("conv_id", "_block", "_sub").agg(F.count("*").alias("_n")), "blocks")
    large = counts.filter(F.col("_n") > LARGE_BLOCK).select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"))
    if large.limit(1).count():
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b"))
        spread = [*order, F.monotonically_increasing_id()]  # equal rows may be parted: any order of them will do
        some = rows.join(large, same, "left_semi").repartitionByRange("conv_id", "_block", *spread)
        some = materialize(some.withColumn("_sub", F.spark_partition_id() + 1), "largeblocks")
        rows = rows.join(large, same, "left_anti").unionByName(some)
        fine = some.groupBy("conv_id", "_block", "_sub").agg(F.count("*").alias("_n"))
        counts = counts.filter(F.col("_n") <= LARGE_BLOCK).unionByName(fine)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_block", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.col("_sub").alias("_s"), before.alias("_before"))
    within = Window.partitionBy("conv_id", "_block", "_sub").orderBy(*order)
    rows = rows.withColumn("_no", F.row_number().over(within) - 1).withColumn("_copy", F.col("_no") + 1 - F.rank().over(within))
    out = rows.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b")) & (F.col("_sub") == F.col("_s")))
    return out.withColumn("position", (F.col("_before") + F.col("_no")).cast("long"))


#: What TOOL_TABLE may call, with the arguments that it must and may give.
TOOLS = [("search", ["query"], {"query": "string", "limit": "integer"}), ("fetch", ["url"], {"url": "string", "options": "object"})]


def tool_schemas(spark) -> DataFrame:
    """TOOLS as a table."""
    return spark.createDataFrame(TOOLS, SCHEMAS)


def with_tools(conversations: DataFrame) -> DataFrame:
    """A table with calls and results made from ``conversations``, whose messages have none.

    Every assistant message calls ``search`` (some with bad arguments) and, in one conversation of
    seven, an unknown tool. Results come ten turns later, or earlier than their call. In one
    conversation of four the result calls ``fetch``, whose result stands before all else; in one of
    eleven the fetched result holds the first call's identifier, a cycle.
    """
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    says = F.col("role") == "assistant"
    limit = F.when(F.col("conv_id") % 5 == 0, F.lit('"many"')).otherwise(t)
    name = F.when(F.col("conv_id") % 7 == 0, "guess").otherwise("search")
    call = F.concat(F.lit('{ "tool_calls": [{"name": "'), name, F.lit('", "id": "c'), t, F.lit('", "arguments": {"query": "'), c, F.lit('", "limit": '), limit, F.lit("}}]}"))
    at = F.col("turn") * 10 + F.when(F.col("conv_id") % 3 == 0, -5).otherwise(5)
    more = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit(', "tool_calls": [{"id": "d'), t, F.lit('", "name": "fetch", "arguments": {"url": "u'), t, F.lit('"}}]'))).otherwise(F.lit(""))
    result = F.concat(F.lit('{"tool_call_id": "c'), t, F.lit('", "content": "r'), t, F.lit('"'), more, F.lit("}"))
    cycle = F.when(F.col("conv_id") % 11 == 0, F.concat(F.lit(', "tool_calls": [{"id": "e'), t, F.lit('", "name": "fetch", "arguments": {}}, {"id": "c'), t, F.lit('", "name": "fetch", "arguments": {}}]'))).otherwise(F.lit(""))
    fetched = F.concat(F.lit('{"content": null, "tool_call_id": "d'), t, F.lit('"'), cycle, F.lit("}"))
    base = conversations.select("conv_id", (F.col("turn") * 10).alias("turn"), "role", F.when(says, call).otherwise(F.col("text")).alias("text"))
    results = conversations.filter(says).select("conv_id", at.alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    chained = conversations.filter(says & (F.col("conv_id") % 4 == 1)).select("conv_id", F.lit(-9).cast("long").alias("turn"), F.lit("tool").alias("role"), fetched.alias("text"))
    return base.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(results.withColumn("turn", F.col("turn").cast("long"))).unionByName(chained)


#: For tables without tool calls, as the driver's are; TOOLS_SQL is for the table of `with_tools`.
ORACLE_SQL = """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS BIGINT) AS position, turn, role,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       '{' || concat_ws(',', '"content":' || CAST(to_json(text) AS VARCHAR), '"role":' || CAST(to_json(role) AS VARCHAR)) || '}' AS message
FROM conversations
"""


#: The table of `with_tools`, its links, cycles, order and validity, from ``conversations``.
TOOLS_SQL = """
WITH RECURSIVE says AS (SELECT *, CAST(turn AS VARCHAR) AS t, CAST(conv_id AS VARCHAR) AS c FROM conversations WHERE role = 'assistant'),
made AS (
  SELECT conv_id, CAST(turn * 10 AS BIGINT) AS turn, role, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'
  UNION ALL
  SELECT conv_id, turn * 10, role, '{ "tool_calls": [{"name": "' || CASE WHEN conv_id % 7 = 0 THEN 'guess' ELSE 'search' END || '", "id": "c' || t || '", "arguments": {"query": "' || c || '", "limit": '
         || CASE WHEN conv_id % 5 = 0 THEN '"many"' ELSE t END || '}}]}' FROM says
  UNION ALL
  SELECT conv_id, turn * 10 + CASE WHEN conv_id % 3 = 0 THEN -5 ELSE 5 END, 'tool', '{"tool_call_id": "c' || t || '", "content": "r' || t || '"'
         || CASE WHEN conv_id % 4 = 1 THEN ', "tool_calls": [{"id": "d' || t || '", "name": "fetch", "arguments": {"url": "u' || t || '"}}]' ELSE '' END || '}' FROM says
  UNION ALL
  SELECT conv_id, -9, 'tool', '{"content": null, "tool_call_id": "d' || t || '"'
         || CASE WHEN conv_id % 11 = 0 THEN ', "tool_calls": [{"id": "e' || t || '", "name": "fetch", "arguments": {}}, {"id": "c' || t || '", "name": "fetch", "arguments": {}}]' ELSE '' END || '}' FROM says WHERE conv_id % 4 = 1),
copies AS (SELECT *, md5(conv_id || '|' || turn || '|' || role || '|' || text) AS id, row_number() OVER (PARTITION BY conv_id, turn, role, text) AS copy FROM made),
m AS (SELECT *, CASE WHEN text LIKE '{%' AND (text LIKE '%"tool_calls"%' OR text LIKE '%"tool_call_id"%') THEN CAST(text AS JSON) END AS j FROM copies WHERE copy = 1),
calls AS (
  SELECT m.conv_id, m.turn, m.role, m.text, m.id, k.no, json_extract(j, '$.tool_calls[' || k.no || ']') AS call
  FROM m, LATERAL (SELECT unnest(generate_series(0, CAST(json_array_length(j, '$.tool_calls') AS BIGINT) - 1)) AS no) k WHERE json_array_length(j, '$.tool_calls') > 0),
checked AS (
  SELECT *, json_extract_string(call, '$.id') AS call_id, json_extract(call, '$.arguments') AS args,
         CASE json_extract_string(call, '$.name')
           WHEN 'search' THEN coalesce(json_type(call, '$.arguments.query') = 'VARCHAR', FALSE) AND coalesce(json_type(call, '$.arguments.limit') IN ('BIGINT', 'UBIGINT'), TRUE)
           WHEN 'fetch' THEN coalesce(json_type(call, '$.arguments.url') = 'VARCHAR', FALSE) ELSE FALSE END AS valid
  FROM calls),
owner AS (SELECT * FROM checked QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, role, text, no) = 1),
l AS (SELECT m.id, m.turn, o.id AS call, o.turn AS call_turn, o.no FROM m JOIN owner o ON m.conv_id = o.conv_id AND json_extract_string(m.j, '$.tool_call_id') = o.call_id),
walk AS (SELECT id, call AS cur, 1 AS n FROM l UNION ALL SELECT w.id, l.call, n + 1 FROM walk w JOIN l ON l.id = w.cur WHERE w.cur <> w.id AND n < 9),
ring AS (SELECT w.id, b.turn, b.id AS other FROM walk w JOIN m b ON b.id = w.cur WHERE w.id IN (SELECT id FROM walk WHERE cur = id)),
cut AS (SELECT id FROM ring QUALIFY other = id AND row_number() OVER (PARTITION BY id ORDER BY turn, other) = 1),
kept AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM cut)),
chain AS (SELECT id, call AS cur, greatest(turn, call_turn) AS late, 1 AS n FROM kept UNION ALL SELECT c.id, k.call, greatest(c.late, k.turn, k.call_turn), n + 1 FROM chain c JOIN kept k ON k.id = c.cur),
placed AS (SELECT id, max(late) AS late, max(n) AS n FROM chain GROUP BY id),
answered AS (SELECT call AS id, count(DISTINCT no) AS n FROM l GROUP BY call),
written AS (
  SELECT id, count(*) AS n_calls, count(*) FILTER (WHERE NOT valid) AS n_invalid,
         string_agg('{"arguments":{' || coalesce(array_to_string(list_transform(list_sort(json_keys(args)), lambda x: '"' || x || '":' || CAST(json_extract(args, x) AS VARCHAR)), ','), '') || '},"id":'
                    || CAST(json_extract(call, '$.id') AS VARCHAR) || ',"name":' || CAST(json_extract(call, '$.name') AS VARCHAR) || '}', ',' ORDER BY no) AS calls
  FROM checked GROUP BY id)
SELECT r.conv_id, CAST(row_number() OVER (PARTITION BY r.conv_id ORDER BY coalesce(p.late, r.turn), coalesce(p.n, 0), r.turn, r.role, r.text, r.copy) - 1 AS BIGINT) AS position, r.turn, r.role,
       CAST(coalesce(w.n_calls, 0) AS BIGINT) AS n_calls,
       CAST(CASE WHEN l.id IS NULL THEN 0 ELSE 1 END + CASE WHEN r.copy = 1 THEN coalesce(a.n, 0) ELSE 0 END AS BIGINT) AS n_linked,
       CAST(coalesce(w.n_invalid, 0) AS BIGINT) AS n_invalid,
       '{' || concat_ws(',', CASE WHEN m.j IS NULL THEN '"content":' || CAST(to_json(r.text) AS VARCHAR) WHEN json_exists(m.j, '$.content') THEN '"content":' || CAST(json_extract(m.j, '$.content') AS VARCHAR) END,
                        '"role":' || CAST(to_json(r.role) AS VARCHAR), '"tool_call_id":' || CAST(json_extract(m.j, '$.tool_call_id') AS VARCHAR), '"tool_calls":[' || w.calls || ']') || '}' AS message
FROM copies r JOIN m ON m.id = r.id LEFT JOIN placed p ON p.id = r.id LEFT JOIN answered a ON a.id = r.id LEFT JOIN written w ON w.id = r.id LEFT JOIN l ON l.id = r.id
"""
