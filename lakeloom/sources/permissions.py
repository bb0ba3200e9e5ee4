"""Relationship-based permissions flattened to (object, subject) pairs.

A model maps types to permissions; a permission is an expression over the type's relations and
permissions: ``a + b`` union, ``a & b`` intersection, ``a - b`` exclusion, ``parent->view`` through
a relation. Relations are rows of object_type, object_id, relation, subject_type, subject_id and
subject_relation (null for single subjects).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.recursion import iterate, written

PAIR = ["object_id", "subject_type", "subject_id"]
#: Objects above one object that an array may hold (beyond, pairs are iterated); pairs of a task; tasks.
ABOVE, PAIRS, TASKS = 100_000, 2_000_000, 4000


def parse(expression: str):
    """Nested tuples (operator, left, right), ("arrow", relation, name) or ("name", name)."""
    toks = re.findall(r"->|[()+&-]|\w+", expression)

    def term(i: int):
        if toks[i] == "(":
            node, i = chain(i + 1)
            return node, i + 1
        if i + 1 < len(toks) and toks[i + 1] == "->":
            return ("arrow", toks[i], toks[i + 2]), i + 3
        return ("name", toks[i]), i + 1

    def chain(i: int):
        node, i = term(i)
        while i < len(toks) and toks[i] in "+&-":
            right, j = term(i + 1)
            node, i = (toks[i], node, right), j
        return node, i

    return chain(0)[0]


def materialize_permission(relations: DataFrame, model: dict[str, dict[str, str]], object_type: str, permission: str) -> DataFrame:
    """object_id, subject_type, subject_id of everyone who has ``permission``, usersets resolved.

    Recursion along one type (folders in folders, groups in groups) is a fixpoint.
    """
    return _expand(relations, model, object_type, permission, {}).distinct()


def _members(relations: DataFrame, model: dict, object_type: str, relation: str, busy: dict) -> DataFrame:
    own = relations.filter((F.col("object_type") == object_type) & (F.col("relation") == relation))
    direct = own.filter(F.col("subject_relation").isNull()).select(*PAIR)
    usersets = own.filter(F.col("subject_relation").isNotNull())
    kinds = [(r[0], r[1]) for r in usersets.select("subject_type", "subject_relation").distinct().collect()]  # of the model, not of the data
    out = direct
    for kind, name in kinds:
        links = usersets.filter((F.col("subject_type") == kind) & (F.col("subject_relation") == name)).select("object_id", F.col("subject_id").alias("_via"))
        if (kind, name) == (object_type, relation):
            out = _inherited(out, links)
        else:
            inner = _expand(relations, model, kind, name, busy).withColumnRenamed("object_id", "_o")
            out = out.unionByName(links.join(inner, F.col("_via") == F.col("_o")).select(*PAIR))
    return out


def _inherited(out: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs of ``out``, and those that any number of links (object_id has all that _via has) adds.

    The objects above an object are found once, not for each of its subjects: objects that nothing is
    below of are peeled off, again and again, as long as this takes away a quarter of the links; the
    rest (cycles, long chains) is closed by iteration. Then, from the top, each object gets an array
    of all above it. Pairs are made after the arrays have come to their subject, so they aren't moved.
    """
    number = lambda c: F.when(F.col(c).try_cast("bigint").cast("string") == F.col(c), F.col(c).try_cast("bigint"))
    pairs = lambda: iterate(out, lambda new: links.join(new.withColumnRenamed("object_id", "_o"), F.col("_via") == F.col("_o")).select(*PAIR), distinct=True)
    known = links.filter("_via is not null")
    numbers, unnamed = known.agg(F.bool_and(number("object_id").isNotNull() & number("_via").isNotNull()), F.bool_or(F.col("object_id").isNull())).first()
    if unnamed:
        return pairs()
    known, code = known.filter("object_id <> _via"), number if numbers else F.col  # numbers take less room than their texts
    rest = written(known.select(code("_via").alias("_low"), code("object_id").alias("_high")).distinct(), "links")
    left, levels = rest.count(), []
    while left:
        marked = rest.join(rest.select(F.col("_high").alias("_inner")).distinct(), F.col("_low") == F.col("_inner"), "left").withColumn("_n", F.count("*").over(Window.partitionBy("_low")))
        marked = written(marked.select("_low", "_high", "_n", F.col("_inner").isNotNull().alias("_inner")), "links")
        inner = marked.filter("_inner").count()
        if inner > 0.75 * left:
            break
        levels.append(marked.filter("not _inner"))
        rest, left = marked.filter("_inner").select("_low", "_high"), inner
    above, most = rest.select("_low", F.array("_high").alias("_up")).limit(0), 0
    if left:
        closed = iterate(rest, lambda new: new.join(rest.select(F.col("_low").alias("_x"), F.col("_high").alias("_y")), F.col("_high") == F.col("_x")).select("_low", F.col("_y").alias("_high")), distinct=True)
        most = closed.groupBy("_low").count().agg(F.max("count")).first()[0]
        if most <= ABOVE:
            above = written(closed.groupBy("_low").agg(F.collect_set("_high").alias("_up")), "above")
    for level in levels[:0:-1]:
        if most > ABOVE:
            break
        up = level.join(above.withColumnRenamed("_low", "_o"), F.col("_high") == F.col("_o"), "left").select("_low", "_n", F.concat(F.array("_high"), F.coalesce("_up", F.array().cast(above.schema["_up"].dataType))).alias("_up"))
        several = up.filter("_n > 1").select("_low", F.explode("_up").alias("_x")).groupBy("_low").agg(F.collect_set("_x").alias("_up"))
        up = written(up.filter("_n = 1").select("_low", "_up").unionByName(several), "above")
        most = max(most, up.agg(F.max(F.size("_up"))).first()[0])
        above = above.unionByName(up)
    if most > ABOVE:
        return pairs()
    own = out.select(*PAIR, code("object_id").alias("_at"))
    if levels:  # the lowest objects have no arrays: their subjects start one link higher
        higher = own.drop("object_id").join(levels[0], F.col("_at") == F.col("_low")).select(F.col("_high").cast("string").alias("object_id"), "subject_type", "subject_id", F.col("_high").alias("_at"))
        own = own.unionByName(higher.distinct())
    partitions = max(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, out.count() * (most + 2) // PAIRS))
    spread = own.join(above, F.col("_at") == F.col("_low"), "left").select(*PAIR, "_up").repartition(partitions, "subject_type", "subject_id")
    ids = F.concat(F.array("object_id"), F.coalesce(F.col("_up").cast("array<string>"), F.array().cast("array<string>")))
    return spread.select(F.explode(ids).alias("object_id"), "subject_type", "subject_id").distinct()


def _expand(relations: DataFrame, model: dict, object_type: str, name: str, busy: dict) -> DataFrame:
    if name not in model.get(object_type, {}):
        return _members(relations, model, object_type, name, busy)
    return _evaluate(parse(model[object_type][name]), relations, model, object_type, name, busy)


def _evaluate(node, relations: DataFrame, model: dict, object_type: str, permission: str, busy: dict) -> DataFrame:
    kind = node[0]
    if kind == "name":
        return _expand(relations, model, object_type, node[1], busy)
    if kind == "arrow":
        links = relations.filter((F.col("object_type") == object_type) & (F.col("relation") == node[1])).select("object_id", F.col("subject_type").alias("_t"), F.col("subject_id").alias("_via"))
        out = None
        for (other,) in links.select("_t").distinct().collect():  # types of the model
            if (other, node[2]) == (object_type, permission):
                continue
            inner = _expand(relations, model, other, node[2], busy).withColumnRenamed("object_id", "_o")
            one = links.filter(F.col("_t") == other).join(inner, F.col("_via") == F.col("_o")).select(*PAIR)
            out = one if out is None else out.unionByName(one)
        return out if out is not None else relations.select(*PAIR).limit(0)
    left, right = (_evaluate(x, relations, model, object_type, permission, busy) for x in node[1:])
    if kind == "+":
        own = [x for x in node[1:] if x[0] == "arrow" and x[2] == permission]
        out = left.unionByName(right)
        for arrow in own:  # parent->permission within the same type
            links = relations.filter((F.col("object_type") == object_type) & (F.col("relation") == arrow[1]) & (F.col("subject_type") == object_type)).select("object_id", F.col("subject_id").alias("_via"))
            out = _inherited(out, links)
        return out
    return left.intersect(right) if kind == "&" else left.subtract(right)
