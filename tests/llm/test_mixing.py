"""Mixing: targets, reruns, edge cases, SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing, queries

DATA = "/root/testdata/sf0.01"


def level(sizes, weights, share=1.5, cap=2.0):
    """Shares by weight; those above their cap stop there and the excess is reshared."""
    budget, out, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if budget * weights[i] / total > cap * sizes[i]}
        if not over:
            return [out[i] if i in out else budget * weights[i] / total for i in range(len(sizes))]
        for i in over:
            out[i] = cap * sizes[i]
            budget -= out[i]
        open_ -= over
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7], [0, 10, 10], [5], [10, 1, 1, 1, 1, 1, 900]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    df = mixing.cycled_weights(spark.createDataFrame(rows, "_source string, source_size long"))
    got = [r["target"] for r in mixing.targets(df).orderBy("_source").collect()]
    assert got == pytest.approx(level(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, source string, text string, size int, target int, taken string").repartition(3)


def test_sizes_and_edge_cases(spark):
    rows = [(1, "a", "one two\tthree\x0bfour five"), (2, "b", None), (3, None, ""), (4, None, "  x  "), (None, "c", "p q"), (5, "c", "p q r"), (5, "c", "p q r"), (6, "", "w " * 100_000)]
    out = mixing.mix_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {(r["doc_id"], r["size"]) for r in out}
    assert sizes == {(1, 4), (2, 0), (3, 0), (4, 1), (None, 2), (5, 3), (6, 100_000)}
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in out)
    assert mixing.mix_documents(docs(spark, rows).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_documents(docs(spark, [(1, "a", None), (2, "b", " ")])).collect()} == {0}


def test_hot_source_meets_its_target(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 9}", "w " * (1 + i * 7 % 40)) for i in range(3000)]
    out = mixing.mix_documents(docs(spark, rows))
    sums = out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(sums) >= 4 and all(abs(r["t"] - r["target"]) <= 20 for r in sums)
    again = mixing.mix_documents(docs(spark, rows[::-1]))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_quality_weights_favour(spark):
    rows = [(i, s, "w w w w") for i, s in enumerate(["a"] * 1000 + ["b"] * 2000)]
    out = mixing.mix_documents(docs(spark, rows), quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1))
    twice = out.filter("doc_id >= 1000 and taken > size")
    even, odd = twice.filter("doc_id % 2 = 0").count(), twice.filter("doc_id % 2 = 1").count()
    assert even + odd == 500 and even > 5 * odd


def test_mix_repeats_rows(spark):
    rows = [(i, f"s{i % 4}", "w " * (1 + i % 9)) for i in range(400)]
    df = docs(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in mixing.mix_documents(df).collect():
        assert copies.get(r["doc_id"], 0) * r["size"] == r["taken"]


def test_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in queries.op7_mixing(spark, DATA).collect())
    columns = [d[0] for d in duckdb.sql(mixing.ORACLE_SQL).description]
    want = [dict(zip(columns, r)) for r in duckdb.sql(mixing.ORACLE_SQL).fetchall()]
    assert got == sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in want)


def test_default_quality_decides_on_documents(spark):
    """Weights vary over the table, and with them who is taken."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = df.select(mixing.text_quality(F.col("text"), mixing.word_count(F.col("text"))).alias("w"))
    low, high, n = weights.agg(F.min("w"), F.max("w"), F.countDistinct("w")).first()
    assert 0 < low < 0.5 < high <= 1 and n > 500
    own = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(df).collect()}
    flat = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(df, quality=F.lit(1.0)).collect()}
    differ = [k for k in own if own[k] != flat[k]]
    assert len(differ) > 10
    quality = {r["doc_id"]: r["w"] for r in df.select("doc_id", mixing.text_quality(F.col("text"), mixing.word_count(F.col("text"))).alias("w")).collect()}
    mean = lambda ids: sum(quality[k] for k in ids) / len(ids)
    assert mean([k for k in differ if own[k] > flat[k]]) > mean([k for k in differ if own[k] < flat[k]])


def test_prefix_sums_over_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 5) for i in range(1000)] + [(None, 3)], "k long, n long")
    out = mixing.before(df, [F.col("k").asc_nulls_last()], total=F.col("n"), rank=F.lit(1)).collect()
    at, rank = 0, 0
    for r in sorted(out, key=lambda r: (r["k"] is None, r["k"] or 0)):
        assert (r["total"], r["rank"]) == (at, rank)
        at, rank = at + r["n"], rank + 1
    assert mixing.before(df.limit(0), [F.col("k")], rank=F.lit(1)).count() == 0


def test_clashing_columns_are_kept(spark):
    df = docs(spark, [(i, "a", "w w") for i in range(20)]).withColumn("_size", F.lit(9)).withColumn("_source", F.lit("q"))
    out = mixing.mixed(df)
    assert out.columns == df.columns and {(r["_size"], r["_source"], r["target"]) for r in out.collect()} == {(9, "q", 2)}


def test_native_plan(spark):
    plan = queries.op7_mixing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
