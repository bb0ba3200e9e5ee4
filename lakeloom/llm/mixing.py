"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A source's target in words is met by complete epochs over its documents, then by a weighted
sample of the rest: every document has the exponential key -ln(u) / quality, u from the digest of
its id; in ascending key order documents are taken while they fit the budget (one belongs if at
least half of it fits, so the sum ends within half a document of the target).

The order isn't made by sorting a source: keys fall into BUCKETS by a monotone function, sizes are
summed per bucket and prefix-summed over a source's buckets, and only the bucket in which the
budget ends is sorted. That gives one threshold per source, so a source with a third of all rows
costs no more than a partial aggregation, and documents are decided row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import materialize

#: Key buckets per source; the one that is sorted has about a source's rows / BUCKETS.
BUCKETS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (3, 1, 2)
#: Signs that prose has few of.
SIGNS = r"[|*#%&$~^=_<>{}\[\]@/+0-9]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and tab to carriage return; null: 0.

    Counted as the length of the text with each run replaced by one sign and white space removed.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """The default quality weight, in (0, 1]: lower for many signs among the words or odd word lengths.

    1 / (1 + 8 signs per word + distance of the mean word length, blanks included, from 6 by 6).
    """
    text, words = F.coalesce(text, F.lit("")), F.greatest(size, F.lit(1))
    signs = F.length(text) - F.length(F.regexp_replace(text, SIGNS, ""))
    return 1 / (1 + 8 * signs / words + F.abs(F.length(text) / words - 6) / 6)


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """Add _size, _draw (the exponential key) and _tie (a total order among equal keys)."""
    size = word_count(F.col(text))
    out = docs.withColumn("_size", size)
    weight = quality if quality is not None else text_quality(F.col(text), F.col("_size"))
    out = out.withColumn("_tie", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    u = (F.conv(F.substring("_tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    draw = -F.log(u) / F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    return out.withColumn("_draw", draw).withColumnRenamed(source, "_source")


def before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Add to each row the sums over all rows before it, in an order that must be total.

    Rows are dealt to tasks by ranges of the order; ranges are summed (one row each) and then only
    a range is summed up in one task. Sums must be exact in any order, such as counts.
    """
    parts = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are tasks
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]).join(totals, "_range")
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums])


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Add _weight: 3, 1, 2, repeating, over sources by code point, null last. One row per source."""
    ranked = before(sources, [F.col("_source").asc_nulls_last()], _rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.col("_rank") % len(CYCLE) + 1).cast("int"))
    return ranked.withColumn("_weight", weight).drop("_rank")


def targets(weighted: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add target: ``share`` of all words by weight, at most ``cap`` times a source's size.

    The excess of capped sources is reshared by weight until none is above its cap. In ascending
    order of cap / weight that is a prefix: source i is capped if the level that the rest would
    have, (budget - caps before i) / (weights from i on), reaches its own cap / weight. Only sums
    over all sources reach the driver.
    """
    out = weighted.withColumn("_limit", F.col("source_size") * cap)
    out = before(out, [F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last()], _caps=F.col("_limit"), _weights=F.col("_weight"))
    out = materialize(out, "levels")
    size, weights = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    out = out.withColumn("_level", (F.lit(float(size * share)) - F.col("_caps")) / (F.lit(float(weights)) - F.col("_weights")))
    level = out.agg(F.max(F.when(F.col("_level") < F.col("_limit") / F.col("_weight"), F.col("_level")))).first()[0]
    out = out.withColumn("target", F.least(F.col("_limit"), F.coalesce(F.lit(level).cast("double") * F.col("_weight"), F.col("_limit"))))
    return out.select("_source", "_weight", "source_size", "target")


def plan(rows: DataFrame, weights: DataFrame | None = None, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last key that the sample takes.

    ``rows`` has _source, _size, _draw and _tie and should be a written table (it is read three
    times). ``weights`` (_source, _weight) overrides the cycled ones; a missing source weighs 1.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    if weights is None:
        weighted = cycled_weights(sizes)
    else:
        other = weights.select(F.col("_source").alias("_other"), F.col("_weight").cast("double"))
        weighted = sizes.join(other, F.col("_source").eqNullSafe(F.col("_other")), "left").drop("_other").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
    budget = targets(weighted, share, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = budget.withColumn("epochs", full.cast("long")).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    budget = materialize(budget, "targets")

    bucket = F.floor((1 - F.exp(-F.col("_draw"))) * BUCKETS)
    drawn = rows.filter(F.col("_size") > 0).withColumn("_bucket", bucket)
    steps = drawn.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    cum = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("_end", cum)
    rest = budget.select(F.col("_source").alias("_s"), "_rest").filter(F.col("_rest") > 0)
    edge = steps.join(rest, F.col("_source").eqNullSafe(F.col("_s"))).filter(F.col("_end") > F.col("_rest"))
    edge = edge.groupBy("_source").agg(F.min(F.struct("_bucket", F.col("_end") - F.col("_words"), "_rest")).alias("_e"))
    edge = edge.select(F.col("_source").alias("_s"), F.col("_e")["_bucket"].alias("_b"), F.col("_e")["col2"].alias("_before"), F.col("_e")["_rest"].alias("_left"))
    # documents of the edge buckets, rows of one document together
    inside = drawn.join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = inside.groupBy("_source", "_before", "_left", "_draw", "_tie").agg(F.sum("_size").alias("_w"))
    until = F.sum("_w").over(Window.partitionBy("_source").orderBy("_draw", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_mid", F.col("_before") + until - F.col("_w") / 2).filter(F.col("_mid") <= F.col("_left"))
    last = inside.groupBy("_source").agg(F.max(F.struct("_draw", "_tie")).alias("_last")).withColumnRenamed("_source", "_s2")
    out = budget.join(edge.select("_s", F.col("_b").alias("_edge")), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.join(last, F.col("_source").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    return materialize(out, "mixplan")


def apply(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """Add source_size, target and _copies (how often the mix takes a row); decided row by row.

    The plan has one row per source; Catalyst broadcasts it if it is below the session's threshold
    and else shuffles, where adaptive execution splits a hot source.
    """
    per = mix.select(F.col("_source").alias("_s"), "source_size", "target", "epochs", "_edge", "_last")
    out = rows.join(per, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    bucket = F.floor((1 - F.exp(-F.col("_draw"))) * BUCKETS)
    more = F.when(F.col("_edge").isNull(), False).when(bucket != F.col("_edge"), bucket < F.col("_edge")).otherwise(F.coalesce(F.struct("_draw", "_tie") <= F.col("_last"), F.lit(False)))
    return out.withColumn("_copies", F.col("epochs") + more.cast("long")).drop("epochs", "_edge", "_last")


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None) -> DataFrame:
    """``key``, size, source_size, target and taken (words, repeats counted) of every row of ``docs``.

    Null text has size 0 and is taken for 0 words; null is a source of its own, the last. Rows of
    one key are taken or left together. If all sizes are 0, targets are 0. Same input, same mix.
    """
    rows = sized(docs.select(F.col(key).alias(key), F.col(source).alias("_source"), F.col(text).alias(text)), key, "_source", text, quality)
    rows = materialize(rows.select(key, "_source", "_size", "_draw", "_tie"), "sized")
    out = apply(rows, plan(rows))
    return out.select(key, F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts aren't shuffled."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    rows = sized(packed, "_key", "_source", "_text", quality)
    stats = materialize(rows.select("_source", "_size", "_draw", "_tie"), "sized")
    out = apply(rows, plan(stats)).filter(F.col("_copies") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[^x]', '', 'g')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '|*#%&$~^=_<>{}[]@/+0123456789', '')) AS signs,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS tie
  FROM documents),
e AS (
  SELECT *, -ln((CAST(('0x' || substr(tie, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
            / greatest(1 / (1 + CAST(8 * signs AS DOUBLE) / greatest(size, 1) + abs(CAST(chars AS DOUBLE) / greatest(size, 1) - 6) / 6), 1e-6::DOUBLE) AS draw
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT *, least(most, coalesce((SELECT max(level) FROM l WHERE level < most / weight) * weight, most)) AS target FROM l),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT e.doc_id, e.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         sum(e.size) OVER (PARTITION BY e.source ORDER BY e.draw, e.tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - e.size / 2.0::DOUBLE AS mid
  FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
