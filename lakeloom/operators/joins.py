"""Joins beyond those that Spark names: mark joins, band joins on time windows, exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.tablefuncs import tumbling_window

#: A side is broadcast on request only if its plan estimates at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Range joins: pairs of a bucket above which it is joined in tiles, points and ranges of a block, either of a tile, partitions of tiles.
CANDIDATES, POINTS, RANGES, TILE, PARTITIONS = 1 << 28, 1 << 6, 1 << 10, 1 << 14, 8000


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the optimizer's estimate allows it, else the frame as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def mark_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], column: str = "mark") -> DataFrame:
    """Every left row once, with true if an equal right key exists; two-valued, null never equals."""
    names = [f"_k{i}" for i in range(len(keys))]
    marks = right.select(*[F.col(r).alias(n) for n, (_, r) in zip(names, keys)]).na.drop().distinct().withColumn(column, F.lit(True))
    condition = None
    for n, (l, _) in zip(names, keys):
        c = left[l] == marks[n]
        condition = c if condition is None else condition & c
    return left.join(marks, condition, "left").drop(*names).withColumn(column, F.coalesce(column, F.lit(False)))


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two-valued NOT IN: a null on the right excludes nothing, a null on the left stays."""
    return left.join(right.select(F.col(right_key).alias("_k")), left[left_key] == F.col("_k"), "left_anti")


def window_band_join(left: DataFrame, right: DataFrame, left_ts: str, right_start: str, size: int, unit: str, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """``left.ts between right.start and right.start + size`` for starts on the tumbling grid.

    A time lies in just one window of the grid, so the band becomes an equality of window starts:
    a hash or merge join instead of comparing all pairs.
    """
    keyed = tumbling_window(left, left_ts, size, unit).withColumnRenamed("window_start", "_ws").drop("window_end")
    condition = keyed["_ws"] == right[right_start]
    return keyed.join(right, condition if extra is None else condition & extra, how).drop("_ws")


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_lo: str, right_hi: str, width: float, how: str = "inner") -> DataFrame:
    """``left.value between right.lo and right.hi`` by buckets of ``width``.

    Each range is listed under all buckets that it touches and each value under its own; the
    bounds are then checked. Choose a width near the usual range length. Inner joins whose columns
    have different names take buckets of more than CANDIDATES pairs in tiles, see `_tiled`; refer to
    the result's columns by name, and select those that you need first.
    """
    bucket = lambda c: F.floor(c / width).cast("bigint")
    ranges = right.filter(F.col(right_lo) <= F.col(right_hi)).withColumn("_b", F.explode(F.sequence(bucket(F.col(right_lo)), bucket(F.col(right_hi)))))
    points = left.withColumn("_p", bucket(F.col(left_value)))
    plain = lambda points, ranges: points.join(ranges, (points["_p"] == ranges["_b"]) & points[left_value].between(ranges[right_lo], ranges[right_hi]), how).drop("_p", "_b")
    names = [*left.columns, *right.columns]
    if how != "inner" or len({n.lower() for n in names}) < len(names):
        return plain(points, ranges)
    least, most = ranges.agg(F.min("_b"), F.max("_b")).first()
    points = points.filter(F.col("_p").between(least, most))
    pairs = points.groupBy("_p").agg(F.count("*").alias("np")).join(ranges.groupBy("_b").agg(F.count("*").alias("nr")), F.col("_p") == F.col("_b"))
    # a crowded bucket has 2 * sqrt(CANDIDATES) rows at least, so there is one in 32,768 rows at most
    crowded = [tuple(r) for r in pairs.filter(F.col("np").cast("double") * F.col("nr") > CANDIDATES).select("_b", "np", "nr").collect()]
    if not crowded:
        return plain(points, ranges)
    hot = F.broadcast(left.sparkSession.createDataFrame([(b, -(-np // POINTS), -(-nr // RANGES)) for b, np, nr in crowded], "_h bigint, _pn bigint, _rn bigint"))
    cold = [df.join(hot, F.col(k) == F.col("_h"), "left_anti") for df, k in ((points, "_p"), (ranges, "_b"))]
    tiles = sum(-(-np // TILE) * -(-nr // TILE) for _, np, nr in crowded)
    return plain(*cold).unionByName(_tiled(points, ranges, hot, left_value, right_lo, right_hi, min(2 * tiles, PARTITIONS)))


def _tiled(points: DataFrame, ranges: DataFrame, hot: DataFrame, value: str, lo: str, hi: str, partitions: int) -> DataFrame:
    """Range join of the buckets in ``hot`` (_h, _pn blocks of points, _rn blocks of ranges).

    Rows are packed into arrays of about POINTS or RANGES (equal rows share one), sorted by value, and
    tiles of about TILE by TILE rows spread over the tasks. Only arrays are copied to the tiles of
    their row or column, and pairs are made within a task, block by block, so that the result repeats
    and takes few bytes as Parquet. Generated code keeps all that a row leads to in memory: the step
    without code (coalesce, which moves nothing) makes this the pairs of two blocks, not of a tile.
    """

    def packed(df: DataFrame, key: str, first: str, blocks: str) -> DataFrame:
        columns = [c for c in df.columns if c != key]
        row = F.struct(F.col(first).alias("_first"), *columns)
        df = df.join(hot, F.col(key) == F.col("_h")).withColumn("_k", F.pmod(F.xxhash64(*columns), F.col(blocks)))
        return df.groupBy("_h", "_pn", "_rn", "_k").agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    tile = lambda k, rows: F.floor(k / (TILE // rows))
    over = lambda n, rows: F.explode(F.sequence(F.lit(0).cast("bigint"), tile(F.col(n) - 1, rows)))
    ps = packed(points, "_p", value, "_pn").select("_h", tile(F.col("_k"), POINTS).alias("_i"), over("_rn", RANGES).alias("_j"), F.col("_rows").alias("_ps")).repartition(partitions, "_h", "_i", "_j")
    rs = packed(ranges, "_b", lo, "_rn").select("_h", over("_pn", POINTS).alias("_i"), tile(F.col("_k"), RANGES).alias("_j"), F.col("_rows").alias("_rs")).repartition(partitions, "_h", "_i", "_j")
    blocks = ps.join(rs.hint("merge"), ["_h", "_i", "_j"]).coalesce(partitions)
    pairs = blocks.select(F.explode("_ps").alias("_l"), "_rs").select("_l", F.explode("_rs").alias("_r"))
    inside = F.col(f"_l.`{value}`").between(F.col(f"_r.`{lo}`"), F.col(f"_r.`{hi}`"))
    columns = lambda side, df, key: [F.col(f"{side}.`{c}`").alias(c) for c in df.columns if c != key]
    return pairs.filter(inside).select(*columns("_l", points, "_p"), *columns("_r", ranges, "_b"))


def exchange(df: DataFrame, kind: str, keys: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """scatter (by keys), broadcast (if its size allows) or single (one bucket)."""
    if kind == "scatter":
        args = ([partitions] if partitions else []) + list(keys or [])
        return df.repartition(*args)
    if kind == "broadcast":
        return broadcast_if_small(df)
    if kind == "single":
        return df.coalesce(1)
    raise ValueError(f"unknown exchange {kind}")
