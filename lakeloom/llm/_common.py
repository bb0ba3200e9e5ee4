"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python kernel works on at once; arrays of a kernel take a few dozen times that.
CHUNK_BYTES = 1 << 19

_written: list[tuple[SparkSession, str]] = []


def storage_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster session is
    refused, as a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver ends."""
    path = f"{storage_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Delete what `materialize` and `new_path` left in the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; rows with 0 are held out. A null key has 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(1))


def sampled(rows: DataFrame, text: str, most: int) -> DataFrame:
    """At most ``most`` distinct rows, by the hash of the text: the same whatever the partitions.

    Copies are dropped before the limit (map-side first), so a row that fills a third of the
    table takes one place.
    """
    others = [c for c in rows.columns if c != text]
    once = rows.withColumn("_h", F.md5(F.col(text).cast("binary"))).groupBy("_h", *others).agg(F.first(text).alias(text))
    return once.orderBy("_h", *others).limit(most).select(*rows.columns)


def utf8(column: pa.Array) -> tuple:
    """(bytes, offsets) of a string array as numpy arrays, nulls empty, without copying the bytes."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def spans(offsets, limit: int = CHUNK_BYTES):
    """Consecutive (first, last) document ranges of about ``limit`` bytes; a longer one stands alone."""
    import numpy as np

    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


#: Up to so many ids or digests (some dozen bytes each) a list of them is broadcast; beyond, it is shuffled.
BROADCAST_IDS = 500_000
#: A key counts as hot above this share of the rows, so at most HOT_PARTS keys are hot.
HOT_PARTS = 1000
SALTS = 64


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """Join rows to the one row of their key on the right, with the rows of hot keys spread out.

    A key of more than 1/HOT_PARTS of the left rows is hot: there are fewer than HOT_PARTS such
    keys whatever the data, so their list is broadcast. Hot rows get one of SALTS salts from
    ``spread`` and the right row of a hot key is repeated for each salt; all else has salt 0.
    ``left`` should be a written table: it is read twice. The key must not be null.
    """
    n = left.count()
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1000, n // HOT_PARTS)).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    a = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")


#: Rows per Arrow batch of texts; Spark's usual 10000 may be some 100 MB on each side of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: what a task of texts holds at once.

    The setting is read when a frame runs, after the operator has returned it, so it is for the
    application to make: the queries and the pipeline do, the operators leave the session alone.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with workers that give memory back when a task ends (see `small_batches`)."""

    def lean(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(lean, schema)


def trim() -> None:
    """Return freed memory to the system; workers are used again by other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
