"""Exchanges between processes: batches of rows in buckets of a shared folder, pulled by their readers.

One substream publishes, others pull the buckets that are theirs, each at its own pace: a reader
keeps the number of the last batch that it has taken. A batch counts once it is committed, and a
replayed one is skipped. Batches that all readers have taken can be released.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.streaming.views import State


class Exchange:
    """``buckets`` numbered logs under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets, self.state = spark, path.rstrip("/"), buckets, State(spark, path)

    def publish(self, batch: int, df: DataFrame, kind: str = "scatter", keys: list[str] | None = None) -> None:
        """Write a batch: each row to the bucket of its keys (scatter), to all (broadcast) or to the first (single)."""
        if batch <= self.state.committed():
            return
        if kind == "scatter":
            bucket = F.pmod(F.xxhash64(*(keys or df.columns)), F.lit(self.buckets)).cast("int")
        elif kind == "broadcast":
            bucket = F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1)))
        elif kind == "single":
            bucket = F.lit(0)
        else:
            raise ValueError(f"unknown exchange {kind}")
        schema = df.schema
        if self.state.committed() >= 0 and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in self._schema()]:
            raise ValueError("all batches of an exchange have the same columns")
        df.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/{batch}")
        if self.state.committed() < 0:
            self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        self.state.commit(batch)

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def pull(self, bucket: int, since: int, most: int | None = None) -> tuple[DataFrame, int]:
        """The rows of a bucket in the batches after ``since`` (at most so many), and the last batch taken."""
        last = self.state.committed()
        if last < 0:
            raise LookupError("nothing has been published")
        schema = self._schema()
        batches = [b for b in self.state._numbers("rows") if since < b <= last][:most]
        paths = [p for p in (f"{self.path}/rows/{b}/_bucket={bucket}" for b in batches) if self.state._fs.exists(self.state._jvm.org.apache.hadoop.fs.Path(p))]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows, batches[-1] if batches else since

    def release(self, until: int) -> None:
        """Delete the batches up to ``until``, which all readers have taken."""
        for b in self.state._numbers("rows"):
            if b <= until:
                self.state._fs.delete(self.state._p(f"rows/{b}"), True)
