"""Sources and sinks from Python objects, configuration and the console."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ObjectPartition(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def object_source(spark: SparkSession, name: str, schema: str, fetch: Callable[[int], Iterable[tuple]], partitions: int = 1) -> DataFrame:
    """Rows that ``fetch(partition)`` yields on the executors, as a Python data source ``name``."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [ObjectPartition(i) for i in range(partitions)]

        def read(self, partition: ObjectPartition) -> Iterator[tuple]:
            yield from fetch(partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def full_load_changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Weighted changes between two full loads."""
    from pyspark.sql import functions as F

    from lakeloom.operators.normalize import differences

    return new.withColumn("_weight", F.lit(1)) if old is None else differences(old, new)


def configuration(spark: SparkSession, options: Any) -> DataFrame:
    """A configuration object, dictionary or list of them as rows."""
    rows = options if isinstance(options, list) else [options]
    return spark.createDataFrame([asdict(r) if is_dataclass(r) else r for r in rows])


def console(df: DataFrame, rows: int = 20) -> None:
    """Print rows, with the sign of their change if they have one."""
    df.show(rows, truncate=False)


def blackhole(df: DataFrame) -> None:
    """Compute everything and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def object_sink(df: DataFrame, upsert: Callable[[dict], None], delete: Callable[[dict], None]) -> None:
    """Call ``upsert`` or ``delete`` with every row, on the executors."""

    def run(rows: Iterator) -> None:
        for r in rows:
            d = r.asDict(True)
            (upsert if d.pop("_weight", 1) > 0 else delete)(d)

    df.foreachPartition(run)
