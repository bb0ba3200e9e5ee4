"""CSV, XML, text and Parquet files, read in batch or as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, delimiter: str = ",", stream: bool = False) -> DataFrame:
    """A declared schema, so files aren't read to infer one; bad values become null."""
    return _reader(spark, stream).schema(schema).option("header", header).option("sep", delimiter).option("mode", "PERMISSIVE").csv(path)


def csv_with_deltas(spark: SparkSession, initial: str, deltas: str, schema: str, weight: Column, **options) -> DataFrame:
    """Initial rows with weight 1 and rows of delta files with ``weight`` (e.g. -1 for deletes)."""
    first = csv(spark, initial, schema, **options).withColumn("_weight", F.lit(1))
    return first.unionByName(csv(spark, deltas, schema, **options).withColumn("_weight", weight.cast("int")))


def xml(spark: SparkSession, path: str, row: str, schema: str, xsd: str | None = None, stream: bool = False) -> DataFrame:
    """Elements named ``row``; with ``xsd`` rows that don't validate are null."""
    reader = _reader(spark, stream).format("xml").option("rowTag", row).schema(schema)
    return (reader.option("rowValidationXSDPath", xsd) if xsd else reader).load(path)


def text(spark: SparkSession, path: str, column: str = "value", stream: bool = False) -> DataFrame:
    """One row per line, with its file's name."""
    df = _reader(spark, stream).text(path)
    return df.select(F.col("value").alias(column), F.col("_metadata.file_path").alias("file_name"))


def parquet(spark: SparkSession, path: str, schema: str | None = None, stream: bool = False) -> DataFrame:
    reader = _reader(spark, stream)
    return (reader.schema(schema) if schema else reader).parquet(path)
