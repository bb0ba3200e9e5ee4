"""Sessions and table access."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Invalid input gives null instead of an error, times are UTC, plans adapt at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "lakeloom", **settings: str) -> SparkSession:
    """The active session, or a new one, with this package's settings."""
    spark = SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """Put the session's settings back that `configure` changes."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory; only the columns used are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views for the tables of a directory."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
