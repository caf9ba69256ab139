"""Sinks: write a table snapshot partitioned by day, and read it back typed.

``mode="overwrite"`` uses dynamic partition overwrite: a batch replaces exactly
the days it contains and leaves every other day untouched.  ``mode="append"``
adds a batch's rows beside those already there, for new sales of days that
have some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rinse.session import shared_dir


def write_snapshot(df: DataFrame, path: str, part: str | None = "day", mode: str = "overwrite") -> None:
    if part:
        # REBALANCE clusters rows by day (few files per day) while AQE splits an
        # oversized day across several writer tasks, so a hot day is not one task.
        df = df.hint("rebalance", part)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if part:
        w = w.partitionBy(part)
    w.parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage of a loop's table."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)
