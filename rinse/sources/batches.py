"""Tables of published batches: a batch is in the table once, whole, or not at all.

A table is a folder with two parts:

* ``data/_batch=<n>/_attempt=<uuid>/...``: every attempt to write a batch stages
  its files in a folder of its own, so attempts never mix;
* ``log/batch=<n>``: one file with one row, the *marker*, that names the attempt
  which counts.  Spark's committer makes it appear by a single rename.

Readers take the attempts that markers name and nothing else, so a write that
broke off before its marker is invisible, and a batch that is written again
after its marker is left as it is.  Two writers of one batch both end with one
marker.  Batches are numbered by the caller, as a stream numbers its
micro-batches; the number, not the time, is the order of the table:

* an ``append`` batch adds its rows;
* a ``replace`` batch hides what smaller batches have on its days;
* ``compact`` writes all rows up to a batch as one ``base`` batch, which hides
  the batches it holds and keeps the log short.

The driver reads one row per batch since the last base; rows stay in tasks.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPEND, REPLACE, BASE = "append", "replace", "base"
MARKER = "number bigint, attempt string, mode string, part string, days array<string>, n_rows bigint"


def markers(spark: SparkSession, path: str) -> DataFrame:
    """Every marker of the log, one row each; a batch and a base may bear the same number."""
    rows = spark.createDataFrame([], MARKER)
    for kind in ("batch", BASE):
        try:
            rows = rows.unionByName(spark.read.schema(MARKER).json(f"{path}/log/{kind}=*", pathGlobFilter="*.json"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":    # nothing of this kind yet
                raise
    return rows


def counting(spark: SparkSession, path: str) -> DataFrame:
    """The markers that make up the table: the last base, if any, and the batches after it."""
    log = markers(spark, path)
    last = _last_base(log)
    if last is None:
        return log
    return log.filter((F.col("number") > last) | ((F.col("number") == last) & (F.col("mode") == BASE)))


def _last_base(log: DataFrame) -> int | None:
    return log.filter(F.col("mode") == BASE).agg(F.max("number")).first()[0]


def is_published(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the batch stands in the log by itself or inside a base."""
    log = markers(spark, path)
    return not log.filter((F.col("number") == batch) | ((F.col("mode") == BASE) & (F.col("number") >= batch))).isEmpty()


def stage(df: DataFrame, path: str, batch: int, part: str | None = "day") -> str:
    """Write the files of one attempt; returns its name.  Nobody reads them before ``publish``."""
    attempt = "a" + uuid.uuid4().hex
    if part:
        df = df.hint("rebalance", part)     # a day in few files, an oversized day in several tasks
    w = df.write.mode("error")
    (w.partitionBy(part) if part else w).parquet(_folder(path, batch, attempt))
    return attempt


def publish(spark: SparkSession, path: str, batch: int, attempt: str, schema: T.StructType, part: str | None = "day", mode: str = APPEND) -> bool:
    """Let ``attempt`` count for ``batch`` if nothing does so yet; False if it is in the table already."""
    if is_published(spark, path, batch):
        return False
    _mark(spark, path, "batch", batch, attempt, schema, part, mode)
    return True


def _folder(path: str, batch: int, attempt: str) -> str:
    return f"{path}/data/_batch={batch}/_attempt={attempt}"


def _mark(spark: SparkSession, path: str, kind: str, batch: int, attempt: str, schema: T.StructType, part: str | None, mode: str) -> None:
    staged = spark.read.schema(schema).parquet(_folder(path, batch, attempt))
    # days stand in the marker only where they hide something
    days = F.collect_set(F.coalesce(F.col(part).cast("string"), F.lit(""))) if part and mode == REPLACE else F.array().cast("array<string>")
    row = staged.agg(F.lit(batch).cast("bigint").alias("number"), F.lit(attempt).alias("attempt"), F.lit(mode).alias("mode"),
                     F.lit(part).cast("string").alias("part"), F.sort_array(days).alias("days"), F.count(F.lit(1)).alias("n_rows"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/log/{kind}={batch}")


def write_batch(df: DataFrame, path: str, batch: int, part: str | None = "day", mode: str = APPEND) -> bool:
    """Stage and publish ``df`` as batch ``batch`` (0 or more); False, and no change, if the batch is in the table already.

    An empty batch is published too, so that it is not tried again; it replaces
    nothing.  Rows without a ``part`` value form a day of their own."""
    if mode not in (APPEND, REPLACE):
        raise ValueError(f"mode {mode!r} is neither {APPEND!r} nor {REPLACE!r}")
    if mode == REPLACE and not part:
        raise ValueError("a replacing batch needs a partition column")
    if batch < 0:
        raise ValueError(f"batch {batch} is negative")
    spark = df.sparkSession
    if is_published(spark, path, batch):
        return False
    return publish(spark, path, batch, stage(df, path, batch, part), df.schema, part, mode)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all published batches; ``schema`` is that of the batches.  A table without batches is empty."""
    log = counting(spark, path)
    found = log.select("number", "attempt", "mode", "part").collect()       # one row per batch since the last base
    if not found:
        return spark.createDataFrame([], schema)
    # one scan over the folders that count; their names bring the batch along
    folders = T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_attempt", T.StringType())])
    table = spark.read.schema(folders).option("basePath", f"{path}/data").parquet(*[_folder(path, r["number"], r["attempt"]) for r in found])
    names = [f"`{n}`" for n in schema.names]
    parts = {r["part"] for r in found if r["mode"] == REPLACE}
    if not parts:
        return table.select(*names)
    (part,) = parts
    # the last batch that replaces a day: one row per replaced day
    since = (log.filter(F.col("mode") == REPLACE).select("number", F.explode("days").alias("_day"))
             .groupBy("_day").agg(F.max("number").alias("_since")))
    return (table.withColumn("_day", F.coalesce(F.col(part).cast("string"), F.lit(""))).join(since, "_day", "left")
            .filter("_since IS NULL OR _batch >= _since").select(*names))


def compact(spark: SparkSession, path: str, schema: T.StructType, part: str | None = "day") -> int | None:
    """Write the whole table as one base; returns the last batch it holds, None if the table has none.

    A smaller batch that was late and not published yet can no longer be: compact
    up to where the batches are complete."""
    last = counting(spark, path).agg(F.max("number")).first()[0]
    if last is not None:
        _mark(spark, path, BASE, last, stage(read_batches(spark, path, schema), path, last, part), schema, part, BASE)
    return last
