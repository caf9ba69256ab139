"""Replay a table as a file stream, and run a stream to completion.

``stage_slices`` writes a table once, partitioned into consecutive time
ranges.  ``replay`` then lets the ranges arrive one after the other: it appends
a range's files to the stream's source folder (each range is read back by its
partition alone) and runs the stream over what is new with the
``availableNow`` trigger, again and again from the same checkpoint, as a
scheduled stream would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinse.session import shared_dir


def stage_slices(df: DataFrame, ts_col: str, slices: int, name: str) -> str:
    """Write ``df`` with a column ``slice`` (0 to ``slices`` - 1, equal ranges of ``ts_col``), partitioned by it."""
    path = shared_dir(df.sparkSession, f"{name}-staged")
    lo, hi = df.agg(F.min(ts_col), F.max(ts_col)).first()
    if lo is None:
        cut = F.lit(0)
    else:
        seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
        start = seconds(F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz"))
        width = max((hi - lo).total_seconds(), 1e-6) / slices
        cut = F.least(F.floor((seconds(F.col(ts_col)) - start) / width), F.lit(slices - 1)).cast("int")
    df.withColumn("slice", cut).write.partitionBy("slice").parquet(path)
    return path


def replay(df: DataFrame, ts_col: str, slices: int, name: str, mode: str, build: Callable[[DataFrame], DataFrame],
           ckpt: str | None = None) -> str:
    """Feed ``df`` to the stream ``build`` makes, one time range per run; returns the folder holding the result.

    ``ckpt``: the stream's checkpoint folder, for a reader of its state."""
    spark = df.sparkSession
    staged = stage_slices(df, ts_col, slices, name)
    source, out, own_ckpt = (shared_dir(spark, f"{name}-{x}") for x in ("source", "out", "ckpt"))
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(staged)
    for k in range(slices):
        whole.filter(F.col("slice") == k).drop("slice").write.mode("append").parquet(source)
        run_available(spark, build(spark.readStream.schema(df.schema).parquet(source)), mode, out, ckpt or own_ckpt)
    return out


def run_available(spark: SparkSession, stream_df: DataFrame, mode: str, out: str, ckpt: str) -> None:
    """Run ``stream_df`` over all available input, writing to the folder ``out``.

    ``update`` mode appends, per micro-batch, only the keys that changed,
    tagged with the batch id (``_epoch``); ``latest`` turns that change log
    into the current table.  A retried batch rewrites identical rows, so the
    log stays correct under replays.  ``complete`` rewrites the whole result
    every batch (small results only); ``append`` uses the Parquet file sink;
    ``state`` writes nothing, for results that are read from the state."""
    w = stream_df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "update":
        def log(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch).cast("bigint")).write.mode("append").parquet(out)
        q = w.outputMode("update").foreachBatch(log).start()
    elif mode == "state":
        q = w.outputMode("update").format("noop").start()
    elif mode == "complete":
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode("complete").foreachBatch(write).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", out).start()
    q.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current table from an update-mode change log: the last epoch's row per key."""
    from rinse.operators.maintenance import latest_per_key
    log = spark.read.parquet(path)
    cols = [c for c in log.columns if c not in keys and c != "_epoch"]
    return latest_per_key(log, keys, ["_epoch"], cols)
