"""Order-dependent building blocks that stay correct and balanced under skew.

A plain ``Window.partitionBy(g)`` puts every row of a group into one task.
If one customer or one day holds a third of all rows, that task is the job.
The helpers here never need a whole group in one task:

* ``running_sum`` / ``ordinal``: the rows are range-partitioned on (group,
  order), so a hot group is cut into contiguous slices on many tasks; each
  slice computes a local running sum, and the totals of earlier slices (a small
  table with one row per slice and group) are added as an offset.
* ``first_per_group``: min over a struct, a hash aggregate with map-side
  partial aggregation.
* ``top_k_per_group``: top-k per (group, salt), then top-k per group over at
  most ``salts x k`` rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list, value: Column | None = None,
                out: str = "running", partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (1 = running count) within each group.

    ``order_cols`` must be a total order inside a group (append a unique key).
    """
    from rinse.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    sort_keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    v = F.lit(1).cast("bigint") if value is None else value
    src = df.withColumn("_v", v)
    n = partitions or _n_partitions(df)
    # Group keys as non-null columns (value or type default, plus a null flag),
    # so NULL groups stay separate and every later window, aggregate and join
    # uses plain equality on the same columns: the join back to the slice
    # offsets then reuses the window's partitioning instead of re-shuffling.
    gk: list[str] = []
    d = src
    for i, g in enumerate(group_cols):
        d = (d.withColumn(f"_gk{i}", F.coalesce(F.col(g), _default(df.schema[g].dataType)))
              .withColumn(f"_gn{i}", F.col(g).isNull()))
        gk += [f"_gk{i}", f"_gn{i}"]
    # The slice of a row is its range partition.  Range bounds are sampled, so
    # the assignment is fixed by a reliable checkpoint: the local sums and the
    # slice totals then read the very same slices, and later passes start there.
    sliced = (d.repartitionByRange(n, *[F.col(g) for g in group_cols], *sort_keys)
               .withColumn("_slice", F.spark_partition_id())
               .checkpoint(eager=True))
    keys = ["_slice", *gk]
    w_local = Window.partitionBy(*keys).orderBy(*sort_keys).rowsBetween(Window.unboundedPreceding,
                                                                         Window.currentRow)
    local = sliced.withColumn("_local", F.sum("_v").over(w_local))
    # slice totals straight from the slices: map-side partial sums, one row per slice and group
    totals = sliced.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    w_off = Window.partitionBy(*gk).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_off), F.lit(0))).drop("_t")
    j = local.join(offsets, keys, "left")
    return (j.withColumn(out, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0)))
             .drop("_v", "_slice", "_local", "_off", *gk))


def _default(dtype: T.DataType) -> Column:
    """A non-null stand-in value of ``dtype`` (only used together with a null flag)."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.lit(dt.date(1970, 1, 1))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    return F.lit(0).cast(dtype)


def ordinal(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "ordinal",
            partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group, in ``order_cols`` order."""
    return running_sum(df, group_cols, order_cols, None, out, partitions)


def first_per_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    carry: list[str]) -> DataFrame:
    """One row per group: the values of ``carry`` on the smallest ``order_cols`` row."""
    s = F.min(F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_cols)],
                       *[F.col(c).alias(f"_c_{c}") for c in carry])).alias("_m")
    g = df.groupBy(*group_cols).agg(s)
    return g.select(*group_cols, *[F.col(f"_m._c_{c}").alias(c) for c in carry])


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_key: Column, salts: int = 64, out: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group by ``order`` (a total order), skew-safe.

    Phase 1 keeps the top k of each (group, salt) slice, where the salt is a
    hash of ``salt_key``; phase 2 ranks at most ``salts * k`` rows per group.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(salt_key), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return pre.withColumn(out, F.row_number().over(w2).cast("bigint")).filter(F.col(out) <= k)


def clamp(value, default: int, lo: int, hi: int) -> int:
    """Limit parameter: parse, default when not a number, clamp into [lo, hi]."""
    try:
        v = int(value)
    except (TypeError, ValueError):
        v = default
    return max(lo, min(v, hi))
