"""Running state per customer as sales arrive (section 2.11 of the survey).

``counters_stream``: visits_count and last_visit per customer, a streaming
aggregate (Spark keeps the running count and max in its state store).

``loyalty_stream``: the n-th-visit-of-the-month flag at arrival time.  Customers
are dealt to buckets by hash, because a call per customer costs far more than
the customer's rows.  Each (bucket, month) key keeps the visits seen so far of
its customers in a value state; with a watermark, an event-time timer drops it
when the month is over (without one none expires, so a sale of any age still
counts every earlier one).  A micro-batch brings the key's new rows; those of a
customer are ordered by (washed_at, id) and numbered after the stored count.
Ordinals follow arrival, as in the reference, so a late sale takes the next
ordinal and earlier ones are never renumbered.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rinse import config as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: of customers, fixed for the life of a checkpoint
BUCKETS = 512

LOYALTY_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("month", T.DateType()), T.StructField("ordinal", T.LongType()),
    T.StructField("loyalty_hit", T.BooleanType()),
])


def counters_stream(stream: DataFrame) -> DataFrame:
    """st1: per customer, number of sales and the last sale time (anonymous sales excluded)."""
    return (stream.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("visits_count"), F.max("washed_at").alias("last_visit")))


def counters_now(spark: SparkSession, ckpt: str, booked: DataFrame | None = None) -> DataFrame:
    """st1: the counters as the stream's own state holds them after its last batch, read with the state reader.

    ``booked``: sales from before the stream; their counters are added, so a
    stream need not start at the first sale.  Nothing has to be logged beside
    the state, and the read costs one row per customer."""
    state = spark.read.format("statestore").load(ckpt)
    count, last = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    now = state.selectExpr("key.customer_id", f"{count} AS visits_count", f"{last} AS last_visit")
    if booked is not None:
        now = now.unionByName(counters_stream(booked)).groupBy("customer_id").agg(
            F.sum("visits_count").alias("visits_count"), F.max("last_visit").alias("last_visit"))
    return now


def _month_over_ms(month: dt.date) -> int:
    """When a month is over in every time zone: a day after its end in UTC."""
    end = dt.datetime(month.year + month.month // 12, month.month % 12 + 1, 2, tzinfo=dt.timezone.utc)
    return int(end.timestamp() * 1000)


class LoyaltyCounter(StatefulProcessor):
    """Numbers the sales of each customer of a key in arrival order, continuing from the stored counts.

    With ``expires``, a timer at the month's end drops the counts once the
    watermark has passed it: no sale of the month can come any more."""

    def __init__(self, every_n: int = C.LOYALTY_EVERY_N, ttl_ms: int | None = None, expires: bool = False):
        self.every_n, self.ttl_ms, self.expires = every_n, ttl_ms, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = T.ArrayType(T.LongType())
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("customers", longs), T.StructField("n", longs)]), self.ttl_ms)

    def _add(self, key, customers: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Add ``n`` to the counts of ``customers`` (each once); returns the counts before."""
        held = self.seen.get() if self.seen.exists() else None
        if held is None and self.expires:
            self.handle.registerTimer(_month_over_ms(key[1]))
        before = pd.Series(held[1], index=held[0], dtype="int64") if held else pd.Series(dtype="int64")
        now = before.add(pd.Series(n, index=customers), fill_value=0)
        self.seen.update((now.index.astype("int64").tolist(), now.astype("int64").tolist()))
        return before.reindex(customers, fill_value=0).to_numpy()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        n = initialState.groupby("customer_id")["n"].sum()
        self._add(key, n.index.to_numpy(), n.to_numpy())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["customer_id", "washed_at", "id"], kind="mergesort", ignore_index=True)
        if self.expires and _month_over_ms(key[1]) <= timerValues.getCurrentWatermarkInMs():
            return      # later than the watermark allows: the counts are gone
        who = batch["customer_id"].astype("int64")
        customers, place, n = np.unique(who, return_inverse=True, return_counts=True)
        ordinal = self._add(key, customers, n)[place] + who.groupby(who).cumcount() + 1
        yield pd.DataFrame({"id": batch["id"].astype("int64"), "customer_id": who,
                            "month": batch["month"], "ordinal": ordinal,
                            "loyalty_hit": (ordinal % self.every_n) == 0})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def loyalty_stream(stream: DataFrame, every_n: int = C.LOYALTY_EVERY_N, ttl_ms: int | None = None,
                   lateness: str | None = None, booked: DataFrame | None = None) -> DataFrame:
    """st2: every sale of a known customer with its ordinal in the month and the loyalty flag.

    With ``lateness`` (such as "2 days") the state is bounded: a sale may come
    that much after the latest one, and a month's counts are dropped once none
    of its sales can come any more; later ones are left out.  With ``ttl_ms`` a
    month's count is dropped that long (processing time) after its last sale
    instead, and a later sale of the month would start at 1 again.

    ``booked``: sales from before the stream (customer_id, washed_at), whose
    counts the state starts from.  Needs the RocksDB state store
    (``rocksdb_session``)."""
    if ttl_ms and lateness:
        raise ValueError("state expires by event time (lateness) or by processing time (ttl_ms), not by both")
    month = F.trunc(F.to_date("washed_at"), "MM").alias("month")
    s = stream.filter(F.col("customer_id").isNotNull())
    # a time to live holds for a whole value, so there each customer has one of its own
    bucket = (F.col("customer_id") if ttl_ms else F.pmod(F.xxhash64("customer_id"), F.lit(BUCKETS))).cast("bigint").alias("bucket")
    cols = [bucket, "id", "customer_id", "washed_at", month]
    if lateness:    # a watermark wants an instant: the wall-clock time in the session's zone
        s = s.select(*cols, F.col("washed_at").cast("timestamp").alias("_event")).withWatermark("_event", lateness)
    else:
        s = s.select(*cols)
    start = None
    if booked is not None:
        start = (booked.filter("customer_id IS NOT NULL").select(bucket, "customer_id", month).groupBy("bucket", "customer_id", "month")
                 .agg(F.count(F.lit(1)).alias("n")).groupBy("bucket", "month"))
    return s.groupBy("bucket", "month").transformWithStateInPandas(
        statefulProcessor=LoyaltyCounter(every_n, ttl_ms, bool(lateness)), outputStructType=LOYALTY_OUT, outputMode="Append",
        timeMode="EventTime" if lateness else "ProcessingTime" if ttl_ms else "None", initialState=start)


def rocksdb_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream, with its state in RocksDB (on disk, checkpointed).

    The settings stay in that session.  Micro-batches without data are off:
    with them an ``availableNow`` run over a state that expires by processing
    time would never become idle."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own
