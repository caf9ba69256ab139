"""As-of lookups into validity intervals, without pairing every query with every interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.operators.ordered import running_sum
from rinse.sources.sinks import materialise

END = (1 << 62)      # later than every time


def least_active(intervals: DataFrame, queries: DataFrame) -> DataFrame:
    """``key, at, least``: for each query the smallest ``value`` of the intervals of its key that hold at that time.

    ``intervals``: key, start, stop, value (bigint times; ``stop`` NULL = for
    ever), holding for ``start < at <= stop``.  ``queries``: key, at; distinct,
    ``at`` below 2**62.  Queries without an interval have a NULL ``least``; rows
    with a NULL key find nothing.

    A key's queries are numbered in time; an interval then covers a stretch of
    numbers, which is cut into at most two aligned blocks per power of two.  A
    query lies in one block per power, so both sides meet in an equi-join on
    (key, power, block): n log n rows, however many intervals overlap.  Numbers
    are running counts over slices, so a key with most of the rows is spread."""
    marks = intervals.filter("key IS NOT NULL").select(
        "key", "value", "start", F.explode(F.array(F.col("start"), F.coalesce("stop", F.lit(END)))).alias("t"))
    rows = (queries.filter("key IS NOT NULL").select("key", F.col("at").alias("t"), F.lit(0).alias("kind"), F.lit(1).cast("bigint").alias("v"),
                                                     F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("bigint").alias("start"))
            .unionByName(marks.select("key", "t", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("v"), "value", "start")))
    counted = materialise(running_sum(rows, ["key"], ["t", "kind", "value", "start"], F.col("v"), out="seen"), "asof-counted")

    # queries up to the start and up to the stop: the interval covers numbers [a, b)
    spans = counted.filter("kind = 1").groupBy("key", "value", "start").agg(F.min("seen").alias("a"), F.max("seen").alias("b")).filter("a < b")
    # bottom up: the stretch left at power p is [up, down); an odd edge is a block of its own
    up, down = "shiftright(a + shiftleft(1L, p) - 1, p)", "shiftright(b, p)"
    blocks = spans.selectExpr("key", "value", f"""explode(flatten(transform(sequence(0, length(bin(b))), p -> array_compact(array(
        CASE WHEN {up} < {down} AND {up} % 2 = 1 THEN struct(p AS power, {up} AS block) END,
        CASE WHEN {up} < {down} AND {down} % 2 = 1 THEN struct(p AS power, {down} - 1 AS block) END))))) AS at""")
    cover = materialise(blocks.groupBy("key", "at.power", "at.block").agg(F.min("value").alias("least")), "asof-cover")
    top = cover.groupBy("key").agg(F.max("power").alias("top"))
    asked = (counted.filter("kind = 0").select("key", F.col("t").alias("at"), (F.col("seen") - 1).alias("j"))
             .join(top, "key").selectExpr("key", "at", "j", "explode(sequence(0, top)) AS power").selectExpr("key", "at", "power", "shiftright(j, power) AS block"))
    found = asked.join(cover, ["key", "power", "block"]).groupBy("key", "at").agg(F.min("least").alias("least"))
    return queries.select("key", "at").join(found, ["key", "at"], "left")
