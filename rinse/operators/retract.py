"""Visit counters that survive changed and deleted sales without a full recompute (m12).

A count follows any change, a maximum does not: when the last visit goes, the
one before it must be known.  The state of a customer is

    customer_id, visits_count, last_visit, recent

with ``recent`` the ``keep`` latest distinct times and how many visits each has.
It holds every visit from its oldest time on, so a change there is settled in
the state; older visits are only counted.  A customer's sales are read again
only if all recent visits are gone and older ones are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.operators.ordered import top_k_per_group
from rinse.sources.sinks import materialise

KEEP = 8
CHANGE_COLS = ["old_customer_id", "old_washed_at", "new_customer_id", "new_washed_at"]
_COLS = ["customer_id", "visits_count", "last_visit", "recent"]


def _recent(times: DataFrame, keep: int) -> DataFrame:
    """``customer_id, recent`` from ``customer_id, at, n``: at most ``keep`` rows of a customer meet."""
    top = top_k_per_group(times, ["customer_id"], [F.col("at").desc()], keep, salt_key=F.col("at"))
    return top.groupBy("customer_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "n")))).alias("recent"))


def _per_time(visits: DataFrame) -> DataFrame:
    return (visits.filter("customer_id IS NOT NULL").groupBy("customer_id", F.col("washed_at").alias("at")).agg(F.count(F.lit(1)).alias("n")))


def counters_state(washes: DataFrame, keep: int = KEEP) -> DataFrame:
    """The state after all of ``washes`` (customer_id, washed_at); sales without a customer or time count for nobody."""
    times = _per_time(washes.filter("washed_at IS NOT NULL"))
    counts = times.groupBy("customer_id").agg(F.sum("n").alias("visits_count"), F.max("at").alias("last_visit"))
    return counts.join(_recent(times, keep), "customer_id").select(*_COLS)


def apply_changes(state: DataFrame, changes: DataFrame, washes: DataFrame, keep: int = KEEP) -> DataFrame:
    """The state after ``changes``; ``washes`` is the sales table after them.

    A change is one sale: its old customer and time (NULL: a new sale) and its
    new ones (NULL: deleted).  Customers without changes keep their row as it
    is, those without a visit lose it.  A change that takes back a visit that is
    not there is an error where the state shows it."""
    moved = changes.select(F.explode(F.array(
        F.struct(F.col("old_customer_id").alias("customer_id"), F.col("old_washed_at").alias("at"), F.lit(-1).cast("bigint").alias("n")),
        F.struct(F.col("new_customer_id").alias("customer_id"), F.col("new_washed_at").alias("at"), F.lit(1).cast("bigint").alias("n")))).alias("c")).select("c.*")
    delta = materialise(moved.filter("customer_id IS NOT NULL AND at IS NOT NULL").groupBy("customer_id", "at").agg(F.sum("n").alias("n"))
                        .filter("n <> 0"), "delta")
    touched = delta.groupBy("customer_id").agg(F.sum("n").alias("more"))
    known = state.join(touched, "customer_id", "left_semi").withColumn("held", F.expr("aggregate(recent, 0L, (s, r) -> s + r.n)"))
    # visits before the oldest recent time are only counted, if there are any
    floor = F.when(F.col("visits_count") > F.col("held"), F.element_at("recent", -1)["at"])
    floors = known.select("customer_id", "visits_count", floor.alias("floor"))

    near = (delta.join(floors, "customer_id", "left").filter("floor IS NULL OR at >= floor").select("customer_id", "at", "n")
            .unionByName(known.select("customer_id", F.explode("recent").alias("r")).select("customer_id", "r.at", "r.n")))
    broken = F.raise_error(F.lit("a change takes back a visit that is not there")).cast("bigint")
    times = (near.groupBy("customer_id", "at").agg(F.sum("n").alias("n"))
             .withColumn("n", F.when(F.col("n") < 0, broken).otherwise(F.col("n"))).filter("n > 0"))
    total = F.coalesce("visits_count", F.lit(0)) + F.col("more")
    wrong = (total < 0) | ((total == 0) & F.col("recent").isNotNull())
    # written, so that a few such customers are known as few and the sales need not be shuffled for them
    settled = materialise(touched.join(floors, "customer_id", "left").join(_recent(times, keep), "customer_id", "left")
                          .select("customer_id", F.when(wrong, broken).otherwise(total).alias("visits_count"), "recent").filter("visits_count > 0"), "settled")
    # all recent visits gone, older ones left: read these customers' sales again
    empty = materialise(settled.filter("recent IS NULL").select("customer_id"), "empty")
    changed = settled.filter("recent IS NOT NULL")
    if not empty.isEmpty():
        again = _recent(_per_time(washes.filter("washed_at IS NOT NULL").join(empty, "customer_id", "left_semi")), keep)
        changed = changed.unionByName(settled.drop("recent").join(again, "customer_id"))
    return (state.join(touched, "customer_id", "left_anti").select(*_COLS)
            .unionByName(changed.select("customer_id", "visits_count", F.element_at("recent", 1)["at"].alias("last_visit"), "recent")))


def changes_between(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """The changes that lead from one sales table to another: sales that are new, gone, or have another customer or time."""
    old = before.select(F.col(key).alias("_k"), F.col("customer_id").alias("old_customer_id"), F.col("washed_at").alias("old_washed_at"))
    new = after.select(F.col(key).alias("_k"), F.col("customer_id").alias("new_customer_id"), F.col("washed_at").alias("new_washed_at"))
    same = F.col("old_customer_id").eqNullSafe(F.col("new_customer_id")) & F.col("old_washed_at").eqNullSafe(F.col("new_washed_at"))
    return old.join(new, "_k", "full").filter(~same).select(*CHANGE_COLS)
