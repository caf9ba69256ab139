"""Monthly rankings, reward eligibility, top-k and the repeatable random pick
(sections 2.5 a14/a15 and 2.7 of the survey).

Sales are aggregated per customer before the customer table is joined, so
the join input is one row per customer and month, not one per sale.  Limits
use ``orderBy().limit()`` (TakeOrderedAndProject: each task keeps its own top
k, and one final task merges at most tasks x k rows).  Every order ends with a unique
key so that ties at the limit are broken the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.functions import periods as P
from rinse.operators.ordered import clamp, first_per_group, top_k_per_group


def top_k(df: DataFrame, order: list[Column], k, default: int, lo: int, hi: int) -> DataFrame:
    """l1: the first ``k`` rows by ``order`` with ``k`` parsed and clamped into [lo, hi]."""
    return df.orderBy(*order).limit(clamp(k, default, lo, hi))


def ordered(df: DataFrame, spec: list[Column]) -> DataFrame:
    """l3: sort with explicit NULL placement (callers pass asc_nulls_last etc.)."""
    return df.orderBy(*spec)


def ordered_car_types(car_types: DataFrame) -> DataFrame:
    """l3: car types by sort_order (NULLs last), then label."""
    return ordered(car_types, [F.col("sort_order").asc_nulls_last(), F.col("label").asc_nulls_last()])


def _vehicle_counts(washes: DataFrame, customers: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per customer (and extra groups) count and last sale, then the customer's plate and contact."""
    per = washes.groupBy("customer_id", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.max("washed_at").alias("_last"))
    c = customers.select(F.col("id").alias("customer_id"), F.col("vehicle_reg").alias("_creg"),
                         F.col("name").alias("_name"), F.col("phone").alias("_phone"))
    j = per.join(c, "customer_id", "left").filter(F.coalesce(F.col("_creg"), F.lit("")) != "")
    return (j.groupBy(X.reg(F.coalesce(F.col("_creg"), F.lit(""))).alias("vehicle_reg"), *group_cols)
            .agg(F.max("_name").alias("customer_name"), F.max("_phone").alias("customer_phone"),
                 F.sum("_n").cast("bigint").alias("washes"), F.max("_last").alias("last_wash")))


def vehicle_order() -> list[Column]:
    return [F.col("washes").desc(), F.col("last_wash").desc(), F.col("vehicle_reg").asc()]


def top_vehicles(washes: DataFrame, customers: DataFrame, month=None, limit=5, as_of=None) -> DataFrame:
    """a14: the month's most washed plates (the *customer's* plate, upper(trim)), with
    independent maxima of name and phone over the plate's customers."""
    d, lo, hi = C.TOP_VEHICLES_LIMIT
    w = P.month_filter(washes, "washed_at", month, as_of)
    return top_k(_vehicle_counts(w, customers, []), vehicle_order(), limit, d, lo, hi)


def top_vehicles_by_month(washes: DataFrame, customers: DataFrame, limit=5, salts: int = 64) -> DataFrame:
    """a14 for every month in one job: skew-safe top-k per month."""
    d, lo, hi = C.TOP_VEHICLES_LIMIT
    k = clamp(limit, d, lo, hi)
    counts = _vehicle_counts(washes.withColumn("month", X.month_start("washed_at")), customers, ["month"])
    return top_k_per_group(counts, ["month"], vehicle_order(), k, F.col("vehicle_reg"), salts)


def _eligible_counts(washes: DataFrame, customers: DataFrame, services: DataFrame,
                     service_id=None, keyword=None, group_cols: list[str] | None = None,
                     drop_anonymous: bool = False) -> DataFrame:
    """Per customer (NULL customers form one group, or none with ``drop_anonymous``): plate, phone, name maxima, count, last sale.

    plate per sale = COALESCE(UPPER(TRIM(sale plate)), UPPER(TRIM(customer plate))); its
    maximum over a customer's sales is the larger of the maximum sale plate and,
    if any sale has no plate, the customer's plate.
    """
    group_cols = group_cols or []
    svc = P.service_filter(services, service_id=service_id, keyword=keyword).select("id")
    known = washes.filter(F.col("customer_id").isNotNull()) if drop_anonymous else washes
    w = known.join(svc, known["service_id"] == svc["id"], "left_semi")
    per = w.groupBy("customer_id", *group_cols).agg(
        F.max(X.reg("vehicle_reg")).alias("_wreg"),
        (F.count(F.lit(1)) > F.count(X.reg("vehicle_reg"))).alias("_some_null"),
        F.count(F.lit(1)).alias("wash_count"), F.max("washed_at").alias("last_wash"))
    c = customers.select(F.col("id").alias("_cid"), F.col("vehicle_reg").alias("_creg"),
                         F.col("phone").alias("customer_phone"), F.col("name").alias("customer_name"))
    j = per.join(c, per["customer_id"] == c["_cid"], "left")
    reg = F.greatest(F.col("_wreg"), F.when(F.col("_some_null"), X.reg("_creg")))
    return j.select("customer_id", *group_cols,
                    reg.alias("vehicle_reg"), "customer_phone", "customer_name",
                    F.col("wash_count").cast("bigint").alias("wash_count"), "last_wash")


def eligible_order() -> list[Column]:
    return [F.col("wash_count").desc(), F.col("last_wash").desc(), F.col("customer_id").asc_nulls_last()]


def eligible_customers(washes: DataFrame, customers: DataFrame, services: DataFrame, date=None,
                       min_washes=C.ELIGIBLES_MIN_WASHES, limit=50, service_id=None, keyword=None,
                       as_of=None, drop_anonymous: bool = False) -> DataFrame:
    """a15: customers with at least ``min_washes`` full-service sales in the month of ``date``.

    Sales without a customer are one candidate together, as in the original; ``drop_anonymous`` leaves them out."""
    d, lo, hi = C.ELIGIBLES_LIMIT
    day = date if date and P._DAY.match(str(date)[:10]) else None
    lo_ts, hi_ts = P.month_bounds((str(day)[:7] if day else None), as_of)
    w = washes.filter(P.in_range("washed_at", lo_ts, hi_ts))
    mw = clamp(min_washes, C.ELIGIBLES_MIN_WASHES, -2**31, 2**31 - 1)
    e = _eligible_counts(w, customers, services, service_id, keyword, drop_anonymous=drop_anonymous)
    return top_k(e.filter(F.col("wash_count") >= mw), eligible_order(), limit, d, lo, hi)


def eligibles_by_month(washes: DataFrame, customers: DataFrame, services: DataFrame,
                       min_washes=C.ELIGIBLES_MIN_WASHES, limit=200, service_id=None, keyword=None,
                       salts: int = 64, drop_anonymous: bool = False) -> DataFrame:
    """a15 for every month at once (input of the automatic draw): skew-safe top-k per month."""
    d, lo, hi = C.ELIGIBLES_LIMIT
    k = clamp(limit, d, lo, hi)
    e = _eligible_counts(washes.withColumn("month", X.month_start("washed_at")), customers, services,
                         service_id, keyword, ["month"], drop_anonymous)
    e = e.filter(F.col("wash_count") >= int(min_washes))
    return top_k_per_group(e, ["month"], eligible_order(), k,
                           F.coalesce(F.col("customer_id").cast("string"), F.lit("")), salts)


def pick_key(key_cols: list[str], date_col: str, seed: str) -> Column:
    """md5(key || date || seed): a repeatable, uniform ordering of candidates."""
    parts = []
    for c in key_cols:
        parts += [F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")]
    return F.md5(F.concat(*parts, F.col(date_col).cast("string"), F.lit("|" + seed)))


def draw_suggestion(pool: DataFrame, date_col: str, key_cols: list[str], seed: str,
                    carry: list[str] | None = None) -> DataFrame:
    """l2: one uniform, repeatable pick per date: the row with the smallest pick key.

    A grouped min (partial aggregation on every task), so a date with a huge
    pool is never gathered in one place."""
    carry = carry or [c for c in pool.columns if c != date_col]
    p = pool.withColumn("_pick", pick_key(key_cols, date_col, seed))
    return first_per_group(p, [date_col], ["_pick", *key_cols], carry)
