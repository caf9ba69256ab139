"""The three commission definitions and their folds.

1. booked: ``SUM(commission_amount)`` as stored on the sale (``reports.by_staff``);
2. by role: ``ROUND(SUM(price * role rate / 100), 2)``, default rate 30 (``commission_by_role``);
3. by sale rate: ``SUM(price * COALESCE(sale pct, 30) / 100)`` unrounded (``staff_stats``).

Sales are aggregated per staff member *before* the join with the staff table,
so the join sees one row per staff member instead of one per sale.  For
definition 2 this is exact: the role rate is constant per staff member, so
``SUM(price * rate) = rate * SUM(price)`` in decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.operators import joins as J
from rinse.sources.schemas import MONEY, PCT, TOTAL


def _per_staff(washes: DataFrame, measure=None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("washes"), F.sum("unit_price").alias("_revenue")]
    if measure is not None:
        aggs.append(F.sum(measure).alias("commission"))
    return washes.filter(F.col("staff_id").isNotNull()).groupBy("staff_id").agg(*aggs)


def commission_by_role(staff: DataFrame, washes_in_period: DataFrame, rates: DataFrame,
                       default=C.DEFAULT_COMMISSION_PCT) -> DataFrame:
    """a11: every staff member with count, revenue and role-rate commission."""
    per = _per_staff(washes_in_period)
    s = J.with_rate(staff.select("id", "name", "role_label"), rates, "role_label", default)
    j = s.join(per, s["id"] == per["staff_id"], "left")
    revenue = F.coalesce(F.col("_revenue"), F.lit(0))
    return j.select("id", "name", "role_label",
                    F.coalesce(F.col("washes"), F.lit(0)).cast("bigint").alias("washes"),
                    revenue.cast(TOTAL).alias("revenue"),
                    F.round(revenue * F.col("rate_pct") / 100, 2).cast(TOTAL).alias("commission"))


def commission_totals(by_role: DataFrame) -> DataFrame:
    """a12: fold of a11 into business totals and percentages (1 decimal; 0 without revenue)."""
    t = by_role.agg(F.coalesce(F.sum("washes"), F.lit(0)).cast("bigint").alias("total_washes"),
                    F.coalesce(F.sum("revenue"), F.lit(0)).cast(TOTAL).alias("total_revenue"),
                    F.coalesce(F.sum("commission"), F.lit(0)).cast(TOTAL).alias("total_commission"))
    t = t.withColumn("business_profit", (F.col("total_revenue") - F.col("total_commission")).cast(TOTAL))
    from rinse.functions.expr import pct_of
    return t.withColumn("commission_percent", pct_of("total_commission", "total_revenue")) \
            .withColumn("profit_percent", pct_of("business_profit", "total_revenue"))


def staff_stats(staff: DataFrame, washes_in_period: DataFrame,
                default=C.DEFAULT_COMMISSION_PCT) -> DataFrame:
    """a13 (with j14): every staff member with count and commission at the rate on each sale."""
    rate = F.coalesce(F.col("commission_pct"), F.lit(default).cast(PCT))
    per = _per_staff(washes_in_period, F.col("unit_price") * rate / 100).drop("_revenue")
    return J.staff_with_stats(staff, per)


def book_commission(df: DataFrame, default=C.DEFAULT_COMMISSION_PCT) -> DataFrame:
    """w7: commission = round(price * pct / 100, 2), profit = price - commission; pct defaults."""
    pct = F.coalesce(F.col("commission_pct"), F.lit(default)).cast(PCT)
    commission = F.round(F.col("unit_price") * pct / 100, 2).cast(MONEY)
    return (df.withColumn("commission_pct", pct)
              .withColumn("commission_amount", commission)
              .withColumn("profit_amount", (F.col("unit_price") - F.col("commission_amount")).cast(MONEY)))
