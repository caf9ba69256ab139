"""Money reports, projections and simple per-day/per-month aggregates
(sections 2.3 and 2.5 of the survey).

Conventions: every sum is ``coalesce(sum(x), 0)`` cast to ``TOTAL``; counts
are ``bigint``; a global aggregate always yields one row.  Period filters are
applied before any aggregate so they reach the Parquet scan, and sales are
aggregated before they meet a dimension (``by_service``, ``by_staff``), which
keeps the join input at one row per key instead of one row per sale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.functions import periods as P
from rinse.operators import joins as J
from rinse.sources.schemas import TOTAL


def _sum(col: str, alias: str | None = None):
    return F.coalesce(F.sum(col), F.lit(0)).cast(TOTAL).alias(alias or col)


def _wash_totals(sales: DataFrame, with_count: bool = True) -> DataFrame:
    aggs = [_sum("unit_price", "revenue"), _sum("commission_amount", "commission"),
            _sum("profit_amount", "profit")]
    if with_count:
        aggs.insert(0, F.count(F.lit(1)).alias("wash_count"))
    return sales.agg(*aggs)


def _expense_total(expenses: DataFrame, alias: str = "expenses") -> DataFrame:
    return expenses.agg(_sum("amount", alias))


def _period(df: DataFrame, ts: str, period: dict) -> DataFrame:
    return P.period_filter(df, ts, **period)


# --- a1 / a2 / a7 / a8: one-row totals ----------------------------------------

def daily_report(sales: DataFrame, expenses: DataFrame, day) -> DataFrame:
    """a1: one day's count, revenue, commission, profit, expenses and net income."""
    w = _wash_totals(P.day_filter(sales, "washed_at", day))
    e = _expense_total(P.day_filter(expenses, "spent_at", day))
    out = J.cross_totals(w, e)
    return out.select(F.lit(C.as_date(day)).alias("day"), "*",
                      (F.col("profit") - F.col("expenses")).cast(TOTAL).alias("net_income"))


def summary_totals(sales: DataFrame, expenses: DataFrame, **period) -> DataFrame:
    """a2: totals of any period."""
    w = _wash_totals(_period(sales, "washed_at", period))
    e = _expense_total(_period(expenses, "spent_at", period))
    return J.cross_totals(w, e).withColumn(
        "net_income", (F.col("profit") - F.col("expenses")).cast(TOTAL))


def expense_total(expenses: DataFrame, **period) -> DataFrame:
    """a7: total expenses of a period."""
    return _expense_total(_period(expenses, "spent_at", period), "total_expenses")


def pnl_totals(sales: DataFrame, expenses: DataFrame, **period) -> DataFrame:
    """a8: revenue, commission, profit, expenses and net income of a period."""
    w = _wash_totals(_period(sales, "washed_at", period), with_count=False)
    e = _expense_total(_period(expenses, "spent_at", period))
    return J.cross_totals(w, e).withColumn(
        "net_income", (F.col("profit") - F.col("expenses")).cast(TOTAL))


# --- daily series -------------------------------------------------------------

def wash_daily(sales: DataFrame, with_count: bool = True) -> DataFrame:
    aggs = [_sum("unit_price", "revenue"), _sum("commission_amount", "commission"),
            _sum("profit_amount", "profit")]
    if with_count:
        aggs.insert(0, F.count(F.lit(1)).alias("wash_count"))
    return sales.groupBy(X.day("washed_at").alias("day")).agg(*aggs)


def expense_daily(expenses: DataFrame, **period) -> DataFrame:
    """a4: expenses per day of a period."""
    e = _period(expenses, "spent_at", period) if period else expenses
    return e.groupBy(X.day("spent_at").alias("day")).agg(_sum("amount", "expenses"))


def summary_daily(sales: DataFrame, expenses: DataFrame, **period) -> DataFrame:
    """a3: per sales day: count, money and that day's expenses; net = profit - expenses."""
    w = wash_daily(_period(sales, "washed_at", period))
    e = expense_daily(expenses, **period)
    s = J.left_series(w, e)
    return s.withColumn("net", (F.col("profit") - F.col("expenses")).cast(TOTAL))


def pnl_daily(sales: DataFrame, expenses: DataFrame, **period) -> DataFrame:
    """a9 (flagship): daily profit and loss including days with only sales or only
    expenses; net per day.  Two aggregates hash-partitioned by day meet in a
    full outer join without a further exchange."""
    w = wash_daily(_period(sales, "washed_at", period), with_count=False)
    e = expense_daily(expenses, **period)
    s = J.align_daily(w, e, "day")
    return s.withColumn("net", (F.col("profit") - F.col("expenses")).cast(TOTAL))


def day_over_day(sales: DataFrame, expenses: DataFrame, day) -> DataFrame:
    """a10: KPIs of a day and the day before, and the change of net income in percent.

    One scan per table over the two-day range with conditional sums (instead of
    one query per day and table)."""
    today = P._as_dt(day)
    yesterday = today - P.ONE_DAY
    s = sales.filter(P.in_range("washed_at", yesterday, today + P.ONE_DAY)) \
        .withColumn("_t", F.col("washed_at") >= P.ts_lit(today))
    e = expenses.filter(P.in_range("spent_at", yesterday, today + P.ONE_DAY)) \
        .withColumn("_t", F.col("spent_at") >= P.ts_lit(today))

    def both(col, alias):
        return [F.coalesce(F.sum(F.when(F.col("_t"), F.col(col))), F.lit(0)).cast(TOTAL).alias(f"t_{alias}"),
                F.coalesce(F.sum(F.when(~F.col("_t"), F.col(col))), F.lit(0)).cast(TOTAL).alias(f"y_{alias}")]

    w = s.agg(F.count(F.when(F.col("_t"), 1)).alias("t_wash_count"),
              F.count(F.when(~F.col("_t"), 1)).alias("y_wash_count"),
              *both("unit_price", "revenue"), *both("commission_amount", "commission"),
              *both("profit_amount", "profit"))
    x = e.agg(*both("amount", "expenses"))
    out = J.cross_totals(w, x)
    out = out.withColumn("t_net_income", (F.col("t_profit") - F.col("t_expenses")).cast(TOTAL)) \
             .withColumn("y_net_income", (F.col("y_profit") - F.col("y_expenses")).cast(TOTAL))
    return out.select(F.lit(today.date()).alias("date"), "*",
                      X.change_pct("t_net_income", "y_net_income").alias("delta_pct"))


def day_over_day_series(sales: DataFrame, expenses: DataFrame, **period) -> DataFrame:
    """a10 for every day with sales or expenses: that day's KPIs, the previous day's
    (0 when it had none) and the change of net income in percent.

    The daily series is joined to itself shifted by one day (an equi-join on the
    day), so no step needs all days in one task."""
    w = wash_daily(_period(sales, "washed_at", period) if period else sales)
    e = expense_daily(expenses, **period)
    daily = J.align_daily(w, e, "day").withColumn("wash_count", F.col("wash_count").cast("bigint"))
    daily = daily.withColumn("net_income", (F.col("profit") - F.col("expenses")).cast(TOTAL))
    kpis = ["wash_count", "revenue", "commission", "profit", "expenses", "net_income"]
    prev = daily.select(F.date_add("day", 1).alias("day"), *[F.col(k).alias(f"y_{k}") for k in kpis])
    j = daily.select("day", *[F.col(k).alias(f"t_{k}") for k in kpis]).join(prev, "day", "left")
    j = j.select("day", *[F.col(f"t_{k}") for k in kpis],
                 *[F.coalesce(F.col(f"y_{k}"), F.lit(0)).cast(daily.schema[k].dataType).alias(f"y_{k}") for k in kpis])
    return j.withColumn("delta_pct", X.change_pct("t_net_income", "y_net_income"))


# --- grouped by dimension name ---------------------------------------------------

def by_service(sales: DataFrame, services: DataFrame, **period) -> DataFrame:
    """a5: count and money per service *name* (same-named services merge)."""
    pre = _period(sales, "washed_at", period).groupBy("service_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("unit_price").alias("_r"),
        F.sum("commission_amount").alias("_c"), F.sum("profit_amount").alias("_p"))
    s = services.select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    j = pre.join(s, "service_id")
    return j.groupBy("service").agg(F.sum("_n").cast("bigint").alias("washes_count"),
                                    _sum("_r", "revenue"), _sum("_c", "commission"), _sum("_p", "profit"))


def by_staff(sales: DataFrame, staff: DataFrame, **period) -> DataFrame:
    """a6: count and booked commission per staff *name*; sales without staff excluded."""
    pre = (_period(sales, "washed_at", period).filter(F.col("staff_id").isNotNull())
           .groupBy("staff_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("commission_amount").alias("_c")))
    st = staff.select(F.col("id").alias("staff_id"), F.col("name").alias("staff_name"))
    j = pre.join(st, "staff_id")
    return j.groupBy("staff_name").agg(F.sum("_n").cast("bigint").alias("washes_count"),
                                       _sum("_c", "commission_to_pay"))


# --- simple counters ------------------------------------------------------------

def free_per_day(sales: DataFrame) -> DataFrame:
    """a16: number of free sales per day."""
    return sales.filter(F.col("is_free")).groupBy(X.day("washed_at").alias("day")) \
        .agg(F.count(F.lit(1)).alias("free_count"))


def visits_per_month(washes: DataFrame) -> DataFrame:
    """a17: sales per customer and month; anonymous sales excluded."""
    return (washes.filter(F.col("customer_id").isNotNull())
            .groupBy("customer_id", X.month_start("washed_at").alias("month"))
            .agg(F.count(F.lit(1)).alias("visits")))


def reward_use(washes: DataFrame, promos: DataFrame, code: str = C.PROMO_FEATURED) -> DataFrame:
    """a18: per plate and month, whether (and how often) the reward with ``code`` was used,
    i.e. a free sale carrying that promotion."""
    p = promos.select(F.col("id").alias("_pid"), F.col("code").alias("_code"))
    w = washes.join(p, washes["promo_id"] == p["_pid"], "left")
    used = F.col("is_free") & (F.col("_code") == code)
    return (w.filter(X.plate("vehicle_reg") != "")
            .groupBy(X.plate("vehicle_reg").alias("vehicle_reg"), X.month_start("washed_at").alias("month"))
            .agg(F.count(F.when(used, 1)).alias("reward_uses"))
            .withColumn("reward_used", F.col("reward_uses") > 0))


# --- projections (2.3) -------------------------------------------------------------

def expense_list(expenses: DataFrame, month=None, as_of=None) -> DataFrame:
    """p_expense_list: a month's expenses, newest first, creator NULLs last."""
    e = P.month_filter(expenses, "spent_at", month, as_of)
    return e.select("id", "category", F.col("note").alias("description"), "amount", "spent_at",
                    F.lit(None).cast("string").alias("receipt_no"),
                    "created_by_user_id") \
        .orderBy(F.col("spent_at").desc(), F.col("created_by_user_id").asc_nulls_last(), "id") \
        .drop("created_by_user_id")


def expenses_in_period(expenses: DataFrame, **period) -> DataFrame:
    """p_expense_period: a period's expenses (intended columns), newest first."""
    e = _period(expenses, "spent_at", period)
    return e.select("id", F.col("note").alias("description"), "amount", "spent_at", "created_at") \
        .orderBy(F.col("spent_at").desc(), F.col("created_at").desc(), "id")


def featured_for_month(featured: DataFrame, month=None, as_of=None) -> DataFrame:
    """p_featured_list: featured plates of a month, ``upper(trim(plate))``, newest first."""
    lo, _ = P.month_bounds(month, as_of)
    f = featured.filter(F.col("month") == F.lit(lo.date()))
    cols = set(featured.columns)
    return f.select("id", X.reg("vehicle_reg").alias("vehicle_reg"), "month",
                    (F.col("used_at") if "used_at" in cols else F.lit(None).cast("timestamp_ntz")).alias("used_at"),
                    (F.col("featured_by") if "featured_by" in cols else F.lit(None).cast("string")).alias("created_by"),
                    "created_at") \
        .orderBy(F.col("created_at").desc(), "id")


def rate_list(rates: DataFrame) -> DataFrame:
    """p_rate_list: commission rates ordered by role."""
    return rates.select("role", "percentage").orderBy("role")
