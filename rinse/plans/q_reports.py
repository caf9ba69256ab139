"""Registered report queries: sources, predicates, projections, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import periods as P
from rinse.operators import reports as R
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.registry import register
from rinse.sources import bindings as B
from rinse.sources import batches, sinks

# A period that spans every table at every scale factor (whole-table reports).
FULL = {"from_": "1992-01-01", "to": "2030-12-31"}
FULL_SQL = "TIMESTAMP '1992-01-01 00:00:00'", "TIMESTAMP '2031-01-01 00:00:00'"
DAY = "1998-06-15"
MONEY = "CAST({} AS DECIMAL(22,2))"


def _rng(col: str, lo: str = FULL_SQL[0], hi: str = FULL_SQL[1]) -> str:
    return f"{col} >= {lo} AND {col} < {hi}"


def _sum(col, alias):
    return f"CAST(COALESCE(SUM({col}), 0) AS DECIMAL(22,2)) AS {alias}"


# --- sources and sinks ---------------------------------------------------------

@register("src_typed_read", W(["b_washes"], "SELECT * FROM b_washes"))
def q_src_typed_read(spark, d):
    from rinse.sources.schemas import WASHES, conform
    return conform(B.washes(spark, d), WASHES)


_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@register("src_file_fill", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT({c}) AS n_values FROM events" for c in _EVENT_COLUMNS))
def q_src_file_fill(spark, d):
    from rinse.sources.tables import DRIVER_SCHEMAS, file_fill
    fill = file_fill(spark, f"{d.rstrip('/')}/events.parquet", DRIVER_SCHEMAS["events"])
    return fill.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))


@register("snk_snapshot", W(["b_expenses"], "SELECT *, CAST(spent_at AS DATE) AS day FROM b_expenses"))
def q_snk_snapshot(spark, d):
    from rinse.functions import expr as X
    from rinse.session import shared_dir
    path = shared_dir(spark, "expenses-snapshot")
    e = B.expenses(spark, d).withColumn("day", X.day("spent_at"))
    sinks.write_snapshot(e, path, part="day")
    return sinks.read_snapshot(spark, path, e.schema)


_CORRECTED = "category = '1-URGENT' AND month >= DATE '1996-03-01' AND month < DATE '1996-05-01'"


@register("snk_batches", W(["b_expenses"], f"""
, e AS (SELECT *, CAST(date_trunc('month', spent_at) AS DATE) AS month FROM b_expenses),
  c AS (SELECT * REPLACE (CAST(amount * 2 AS DECIMAL(12,2)) AS amount) FROM e WHERE {_CORRECTED})
SELECT * FROM e WHERE month NOT IN (SELECT month FROM c) UNION ALL SELECT * FROM c"""))
def q_snk_batches(spark, d):
    """All expenses in four batches with retries, a write that broke off and a compaction, then two months of one category restated."""
    from rinse.session import shared_dir
    path = shared_dir(spark, "expense-batches")
    e = B.expenses(spark, d).withColumn("month", F.trunc(F.to_date("spent_at"), "MM"))
    arrived = [e.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == k) for k in range(4)]
    for k in (0, 1, 1):
        batches.write_batch(arrived[k], path, k, "month")
    batches.stage(arrived[2], path, 2, "month")                   # broke off before publishing
    batches.write_batch(arrived[2], path, 2, "month")
    batches.compact(spark, path, e.schema, "month")
    for k in (1, 3, 3):
        batches.write_batch(arrived[k], path, k, "month")
    corrected = e.filter(_CORRECTED).withColumn("amount", (F.col("amount") * 2).cast(e.schema["amount"].dataType))
    batches.write_batch(corrected, path, 4, "month", mode=batches.REPLACE)
    return batches.read_batches(spark, path, e.schema)


# --- predicates -------------------------------------------------------------------

@register("f_period", W(["b_sales"], "SELECT * FROM b_sales WHERE "
                        + _rng("washed_at", "TIMESTAMP '1996-03-01'", "TIMESTAMP '1999-10-01'")))
def q_f_period(spark, d):
    return P.period_filter(B.sales(spark, d), "washed_at", from_="1996-03-01", to="1999-09-30")


@register("f_day", W(["b_expenses"], "SELECT * FROM b_expenses WHERE "
                     + _rng("spent_at", f"TIMESTAMP '{DAY}'", f"TIMESTAMP '{DAY}' + INTERVAL 1 DAY")))
def q_f_day(spark, d):
    return P.day_filter(B.expenses(spark, d), "spent_at", DAY)


@register("f_rolling", W(["b_sales"], "SELECT * FROM b_sales WHERE washed_at >= TIMESTAMP '2001-06-07 12:00:00'"))
def q_f_rolling(spark, d):
    return P.rolling_filter(B.sales(spark, d), "washed_at", "month", "2001-07-07T12:00:00")


@register("f_month", W(["b_sales"], "SELECT * FROM b_sales WHERE "
                       + _rng("washed_at", "TIMESTAMP '1998-07-01'", "TIMESTAMP '1998-08-01'")))
def q_f_month(spark, d):
    return P.month_filter(B.sales(spark, d), "washed_at", "1998-07", as_of="2001-01-01")


@register("f_open_range", W(["b_sales"], "SELECT * FROM b_sales WHERE washed_at >= TIMESTAMP '2000-02-29'"))
def q_f_open_range(spark, d):
    return P.open_range_filter(B.sales(spark, d), "washed_at", from_="2000-02-29")


@register("f_service", W(["b_services"], "SELECT * FROM b_services WHERE name ILIKE '%gear%'"))
def q_f_service(spark, d):
    return P.service_filter(B.services(spark, d), keyword="gear")


@register("f_nonblank", W(["b_customers"], "SELECT * FROM b_customers WHERE COALESCE(vehicle_reg, '') <> ''"))
def q_f_nonblank(spark, d):
    return P.nonblank_filter(B.customers(spark, d), "vehicle_reg")


# --- projections ------------------------------------------------------------------

@register("p_expense_list", W(["b_expenses"], """
SELECT id, category, note AS description, amount, spent_at, CAST(NULL AS VARCHAR) AS receipt_no
FROM b_expenses WHERE """ + _rng("spent_at", "TIMESTAMP '1998-03-01'", "TIMESTAMP '1998-04-01'")))
def q_p_expense_list(spark, d):
    return R.expense_list(B.expenses(spark, d), "1998-03", as_of="2001-01-01")


@register("p_expense_period", W(["b_expenses"], "SELECT id, note AS description, amount, spent_at, created_at "
                                "FROM b_expenses WHERE " + _rng("spent_at")))
def q_p_expense_period(spark, d):
    return R.expenses_in_period(B.expenses(spark, d), **FULL)


@register("p_featured_list", W(["b_featured"], """
SELECT id, upper(trim(vehicle_reg)) AS vehicle_reg, month, CAST(NULL AS TIMESTAMP) AS used_at,
       CAST(NULL AS VARCHAR) AS created_by, created_at
FROM b_featured WHERE month = DATE '2024-01-01'"""))
def q_p_featured_list(spark, d):
    return R.featured_for_month(B.featured(spark, d), "2024-01", as_of="2024-02-01")


@register("p_rate_list", W(["b_rates"], "SELECT role, percentage FROM b_rates"))
def q_p_rate_list(spark, d):
    return R.rate_list(B.rates(spark, d))


# --- aggregations -------------------------------------------------------------------

def _moves(lo=None, hi=None):
    """Sales and expenses as rows of one table; each fills its own amounts."""
    when = (lambda c: _rng(c, lo, hi)) if lo else _rng
    return f""", moves AS (
  SELECT CAST(washed_at AS DATE) AS day, 1 AS sales, unit_price AS revenue, commission_amount AS commission,
         profit_amount AS profit, NULL AS expenses FROM b_sales WHERE {when('washed_at')}
  UNION ALL BY NAME SELECT CAST(spent_at AS DATE) AS day, 0 AS sales, amount AS expenses FROM b_expenses WHERE {when('spent_at')})"""


_AMOUNTS = ", ".join(_sum(c, c) for c in ("revenue", "commission", "profit", "expenses"))
_NET = "CAST(COALESCE(SUM(profit), 0) - COALESCE(SUM(expenses), 0) AS DECIMAL(22,2))"


@register("a1_daily_report", W(["b_sales", "b_expenses"], f"""
{_moves(f"TIMESTAMP '{DAY}'", f"TIMESTAMP '{DAY}' + INTERVAL 1 DAY")}
SELECT DATE '{DAY}' AS day, COUNT(*) FILTER (sales = 1) AS wash_count, {_AMOUNTS}, {_NET} AS net_income FROM moves"""))
def q_a1(spark, d):
    return R.daily_report(B.sales(spark, d), B.expenses(spark, d), DAY)


@register("a2_summary_totals", W(["b_sales", "b_expenses"], f"""
{_moves()}
SELECT COUNT(*) FILTER (sales = 1) AS wash_count, {_AMOUNTS}, {_NET} AS net_income FROM moves"""))
def q_a2(spark, d):
    return R.summary_totals(B.sales(spark, d), B.expenses(spark, d), **FULL)


_WS = (f"SELECT CAST(washed_at AS DATE) AS day, COUNT(*) AS wash_count, {_sum('unit_price', 'revenue')}, "
       f"{_sum('commission_amount', 'commission')}, {_sum('profit_amount', 'profit')} "
       f"FROM b_sales WHERE {_rng('washed_at')} GROUP BY 1")
_ES = f"SELECT CAST(spent_at AS DATE) AS day, {_sum('amount', 'expenses')} FROM b_expenses WHERE {_rng('spent_at')} GROUP BY 1"


@register("a3_summary_daily", W(["b_sales", "b_expenses"], f"""
, ws AS ({_WS}), es AS ({_ES})
SELECT ws.*, CAST(COALESCE(es.expenses, 0) AS DECIMAL(22,2)) AS expenses,
       CAST(ws.profit - COALESCE(es.expenses, 0) AS DECIMAL(22,2)) AS net
FROM ws LEFT JOIN es ON ws.day = es.day"""))
def q_a3(spark, d):
    return R.summary_daily(B.sales(spark, d), B.expenses(spark, d), **FULL).orderBy("day")


@register("a4_expense_daily", W(["b_expenses"], _ES))
def q_a4(spark, d):
    return R.expense_daily(B.expenses(spark, d), **FULL).orderBy("day")


@register("a5_by_service", W(["b_sales", "b_services"], f"""
, per_id AS (SELECT service_id, COUNT(*) AS n, SUM(unit_price) AS r, SUM(commission_amount) AS c, SUM(profit_amount) AS p
             FROM b_sales WHERE {_rng('washed_at')} GROUP BY service_id),
  named AS (SELECT (SELECT name FROM b_services WHERE id = service_id) AS service, * FROM per_id
            WHERE service_id IN (SELECT id FROM b_services))
SELECT service, CAST(SUM(n) AS BIGINT) AS washes_count, {_sum('r', 'revenue')}, {_sum('c', 'commission')}, {_sum('p', 'profit')}
FROM named GROUP BY service"""))
def q_a5(spark, d):
    return R.by_service(B.sales(spark, d), B.services(spark, d), **FULL).orderBy("service")


@register("a6_by_staff", W(["b_sales", "b_staff"], f"""
, per_id AS (SELECT staff_id, COUNT(*) AS n, SUM(commission_amount) AS c FROM b_sales WHERE {_rng('washed_at')} GROUP BY staff_id)
SELECT (SELECT name FROM b_staff WHERE id = staff_id) AS staff_name, CAST(SUM(n) AS BIGINT) AS washes_count, {_sum('c', 'commission_to_pay')}
FROM per_id WHERE staff_id IN (SELECT id FROM b_staff) GROUP BY 1"""))
def q_a6(spark, d):
    return R.by_staff(B.sales(spark, d), B.staff(spark, d), **FULL).orderBy("staff_name")


@register("a7_expense_total", W(["b_expenses"], f"SELECT {_sum('amount', 'total_expenses')} FROM b_expenses "
                                f"WHERE {_rng('spent_at')}"))
def q_a7(spark, d):
    return R.expense_total(B.expenses(spark, d), **FULL)


@register("a8_pnl_totals", W(["b_sales", "b_expenses"], f"""
{_moves()}
SELECT {_AMOUNTS}, {_NET} AS net_income FROM moves"""))
def q_a8(spark, d):
    return R.pnl_totals(B.sales(spark, d), B.expenses(spark, d), **FULL)


PNL_DAILY_SQL = W(["b_sales", "b_expenses"], f"""
{_moves()}
SELECT day, {_AMOUNTS}, {_NET} AS net FROM moves GROUP BY day""")


@register("a9_pnl_daily", PNL_DAILY_SQL)
def q_a9(spark, d):
    return R.pnl_daily(B.sales(spark, d), B.expenses(spark, d), **FULL).orderBy("day")


def _dod_sql():
    t, y = f"TIMESTAMP '{DAY}'", f"TIMESTAMP '{DAY}' - INTERVAL 1 DAY"
    def both(col, alias):
        return (f"CAST(COALESCE(SUM(CASE WHEN _t THEN {col} END), 0) AS DECIMAL(22,2)) AS t_{alias}, "
                f"CAST(COALESCE(SUM(CASE WHEN NOT _t THEN {col} END), 0) AS DECIMAL(22,2)) AS y_{alias}")
    return W(["b_sales", "b_expenses"], f"""
, s AS (SELECT *, washed_at >= {t} AS _t FROM b_sales WHERE washed_at >= {y} AND washed_at < {t} + INTERVAL 1 DAY),
  e AS (SELECT *, spent_at >= {t} AS _t FROM b_expenses WHERE spent_at >= {y} AND spent_at < {t} + INTERVAL 1 DAY),
  w AS (SELECT COUNT(CASE WHEN _t THEN 1 END) AS t_wash_count, COUNT(CASE WHEN NOT _t THEN 1 END) AS y_wash_count,
               {both('unit_price', 'revenue')}, {both('commission_amount', 'commission')},
               {both('profit_amount', 'profit')} FROM s),
  x AS (SELECT {both('amount', 'expenses')} FROM e),
  o AS (SELECT w.*, x.*, CAST(w.t_profit - x.t_expenses AS DECIMAL(22,2)) AS t_net_income,
               CAST(w.y_profit - x.y_expenses AS DECIMAL(22,2)) AS y_net_income FROM w CROSS JOIN x)
SELECT DATE '{DAY}' AS date, o.*,
       CASE WHEN CAST(y_net_income AS DOUBLE) <> 0 THEN
            ROUND((CAST(t_net_income AS DOUBLE) - CAST(y_net_income AS DOUBLE)) / ABS(CAST(y_net_income AS DOUBLE)) * 100, 4)
       END AS delta_pct
FROM o""")


@register("a10_day_over_day", _dod_sql())
def q_a10(spark, d):
    return R.day_over_day(B.sales(spark, d), B.expenses(spark, d), DAY)


# every movement counts as today's on its own day and as yesterday's on the next; days without a movement of their own fall out
_TWO_DAYS = """
, moved AS (SELECT CAST(washed_at AS DATE) AS d, 1 AS n, unit_price AS r, commission_amount AS c, profit_amount AS p, 0 AS x FROM b_sales
            UNION ALL SELECT CAST(spent_at AS DATE), 0, 0, 0, 0, amount FROM b_expenses),
  seen AS (SELECT d AS day, 't' AS side, n, r, c, p, x FROM moved
           UNION ALL SELECT d + 1, 'y', n, r, c, p, x FROM moved),
  both_days AS (SELECT day, {}
                FROM seen GROUP BY day HAVING bool_or(side = 't'))
SELECT *, CASE WHEN y_net_income <> 0
          THEN ROUND((CAST(t_net_income AS DOUBLE) - CAST(y_net_income AS DOUBLE)) / CAST(abs(y_net_income) AS DOUBLE) * 100, 4) END AS delta_pct
FROM both_days""".format(",\n                       ".join(
    (f"CAST(COALESCE(SUM({v}) FILTER (side = '{k}'), 0) AS {t}) AS {k}_{name}")
    for k in "ty" for v, name, t in (("n", "wash_count", "BIGINT"), *((v, name, "DECIMAL(22,2)") for v, name in (
        ("r", "revenue"), ("c", "commission"), ("p", "profit"), ("x", "expenses"), ("p - x", "net_income"))))))


@register("a10_day_over_day_series", W(["b_sales", "b_expenses"], _TWO_DAYS))
def q_a10s(spark, d):
    return R.day_over_day_series(B.sales(spark, d), B.expenses(spark, d))


@register("a16_free_per_day", W(["b_sales"], "SELECT CAST(washed_at AS DATE) AS day, COUNT(*) AS free_count "
                                "FROM b_sales WHERE is_free GROUP BY 1"))
def q_a16(spark, d):
    return R.free_per_day(B.sales(spark, d))


@register("a17_visits_per_month", W(["b_washes"], "SELECT customer_id, CAST(date_trunc('month', washed_at) AS DATE) "
                                    "AS month, COUNT(*) AS visits FROM b_washes WHERE customer_id IS NOT NULL GROUP BY 1, 2"))
def q_a17(spark, d):
    return R.visits_per_month(B.washes(spark, d))


@register("a18_reward_use", W(["b_washes", "b_promos"], """
, w AS (SELECT w.*, p.code AS _code, coalesce(regexp_replace(upper(w.vehicle_reg), '[\\s-]', '', 'g'), '') AS _plate
        FROM b_washes w LEFT JOIN b_promos p ON p.id = w.promo_id)
SELECT _plate AS vehicle_reg, CAST(date_trunc('month', washed_at) AS DATE) AS month,
       COUNT(CASE WHEN is_free AND _code = 'FEATURED_VEHICLE' THEN 1 END) AS reward_uses,
       COUNT(CASE WHEN is_free AND _code = 'FEATURED_VEHICLE' THEN 1 END) > 0 AS reward_used
FROM w WHERE _plate <> '' GROUP BY 1, 2"""))
def q_a18(spark, d):
    return R.reward_use(B.washes(spark, d), B.promotions(spark))
