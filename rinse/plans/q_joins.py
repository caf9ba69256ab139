"""Registered join and commission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import periods as P
from rinse.operators import commissions as CM
from rinse.operators import joins as J
from rinse.operators import reports as R
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.q_reports import _sum
from rinse.plans.registry import register
from rinse.sources import bindings as B

AS_OF = "1998-07-01T09:30:00"          # commissions: last 30 x 24 h, no upper bound
AS_OF_SQL = "TIMESTAMP '1998-07-01 09:30:00' - INTERVAL 30 DAY"
SEED = "rinse"


@register("j1_wash_detail", W(["b_washes", "b_services", "b_car_types", "b_staff"], """
SELECT w.*, (SELECT name FROM b_services WHERE id = w.service_id) AS service_name,
       (SELECT label FROM b_car_types WHERE id = w.car_type_id) AS car_type_label,
       (SELECT name FROM b_staff WHERE id = w.staff_id) AS staff_name
FROM b_washes w
WHERE year(w.washed_at) BETWEEN 1997 AND 1999
  AND w.service_id IN (SELECT id FROM b_services) AND w.car_type_id IN (SELECT id FROM b_car_types)"""))
def q_j1(spark, d):
    w = P.open_range_filter(B.washes(spark, d), "washed_at", from_="1997-01-01", to="1999-12-31")
    return J.wash_detail(w, B.services(spark, d), B.car_types(spark, d), B.staff(spark, d)) \
        .orderBy(F.col("washed_at").desc(), "id")


@register("j2_receipts", W(["b_washes", "b_services", "b_car_types", "b_staff", "b_promos"], """
SELECT w.* EXCLUDE (service_id, car_type_id, staff_id, promo_id, washed_at),
       (SELECT name FROM b_promos WHERE id = promo_id) AS promo_name, strftime(washed_at, '%Y-%m-%d %H:%M') AS washed_at,
       (SELECT name FROM b_services WHERE id = service_id) AS service_name,
       (SELECT label FROM b_car_types WHERE id = car_type_id) AS car_type_label,
       (SELECT name FROM b_staff WHERE id = staff_id) AS staff_name
FROM (SELECT id, unit_price, commission_pct, commission_amount, profit_amount, is_free, vehicle_reg,
             service_id, car_type_id, staff_id, promo_id, washed_at FROM b_washes
      WHERE service_id IN (SELECT id FROM b_services) AND car_type_id IN (SELECT id FROM b_car_types)) w"""))
def q_j2(spark, d):
    return J.receipts(B.washes(spark, d), B.services(spark, d), B.car_types(spark, d),
                      B.staff(spark, d), B.promotions(spark))


@register("j5_outer_filtered", W(["b_staff", "b_sales"], f"""
SELECT s.id, s.name, s.role_label, w.service_id, w.unit_price, w.washed_at
FROM b_staff s LEFT JOIN b_sales w ON w.staff_id = s.id AND w.washed_at >= {AS_OF_SQL}"""))
def q_j5(spark, d):
    w = P.rolling_filter(B.sales(spark, d), "washed_at", "month", AS_OF)
    return J.left_join_in_period(B.staff(spark, d), w.select("staff_id", "service_id", "unit_price", "washed_at")) \
        .select("id", "name", "role_label", "service_id", "unit_price", "washed_at")


@register("j6_rate_default", W(["b_staff", "b_rates"], """
SELECT s.*, CAST(COALESCE(r.percentage, 30) AS DECIMAL(5,2)) AS rate_pct
FROM b_staff s LEFT JOIN b_rates r ON r.role = s.role_label"""))
def q_j6(spark, d):
    return J.with_rate(B.staff(spark, d), B.rates(spark, d))


@register("j7_full_outer_series", W(["b_sales", "b_expenses"], f"""
, moves AS (SELECT CAST(washed_at AS DATE) AS day, unit_price AS revenue, NULL AS expenses FROM b_sales
           UNION ALL SELECT CAST(spent_at AS DATE), NULL, amount FROM b_expenses)
SELECT day, {_sum('revenue', 'revenue')}, {_sum('expenses', 'expenses')} FROM moves GROUP BY day"""))
def q_j7(spark, d):
    from rinse.functions import expr as X
    from rinse.sources.schemas import TOTAL
    ws = B.sales(spark, d).groupBy(X.day("washed_at").alias("day")).agg(
        F.coalesce(F.sum("unit_price"), F.lit(0)).cast(TOTAL).alias("revenue"))
    es = R.expense_daily(B.expenses(spark, d))
    return J.align_daily(ws, es, "day")


@register("j8_totals_cross", W(["b_sales", "b_expenses"], f"""
SELECT * FROM (SELECT COUNT(*) AS wash_count, {_sum('unit_price', 'revenue')} FROM b_sales) w
CROSS JOIN (SELECT {_sum('amount', 'expenses')} FROM b_expenses) e"""))
def q_j8(spark, d):
    from rinse.sources.schemas import TOTAL
    w = B.sales(spark, d).agg(F.count(F.lit(1)).alias("wash_count"),
                              F.coalesce(F.sum("unit_price"), F.lit(0)).cast(TOTAL).alias("revenue"))
    e = B.expenses(spark, d).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("expenses"))
    return J.cross_totals(w, e)


@register("j9_candidate_flag", W(["b_candidates", "b_winners"], """
, booked AS (SELECT id AS winner_id, [CAST(draw_date AS VARCHAR), coalesce(CAST(customer_id AS VARCHAR), 'nobody'),
                                     upper(coalesce(vehicle_reg, ''))] AS k FROM b_winners),
  asked AS (SELECT *, [CAST(draw_date AS VARCHAR), coalesce(CAST(customer_id AS VARCHAR), 'nobody'),
                       upper(coalesce(vehicle_reg, ''))] AS k FROM b_candidates)
SELECT a.* EXCLUDE (k), (SELECT b.winner_id FROM booked b WHERE b.k = a.k) AS winner_id,
       a.k IN (SELECT k FROM booked) AS is_approved_winner
FROM asked a"""))
def q_j9(spark, d):
    return J.candidates_with_winner(B.candidates(spark, d), B.winners(spark, d))


@register("j11_price_matrix", W(["b_price_services", "b_price_car_types", "b_prices"], """
SELECT s.id AS service_id, s.name AS service_name, ct.id AS car_type_id, ct.label AS car_type_label,
       ct.sort_order, CAST(COALESCE(p.price, 0) AS DECIMAL(12,2)) AS price
FROM b_price_services s CROSS JOIN b_price_car_types ct
LEFT JOIN b_prices p ON p.service_id = s.id AND p.car_type_id = ct.id"""))
def q_j11(spark, d):
    return J.price_matrix(B.price_services(spark, d), B.price_car_types(spark, d), B.prices(spark, d))


@register("j11b_catalog", W(["b_price_services", "b_prices"], """
SELECT s.id AS service_id, s.name, COALESCE(s.description, '') AS description, p.car_type_id, p.price
FROM b_price_services s LEFT JOIN b_prices p ON p.service_id = s.id"""))
def q_j11b(spark, d):
    return J.catalog_flat(B.price_services(spark, d), B.prices(spark, d))


# the nested forms, with one row per entry of the list, so that order and grouping show
@register("j11_price_matrix_nested", W(["b_price_services", "b_price_car_types", "b_prices"], """
, cell AS (SELECT s.id AS service_id, s.name AS service_name, t.id AS car_type_id, t.label AS car_type_label, t.sort_order,
                  (SELECT max(price) FROM b_prices WHERE service_id = s.id AND car_type_id = t.id) AS listed
           FROM b_price_services s, b_price_car_types t)
SELECT service_id, service_name, count(*) OVER (PARTITION BY service_id, service_name) AS n_prices,
       row_number() OVER (PARTITION BY service_id, service_name
                          ORDER BY sort_order NULLS LAST, car_type_label NULLS FIRST, car_type_id) AS place,
       car_type_id, car_type_label, CAST(COALESCE(listed, 0) AS DECIMAL(12,2)) AS price
FROM cell"""))
def q_j11n(spark, d):
    nested = J.price_matrix_nested(B.price_services(spark, d), B.price_car_types(spark, d), B.prices(spark, d))
    return _unnested(nested, ["service_id", "service_name"], ["car_type_id", "car_type_label", "price"])


@register("j11b_catalog_nested", W(["b_price_services", "b_prices"], """
SELECT s.id AS service_id, s.name, COALESCE(s.description, '') AS description, count(p.service_id) OVER (PARTITION BY s.id) AS n_prices,
       CASE WHEN p.service_id IS NOT NULL THEN row_number() OVER (PARTITION BY s.id ORDER BY p.car_type_id) END AS place,
       p.car_type_id, p.price
FROM b_price_services s LEFT JOIN b_prices p ON p.service_id = s.id"""))
def q_j11bn(spark, d):
    return _unnested(J.catalog(B.price_services(spark, d), B.prices(spark, d)), ["service_id", "name", "description"], ["car_type_id", "price"])


def _unnested(nested, keys, fields):
    n = F.size("prices").cast("bigint").alias("n_prices")
    return (nested.select(*keys, n, F.posexplode_outer("prices").alias("_i", "_p"))
            .select(*keys, "n_prices", (F.col("_i") + 1).cast("bigint").alias("place"), *[F.col(f"_p.{f}").alias(f) for f in fields]))


_J12 = """
SELECT u.id, u.service_id, u.car_type_id, CAST(COALESCE(u.unit_price, p.price) AS DECIMAL(12,2)) AS unit_price,
       u.washed_at
FROM b_unpriced u LEFT JOIN b_prices p ON p.service_id = u.service_id AND p.car_type_id = u.car_type_id"""


@register("j12_price_lookup", W(["b_unpriced", "b_prices"], f", f AS ({_J12}) SELECT * FROM f WHERE unit_price IS NOT NULL"))
def q_j12(spark, d):
    ok, _ = J.fill_prices(B.unpriced_sales(spark, d), B.prices(spark, d))
    return ok.select("id", "service_id", "car_type_id", "unit_price", "washed_at")


@register("j12_price_rejects", W(["b_unpriced", "b_prices"], f""", f AS ({_J12})
SELECT id, service_id, car_type_id, washed_at, 'Price not configured for service & car type.' AS reason
FROM f WHERE unit_price IS NULL"""))
def q_j12r(spark, d):
    _, rej = J.fill_prices(B.unpriced_sales(spark, d), B.prices(spark, d))
    return rej.select("id", "service_id", "car_type_id", "washed_at", "reason")


@register("j13_series_lookup", W(["b_sales", "b_expenses"], f"""
, sold AS (SELECT CAST(washed_at AS DATE) AS day, {_sum('profit_amount', 'profit')} FROM b_sales GROUP BY ALL)
SELECT *, CAST(COALESCE((SELECT SUM(amount) FROM b_expenses WHERE CAST(spent_at AS DATE) = day), 0) AS DECIMAL(22,2)) AS expenses
FROM sold"""))
def q_j13(spark, d):
    from rinse.functions import expr as X
    from rinse.sources.schemas import TOTAL
    ws = B.sales(spark, d).groupBy(X.day("washed_at").alias("day")).agg(
        F.coalesce(F.sum("profit_amount"), F.lit(0)).cast(TOTAL).alias("profit"))
    return J.left_series(ws, R.expense_daily(B.expenses(spark, d)))


# what each sale of the period earned its staff member, and nothing earned once for everyone
@register("a13_staff_stats", W(["b_staff", "b_sales"], f"""
, earned AS (SELECT staff_id AS who, 1 AS sold, unit_price * 0.01 * COALESCE(commission_pct, 30) AS share
             FROM b_sales WHERE washed_at >= {AS_OF_SQL}
             UNION ALL SELECT id, 0, 0 FROM b_staff),
  sums AS (SELECT who, SUM(sold) AS sold, SUM(share) AS share FROM earned GROUP BY who)
SELECT b_staff.*, CAST(sold AS BIGINT) AS washes_today, CAST(share AS DECIMAL(24,6)) AS commission_today
FROM sums JOIN b_staff ON id = who"""))
def q_a13(spark, d):
    w = P.rolling_filter(B.sales(spark, d), "washed_at", "month", AS_OF)
    return CM.staff_stats(B.staff(spark, d), w).orderBy("name", "id")


@register("j14_staff_merge", W(["b_staff", "b_sales"], """
SELECT *, CAST((SELECT COUNT(*) FROM b_sales WHERE staff_id = b_staff.id AND is_free) AS BIGINT) AS washes_today,
       CAST(COALESCE((SELECT SUM(commission_amount) FROM b_sales WHERE staff_id = b_staff.id AND is_free), 0) AS DECIMAL(24,6)) AS commission_today
FROM b_staff"""))
def q_j14(spark, d):
    """Staff with the number and commission of their free sales; whoever had none gets 0."""
    free = (B.sales(spark, d).filter("is_free AND staff_id IS NOT NULL").groupBy("staff_id")
            .agg(F.count(F.lit(1)).alias("washes"), F.sum("commission_amount").alias("commission")))
    return J.staff_with_stats(B.staff(spark, d), free)


@register("j15_winner_match", W(["b_visits", "b_winners"], """
, dw AS (SELECT draw_date, id AS winner_id, customer_id AS wc, customer_phone AS wp, vehicle_reg AS wr
         FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY draw_date ORDER BY id) AS rn
               FROM b_winners WHERE status = 'APPROVED') x WHERE rn = 1)
SELECT v.*, dw.winner_id,
       COALESCE((v.customer_id IS NOT NULL AND dw.wc IS NOT NULL AND v.customer_id = dw.wc)
         OR (coalesce(regexp_replace(v.customer_phone, '\\D+', '', 'g'), '') <> ''
             AND coalesce(regexp_replace(v.customer_phone, '\\D+', '', 'g'), '') = coalesce(regexp_replace(dw.wp, '\\D+', '', 'g'), ''))
         OR (coalesce(regexp_replace(upper(v.vehicle_reg), '[\\s-]', '', 'g'), '') <> ''
             AND coalesce(regexp_replace(upper(v.vehicle_reg), '[\\s-]', '', 'g'), '') = coalesce(regexp_replace(upper(dw.wr), '[\\s-]', '', 'g'), '')),
         FALSE) AS matches_winner
FROM b_visits v LEFT JOIN dw ON CAST(v.washed_at AS DATE) = dw.draw_date"""))
def q_j15(spark, d):
    return J.match_winner(B.visits(spark, d), B.winners(spark, d))


# sales summed per staff member first, then each sum at the one rate of that member's role
_PAID = f"""
, done AS (SELECT staff_id, COUNT(*) AS n, SUM(unit_price) AS total FROM b_sales WHERE washed_at >= {AS_OF_SQL} GROUP BY staff_id),
  paid AS (SELECT id, name, role_label, COALESCE(n, 0) AS washes, COALESCE(total, 0) AS revenue,
                  ROUND(COALESCE(total, 0) * 0.01 * COALESCE((SELECT percentage FROM b_rates WHERE role = role_label), 30), 2) AS commission
           FROM b_staff LEFT JOIN done ON staff_id = id)"""


@register("a11_commission_by_role", W(["b_staff", "b_sales", "b_rates"], f"""
{_PAID}
SELECT id, name, role_label, washes, CAST(revenue AS DECIMAL(22,2)) AS revenue, CAST(commission AS DECIMAL(22,2)) AS commission FROM paid"""))
def q_a11(spark, d):
    w = P.rolling_filter(B.sales(spark, d), "washed_at", "month", AS_OF)
    return CM.commission_by_role(B.staff(spark, d), w, B.rates(spark, d)).orderBy("name", "id")


@register("a12_commission_totals", W(["b_staff", "b_sales", "b_rates"], f"""
{_PAID}
, t AS (SELECT CAST(COALESCE(SUM(washes), 0) AS BIGINT) AS total_washes,
               CAST(COALESCE(SUM(revenue), 0) AS DECIMAL(22,2)) AS total_revenue,
               CAST(COALESCE(SUM(commission), 0) AS DECIMAL(22,2)) AS total_commission FROM paid)
SELECT *, CAST(total_revenue - total_commission AS DECIMAL(22,2)) AS business_profit,
       CASE WHEN total_revenue <> 0 THEN ROUND(CAST(total_commission AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100, 1) ELSE 0.0 END AS commission_percent,
       CASE WHEN total_revenue <> 0 THEN ROUND(CAST(total_revenue - total_commission AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100, 1) ELSE 0.0 END AS profit_percent
FROM t"""))
def q_a12(spark, d):
    w = P.rolling_filter(B.sales(spark, d), "washed_at", "month", AS_OF)
    return CM.commission_totals(CM.commission_by_role(B.staff(spark, d), w, B.rates(spark, d)))


@register("w7_commission", W(["b_visits"], """
SELECT id, unit_price, CAST(COALESCE(commission_pct, 30) AS DECIMAL(5,2)) AS commission_pct,
       CAST(ROUND(unit_price * COALESCE(commission_pct, 30) * 0.01, 2) AS DECIMAL(12,2)) AS commission_amount,
       CAST(unit_price - CAST(ROUND(unit_price * COALESCE(commission_pct, 30) * 0.01, 2) AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS profit_amount
FROM b_visits"""))
def q_w7(spark, d):
    return CM.book_commission(B.visits(spark, d).select("id", "unit_price", "commission_pct")) \
        .select("id", "unit_price", "commission_pct", "commission_amount", "profit_amount")
