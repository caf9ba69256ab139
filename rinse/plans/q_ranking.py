"""Registered ranking, eligibility and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.operators import rankings as K
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.registry import register
from rinse.sources import bindings as B

SEED = "rinse"
MONTH, DRAW_DATE, KEYWORD, MIN_WASHES = "1998-07", "1998-07-15", "gear", 2

# sales are counted per customer before anything is looked up
_VEHICLES = """
, visits AS (SELECT customer_id, {month} COUNT(*) AS n, MAX(washed_at) AS latest FROM (
               SELECT *, CAST(date_trunc('month', washed_at) AS DATE) AS month FROM b_washes) WHERE {where} GROUP BY ALL),
  plates AS (SELECT id, upper(trim(vehicle_reg)) AS plate, name, phone FROM b_customers WHERE vehicle_reg <> ''),
  agg AS (SELECT plate AS vehicle_reg, {month} MAX(name) AS customer_name, MAX(phone) AS customer_phone,
                 CAST(SUM(n) AS BIGINT) AS washes, MAX(latest) AS last_wash
          FROM plates, visits WHERE id = customer_id GROUP BY ALL)
"""


@register("a14_top_vehicles", W(["b_washes", "b_customers"], _VEHICLES.format(
    where=f"month = DATE '{MONTH}-01'", month="") + "SELECT * FROM agg ORDER BY washes DESC, last_wash DESC, vehicle_reg LIMIT 5"))
def q_a14(spark, d):
    return K.top_vehicles(B.washes(spark, d), B.customers(spark, d), MONTH, limit=5)


@register("a14_top_vehicles_by_month", W(["b_washes", "b_customers"], _VEHICLES.format(
    where="TRUE", month="month,") + """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY washes DESC, last_wash DESC, vehicle_reg) AS rank
               FROM agg) r WHERE rank <= 5"""))
def q_a14m(spark, d):
    return K.top_vehicles_by_month(B.washes(spark, d), B.customers(spark, d), limit=5)


# a customer's plate is the largest of those on the sales; the customer's own stands in on sales without one
_ELIG = """
, chosen AS (SELECT *, CAST(date_trunc('month', washed_at) AS DATE) AS month FROM b_washes
             WHERE service_id IN (SELECT id FROM b_services WHERE contains(lower(name), '{kw}'))),
  visits AS (SELECT customer_id, {month} COUNT(*) AS wash_count, MAX(washed_at) AS last_wash,
                    MAX(upper(trim(vehicle_reg))) AS seen, COUNT(*) > COUNT(vehicle_reg) AS unseen
             FROM chosen WHERE {where} GROUP BY ALL),
  agg AS (SELECT customer_id, {month}
                 CASE WHEN unseen THEN list_max([seen, upper(trim(vehicle_reg))]) ELSE seen END AS vehicle_reg,
                 phone AS customer_phone, name AS customer_name, wash_count, last_wash
          FROM visits LEFT JOIN b_customers ON id = customer_id)
"""


@register("a15_eligibles", W(["b_washes", "b_customers", "b_services"], _ELIG.format(
    kw=KEYWORD, month="", where=f"month = DATE '{MONTH}-01'")
    + f"""SELECT * FROM agg WHERE wash_count >= {MIN_WASHES}
ORDER BY wash_count DESC, last_wash DESC, customer_id ASC NULLS LAST LIMIT 50"""))
def q_a15(spark, d):
    return K.eligible_customers(B.washes(spark, d), B.customers(spark, d), B.services(spark, d),
                                date=DRAW_DATE, min_washes=MIN_WASHES, limit=50, keyword=KEYWORD)


ELIGIBLES_BY_MONTH_SQL = _ELIG.format(kw=KEYWORD, month="month,", where="TRUE") + f"""
, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY wash_count DESC, last_wash DESC,
                                          customer_id ASC NULLS LAST) AS rank
             FROM agg WHERE wash_count >= {MIN_WASHES})
"""


@register("a15_eligibles_named", W(["b_washes", "b_customers", "b_services"], _ELIG.format(
    kw=KEYWORD, month="month,", where="customer_id IS NOT NULL") + f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY wash_count DESC, last_wash DESC, customer_id) AS rank
FROM agg WHERE wash_count >= {MIN_WASHES} QUALIFY rank <= 200"""))
def q_a15n(spark, d):
    return K.eligibles_by_month(B.washes(spark, d), B.customers(spark, d), B.services(spark, d),
                                min_washes=MIN_WASHES, limit=200, keyword=KEYWORD, drop_anonymous=True)


@register("a15_eligibles_by_month", W(["b_washes", "b_customers", "b_services"],
                                      ELIGIBLES_BY_MONTH_SQL + "SELECT * FROM ranked WHERE rank <= 200"))
def q_a15m(spark, d):
    return K.eligibles_by_month(B.washes(spark, d), B.customers(spark, d), B.services(spark, d),
                                min_washes=MIN_WASHES, limit=200, keyword=KEYWORD)


@register("l1_topk", W(["b_washes"], """
SELECT customer_id, COUNT(*) AS washes, MAX(washed_at) AS last_wash FROM b_washes GROUP BY customer_id
ORDER BY washes DESC, last_wash DESC, customer_id LIMIT 50"""))
def q_l1(spark, d):
    per = B.washes(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("washes"),
                                                        F.max("washed_at").alias("last_wash"))
    return K.top_k(per, [F.col("washes").desc(), F.col("last_wash").desc(), F.col("customer_id").asc()],
                   50, default=5, lo=1, hi=50)


@register("l2_random_pick", W(["b_candidates"], f"""
SELECT draw_date, id, customer_id, vehicle_reg FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY draw_date ORDER BY k, id) AS rn
  FROM (SELECT *, md5(concat(COALESCE(CAST(id AS VARCHAR), ''), '|', CAST(draw_date AS VARCHAR), '|{SEED}')) AS k
        FROM b_candidates) c) r
WHERE rn = 1"""))
def q_l2(spark, d):
    pool = B.candidates(spark, d).select("draw_date", "id", "customer_id", "vehicle_reg")
    return K.draw_suggestion(pool, "draw_date", ["id"], SEED, carry=["id", "customer_id", "vehicle_reg"])


@register("l3_null_order", W(["b_car_types"], "SELECT * FROM b_car_types ORDER BY sort_order ASC NULLS LAST, label"))
def q_l3(spark, d):
    return K.ordered_car_types(B.car_types(spark, d))
