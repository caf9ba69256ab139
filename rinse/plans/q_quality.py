"""Registered data-quality and scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import expr as X
from rinse.operators import quality as Q
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.registry import register
from rinse.sources import bindings as B

_PLATE = "coalesce(regexp_replace(upper({c}), '[\\s-]', '', 'g'), '')"


@register("q1_validate_washes", W(["b_visits"], f"""
, v AS (SELECT *, {_PLATE.format(c='vehicle_reg')} AS p FROM b_visits),
  e AS (SELECT list_filter([CASE WHEN service_id IS NULL THEN 'service_id is required.' END,
                            CASE WHEN staff_id IS NULL THEN 'staff_id is required.' END,
                            CASE WHEN car_type_id IS NULL THEN 'car_type is required.' END,
                            CASE WHEN p = '' THEN 'vehicle_reg is required.'
                                 WHEN NOT regexp_matches(p, '^[A-Z]{{3}}\\d{{3}}[A-Z]$')
                                 THEN 'vehicle_reg must match Kenyan format e.g. KDP547Z.' END], lambda x: x IS NOT NULL) AS errs
        FROM v)
SELECT message, COUNT(*) AS n FROM (
  SELECT unnest(CASE WHEN len(errs) = 0 THEN ['OK'] ELSE errs END) AS message FROM e) m
GROUP BY message"""))
def q_q1(spark, d):
    return Q.validation_counts(B.visits(spark, d))


@register("q2_check_rules", W(["b_washes"], """
SELECT COUNT(CASE WHEN NOT (unit_price >= 0) THEN 1 END) AS bad_price_nonneg,
       COUNT(CASE WHEN NOT (commission_pct >= 0 AND commission_pct <= 100) THEN 1 END) AS bad_pct_range,
       COUNT(CASE WHEN NOT (commission_amount + profit_amount = unit_price) THEN 1 END) AS bad_amounts_add_up,
       COUNT(CASE WHEN NOT (promo_id IN ('DAILY_DRAW', 'FEATURED_VEHICLE', 'LOYALTY_13TH', 'FREE_WASH')) THEN 1 END) AS bad_promo_known
FROM b_washes"""))
def q_q2(spark, d):
    return Q.check_rules(B.washes(spark, d), Q.wash_rules())


@register("q3_check_unique", W(["b_services"], """
SELECT lower(name) AS name, COUNT(*) AS n FROM b_services WHERE name IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1"""))
def q_q3(spark, d):
    return Q.check_unique(B.services(spark, d), ["name"], casefold=True)


def _clash_sql(index: str, table: str, key: list[str], where: str = "TRUE") -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    held = " AND ".join(f"{k} IS NOT NULL" for k in key)
    return (f"SELECT '{index}' AS index, CAST(to_json([{parts}]) AS VARCHAR) AS key, COUNT(*) AS n FROM {table} "
            f"WHERE {held} AND {where} GROUP BY {', '.join(key)} HAVING COUNT(*) > 1")


@register("q3_unique_indexes", W(["b_services", "b_prices", "b_rates", "b_customers", "b_candidates", "b_winners", "b_washes"], " UNION ALL ".join([
    _clash_sql("services_name", "b_services", ["name"]), _clash_sql("services_name_folded", "b_services", ["lower(name)"]),
    _clash_sql("prices_service_car_type", "b_prices", ["service_id", "car_type_id"]), _clash_sql("rates_role", "b_rates", ["role"]),
    _clash_sql("customers_phone", "b_customers", ["phone"]),
    _clash_sql("candidates_day_customer_plate", "b_candidates", ["draw_date", "customer_id", "vehicle_reg"]),
    _clash_sql("winners_approved_day", "b_winners", ["draw_date"], "status = 'APPROVED'"), _clash_sql("washes_id", "b_washes", ["id"])])))
def q_q3_all(spark, d):
    tables = {"services": B.services, "prices": B.prices, "rates": B.rates, "customers": B.customers, "candidates": B.candidates,
              "winners": B.winners, "washes": B.washes}
    return Q.all_clashes({name: f(spark, d) for name, f in tables.items()})


@register("q4_check_refs", W(["b_unpriced", "b_prices"], """
SELECT u.* FROM b_unpriced u
WHERE u.service_id IS NOT NULL AND u.car_type_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM b_prices p WHERE p.service_id = u.service_id AND p.car_type_id = u.car_type_id)"""))
def q_q4(spark, d):
    return Q.check_refs(B.unpriced_sales(spark, d), B.prices(spark, d),
                        ["service_id", "car_type_id"], ["service_id", "car_type_id"])


@register("q5_receipt_numbers", W(["b_visits"], """
SELECT id, concat('SH', strftime(CAST(washed_at AS DATE), '%Y%m%d'), '-',
                  CAST(ROW_NUMBER() OVER (PARTITION BY CAST(washed_at AS DATE) ORDER BY washed_at, id) AS VARCHAR)) AS receipt_no
FROM b_visits"""))
def q_q5(spark, d):
    return Q.assign_receipts(B.visits(spark, d)).select("id", "receipt_no")


# --- scalar expressions (2.9) ------------------------------------------------------------

@register("s_plate", W(["b_customers"], f"SELECT id, {_PLATE.format(c='vehicle_reg')} AS plate FROM b_customers"))
def q_s_plate(spark, d):
    return B.customers(spark, d).select("id", X.plate("vehicle_reg").alias("plate"))


@register("s_phone", W(["b_customers"], "SELECT id, coalesce(regexp_replace(phone, '\\D+', '', 'g'), '') AS digits "
                       "FROM b_customers"))
def q_s_phone(spark, d):
    return B.customers(spark, d).select("id", X.phone_digits("phone").alias("digits"))


@register("s_reg", W(["b_customers"], "SELECT id, upper(trim(vehicle_reg)) AS reg FROM b_customers"))
def q_s_reg(spark, d):
    return B.customers(spark, d).select("id", X.reg("vehicle_reg").alias("reg"))


@register("s_regkey", W(["b_candidates"], "SELECT id, COALESCE(NULLIF(UPPER(vehicle_reg), ''), '') AS regkey "
                        "FROM b_candidates"))
def q_s_regkey(spark, d):
    return B.candidates(spark, d).select("id", X.regkey("vehicle_reg").alias("regkey"))


@register("s_plate_valid", W(["b_customers"], f"""
SELECT id, regexp_matches({_PLATE.format(c='vehicle_reg')}, '^[A-Z]{{3}}\\d{{3}}[A-Z]$') AS valid,
       regexp_matches({_PLATE.format(c='vehicle_reg')}, '^K[A-Z]{{2}}\\d{{3}}[A-Z]$') AS valid_strict
FROM b_customers"""))
def q_s_plate_valid(spark, d):
    c = B.customers(spark, d)
    p = X.plate("vehicle_reg")
    return c.select("id", X.plate_valid(p).alias("valid"), X.plate_valid(p, strict=True).alias("valid_strict"))


@register("s_day_month", W(["b_visits"], "SELECT id, CAST(washed_at AS DATE) AS day, "
                           "CAST(date_trunc('month', washed_at) AS DATE) AS month FROM b_visits"))
def q_s_day_month(spark, d):
    return B.visits(spark, d).select("id", X.day("washed_at").alias("day"), X.month_start("washed_at").alias("month"))


@register("s_to_date", """
SELECT event_id AS id, COALESCE(CAST(try_strptime(s, '%Y-%m') AS DATE), DATE '2024-03-01') AS month
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not-a-month' ELSE substr(CAST(ts AS VARCHAR), 1, 7) END AS s
      FROM events) e""")
def q_s_to_date(spark, d):
    from rinse.sources.tables import read_table
    ev = read_table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", F.lit("not-a-month"))
         .otherwise(F.substring(F.col("ts").cast("string"), 1, 7)).alias("s"))
    return ev.select("id", X.to_month("s", "2024-03-15").alias("month"))


@register("s_to_char", W(["b_visits"], "SELECT id, strftime(washed_at, '%Y-%m-%d %H:%M') AS washed_at FROM b_visits"))
def q_s_to_char(spark, d):
    return B.visits(spark, d).select("id", X.to_char_minute("washed_at").alias("washed_at"))


@register("s_default", W(["b_customers"], "SELECT id, COALESCE(phone, 'unknown') AS phone FROM b_customers"))
def q_s_default(spark, d):
    return B.customers(spark, d).select("id", X.default("phone", "unknown").alias("phone"))


@register("s_price_case", W(["b_car_types"], """
SELECT id, label, CASE label WHEN 'Salon/Small' THEN 600 WHEN 'SUV' THEN 800 WHEN 'Van/Bus' THEN 1000
                             WHEN 'Truck' THEN 1500 ELSE 0 END AS price FROM b_car_types"""))
def q_s_price_case(spark, d):
    return B.car_types(spark, d).select("id", "label", X.price_case("label").alias("price"))


@register("s_pct", W(["b_visits"], """
SELECT customer_id, COUNT(*) AS n, COUNT(CASE WHEN service_id = 'purchase' THEN 1 END) AS n_purchase,
       CASE WHEN COUNT(*) <> 0 THEN ROUND(CAST(COUNT(CASE WHEN service_id = 'purchase' THEN 1 END) AS DOUBLE)
                                          / CAST(COUNT(*) AS DOUBLE) * 100, 1) ELSE 0.0 END AS purchase_pct
FROM b_visits GROUP BY customer_id"""))
def q_s_pct(spark, d):
    per = B.visits(spark, d).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("service_id") == "purchase", 1)).alias("n_purchase"))
    return per.withColumn("purchase_pct", X.pct_of("n_purchase", "n"))


@register("s_concat_note", W(["b_winners"], """
SELECT id, concat(COALESCE(note, ''), CASE WHEN status = 'REVOKED' THEN concat(chr(10), '[REVOCATION] ', 'audit') ELSE '' END) AS note
FROM b_winners"""))
def q_s_concat_note(spark, d):
    w = B.winners(spark, d)
    reason = F.when(F.col("status") == "REVOKED", F.lit("audit"))
    return w.select("id", X.concat_note("note", reason).alias("note"))
