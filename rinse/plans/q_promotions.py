"""Registered promotion-cascade queries over the arrival-ordered visits.

The oracle is the textbook window formulation (ROW_NUMBER / running SUM per
group); the Spark side computes the same ranks with skew-safe helpers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.config import PromoSettings
from rinse.operators import promotions as PR
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.registry import register
from rinse.sources import bindings as B

S = PromoSettings()
_PLATE = "coalesce(regexp_replace(upper({c}), '[\\s-]', '', 'g'), '')"
_PHONE = "coalesce(regexp_replace({c}, '\\D+', '', 'g'), '')"

CASCADE_SQL = f"""
, v AS (SELECT *, CAST(washed_at AS DATE) AS _day, CAST(date_trunc('month', washed_at) AS DATE) AS _month,
               {_PLATE.format(c='vehicle_reg')} AS _plate FROM b_visits),
  dw AS (SELECT draw_date, id AS winner_id, customer_id AS wc, customer_phone AS wp, vehicle_reg AS wr
         FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY draw_date ORDER BY id) AS rn
               FROM b_winners WHERE status = 'APPROVED') x WHERE rn = 1),
  m AS (SELECT v.*, dw.winner_id,
               COALESCE((v.customer_id IS NOT NULL AND dw.wc IS NOT NULL AND v.customer_id = dw.wc)
                 OR ({_PHONE.format(c='v.customer_phone')} <> '' AND {_PHONE.format(c='v.customer_phone')} = {_PHONE.format(c='dw.wp')})
                 OR (v._plate <> '' AND v._plate = {_PLATE.format(c='dw.wr')}), FALSE) AS matches_winner
        FROM v LEFT JOIN dw ON v._day = dw.draw_date),
  s1 AS (SELECT *, matches_winner AND ROW_NUMBER() OVER (PARTITION BY winner_id, matches_winner
                                                          ORDER BY washed_at, id) = 1 AS draw_free FROM m),
  fk AS (SELECT DISTINCT {_PLATE.format(c='vehicle_reg')} AS fplate, month AS fmonth FROM b_featured),
  s2 AS (SELECT s1.*, (fk.fplate IS NOT NULL AND fk.fplate <> '' AND NOT draw_free) AS _feat_elig
         FROM s1 LEFT JOIN fk ON fk.fplate = s1._plate AND fk.fmonth = s1._month),
  s2b AS (SELECT *, _feat_elig AND ROW_NUMBER() OVER (PARTITION BY _plate, _month, _feat_elig
                                                      ORDER BY washed_at, id) = 1 AS featured_free FROM s2),
  s3 AS (SELECT *, CASE WHEN customer_id IS NOT NULL THEN
                     ROW_NUMBER() OVER (PARTITION BY customer_id, _month ORDER BY washed_at, id) END AS month_ordinal,
                   CASE WHEN customer_id IS NOT NULL THEN
                     ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY washed_at, id) - 1 END AS visits_before
         FROM s2b),
  s4 AS (SELECT *, COALESCE(month_ordinal % {13} = 0, FALSE) AND NOT draw_free AND NOT featured_free AS loyalty_free FROM s3),
  s5 AS (SELECT *, draw_free OR featured_free OR loyalty_free AS _already,
                customer_id IS NOT NULL AND visits_before >= {S.random_min_visits}
                AND CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '{S.seed}'), 1, 8)) AS UBIGINT) / 4294967296.0 < {S.random_prob}
                AND NOT (draw_free OR featured_free OR loyalty_free) AS _cand
         FROM s4),
  s6 AS (SELECT *, COALESCE(SUM(CASE WHEN _already OR _cand THEN 1 ELSE 0 END) OVER (
                     PARTITION BY _day ORDER BY washed_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before
         FROM s5),
  s7 AS (SELECT *, _cand AND _before < {S.random_daily_cap} AS random_free,
                CASE WHEN draw_free THEN 'DAILY_DRAW' WHEN featured_free THEN 'FEATURED_VEHICLE'
                     WHEN loyalty_free THEN 'LOYALTY_13TH' WHEN _cand AND _before < {S.random_daily_cap} THEN 'FREE_WASH' END AS promo_code
         FROM s6)
"""

_BINDS = ["b_visits", "b_winners", "b_featured"]


def _cascade(spark, d):
    return PR.apply_promotions(B.visits(spark, d), B.winners(spark, d), B.featured(spark, d), S)


@register("w1_draw_award", W(_BINDS, CASCADE_SQL + "SELECT id, winner_id, matches_winner, draw_free FROM s1"))
def q_w1(spark, d):
    return PR.draw_award(B.visits(spark, d), B.winners(spark, d), S) \
        .select("id", "winner_id", "matches_winner", "draw_free")


@register("w2_featured_award", W(_BINDS, CASCADE_SQL + "SELECT id, draw_free, featured_free FROM s2b"))
def q_w2(spark, d):
    s = PR.draw_award(B.visits(spark, d), B.winners(spark, d), S)
    return PR.featured_award(s, B.featured(spark, d), S).select("id", "draw_free", "featured_free")


@register("w3_loyalty_award", W(_BINDS, CASCADE_SQL + "SELECT id, month_ordinal, loyalty_free FROM s4"))
def q_w3(spark, d):
    s = PR.draw_award(B.visits(spark, d), B.winners(spark, d), S)
    s = PR.featured_award(s, B.featured(spark, d), S)
    return PR.loyalty_award(s).select("id", "month_ordinal", "loyalty_free")


@register("w4_visits_before", W(["b_visits"], """
SELECT id, CASE WHEN customer_id IS NOT NULL THEN
         ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY washed_at, id) - 1 END AS visits_before
FROM b_visits"""))
def q_w4(spark, d):
    return PR.visits_before(B.visits(spark, d)).select("id", "visits_before")


@register("w5_random_award", W(_BINDS, CASCADE_SQL + "SELECT id, visits_before, random_free FROM s7"))
def q_w5(spark, d):
    return _cascade(spark, d).select("id", "visits_before", "random_free")


@register("w6_cascade", W(_BINDS, CASCADE_SQL + """
SELECT id, customer_id, washed_at, promo_code,
       draw_free OR featured_free OR loyalty_free OR random_free AS is_free,
       CAST(CASE WHEN draw_free OR featured_free OR loyalty_free OR random_free THEN 0 ELSE unit_price END AS DECIMAL(12,2)) AS unit_price,
       CAST(CASE WHEN draw_free OR featured_free OR loyalty_free OR random_free THEN 0 ELSE commission_pct END AS DECIMAL(5,2)) AS commission_pct
FROM s7"""))
def q_w6(spark, d):
    return _cascade(spark, d).select("id", "customer_id", "washed_at", "promo_code", "is_free",
                                     "unit_price", "commission_pct")


@register("w6_free_per_day", W(_BINDS, CASCADE_SQL + """
SELECT _day AS day, promo_code, COUNT(*) AS n FROM s7 WHERE promo_code IS NOT NULL GROUP BY 1, 2"""))
def q_w6_counts(spark, d):
    from rinse.functions import expr as X
    c = _cascade(spark, d).filter(F.col("promo_code").isNotNull())
    return c.groupBy(X.day("washed_at").alias("day"), "promo_code").agg(F.count(F.lit(1)).alias("n"))
