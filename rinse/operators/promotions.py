"""The promotion cascade (section 2.6 of the survey), for a whole table of sales.

Creating one sale decides its promotion by reading the sales inserted before
it.  Over a table that is a question about ranks in arrival order, answered
with grouped minima and running sums instead of a loop:

1. draw     - the first sale of a draw day that matches the day's winner;
2. featured - the first remaining sale of a featured plate in its month
              (every one, when once-per-month is off);
3. loyalty  - every n-th sale of a customer in a month (ordinal counts all
              sales, free or not); granted even without a promotion row;
4. random   - known customer with enough earlier visits, a repeatable draw
              u < p, and fewer than ``cap`` free sales earlier that day.

Step 4's cap is exact in closed form: a candidate is granted iff the number
of earlier same-day sales that are free-by-steps-1-3 or candidates is below
the cap (below the cap every candidate is granted, so the two counts agree;
once the cap is reached nothing more is granted).

Arrival order is a total order: ``(washed_at, id)``.  Every rank is computed
with ``rinse.operators.ordered`` helpers, which split hot groups (one huge
customer, one busy day) across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.config import PromoSettings
from rinse.functions import expr as X
from rinse.operators import joins as J
from rinse.operators.ordered import first_per_group, ordinal, running_sum

ORDER = ["washed_at", "id"]


def _flag_ids(df: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Left-join a set of row ids (unique) as a boolean flag: a join on a unique key cannot skew."""
    marked = ids.select(F.col("id").alias("_flag_id")).withColumn(flag, F.lit(True))
    out = df.join(marked, df["id"] == marked["_flag_id"], "left").drop("_flag_id")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def draw_award(visits: DataFrame, winners: DataFrame, settings: PromoSettings = PromoSettings(),
               history: DataFrame | None = None) -> DataFrame:
    """w1: ``draw_free`` = first sale of the day matching the day's usable winner.

    A winner is used once ``used_at`` is set, or once ``history`` holds a draw
    award on its day."""
    if history is not None:
        done = (history.filter(F.col("promo_code") == C.PROMO_DAILY_DRAW)
                .select(X.day("washed_at").alias("draw_date")).distinct())
        winners = winners.join(done, "draw_date", "left_anti")
    m = J.match_winner(visits, winners, status=settings.winner_status)
    if C.PROMO_DAILY_DRAW not in settings.active_codes:
        return m.withColumn("draw_free", F.lit(False))
    firsts = first_per_group(m.filter(F.col("matches_winner")), ["winner_id"], ORDER, ["id"])
    return _flag_ids(m, firsts, "draw_free")


def featured_award(df: DataFrame, featured: DataFrame,
                   settings: PromoSettings = PromoSettings(), history: DataFrame | None = None) -> DataFrame:
    """w2: ``featured_free`` for sales of a plate featured in the sale's month.

    Plates are normalised on both sides.  With once-per-month, only the first
    such sale that is not already a draw award is free, and none if ``history``
    already holds a free featured sale of that plate and month."""
    keys = (featured.select(X.plate("vehicle_reg").alias("_fplate"), F.col("month").alias("_fmonth"))
            .filter(F.col("_fplate") != "").distinct())
    if history is not None and settings.featured_once_per_month:
        used = (history.filter(F.col("is_free") & (F.col("promo_code") == C.PROMO_FEATURED))
                .select(X.plate("vehicle_reg").alias("_fplate"), X.month_start("washed_at").alias("_fmonth")))
        keys = keys.join(used, ["_fplate", "_fmonth"], "left_anti")
    d = df.withColumn("_plate", X.plate("vehicle_reg")).withColumn("_month", X.month_start("washed_at"))
    j = d.join(keys, (d["_plate"] == keys["_fplate"]) & (d["_month"] == keys["_fmonth"]), "left")
    elig = F.col("_fplate").isNotNull() & ~F.col("draw_free")
    j = j.withColumn("_feat_elig", elig).drop("_fplate", "_fmonth")
    if C.PROMO_FEATURED not in settings.active_codes:
        return j.withColumn("featured_free", F.lit(False)).drop("_feat_elig")
    if not settings.featured_once_per_month:
        return j.withColumnRenamed("_feat_elig", "featured_free")
    firsts = first_per_group(j.filter(F.col("_feat_elig")), ["_plate", "_month"], ORDER, ["id"])
    return _flag_ids(j, firsts, "featured_free").drop("_feat_elig")


def _with_ordinal(df: DataFrame, group: list[str], out: str) -> DataFrame:
    """Ordinal inside ``group`` for sales of known customers; anonymous sales get NULL.

    Anonymous sales are one giant group that no customer rule uses, so they
    skip the ranking and are unioned back."""
    known = df.filter(F.col("customer_id").isNotNull())
    anon = df.filter(F.col("customer_id").isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return ordinal(known, group, ORDER, out).unionByName(anon)


def visits_before(df: DataFrame) -> DataFrame:
    """w4: lifetime sales of the customer before this one (NULL for anonymous sales)."""
    if "_life" not in df.columns:
        df = _with_ordinal(df, ["customer_id"], "_life")
    return df.withColumn("visits_before", F.col("_life") - 1).drop("_life")


def loyalty_award(df: DataFrame, n: int = C.LOYALTY_EVERY_N, history: DataFrame | None = None) -> DataFrame:
    """w3: ``loyalty_free`` for every n-th sale of a customer in a month, unless already free.

    A customer's sales of one month are a contiguous block of the customer's
    lifetime arrival order, so the month ordinal is the lifetime ordinal minus
    the month's first lifetime ordinal, plus one: one ranking pass serves both
    this step and ``visits_before`` (the lifetime ordinal is kept as ``_life``).
    With ``history`` (sales booked before this batch), its per-customer and
    per-customer-month counts are added as offsets."""
    if "_month" not in df.columns:
        df = df.withColumn("_month", X.month_start("washed_at"))
    o = _with_ordinal(df, ["customer_id"], "_life")
    first = (o.filter(F.col("_life").isNotNull()).groupBy("customer_id", "_month")
             .agg(F.min("_life").alias("_first")))
    o = o.join(first, ["customer_id", "_month"], "left")
    o = o.withColumn("month_ordinal", F.col("_life") - F.col("_first") + 1).drop("_first")
    if history is not None:
        h = history.filter(F.col("customer_id").isNotNull())
        life = h.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_hl"))
        month = h.groupBy("customer_id", X.month_start("washed_at").alias("_month")) \
            .agg(F.count(F.lit(1)).alias("_hm"))
        o = o.join(life, "customer_id", "left").join(month, ["customer_id", "_month"], "left")
        o = (o.withColumn("_life", F.col("_life") + F.coalesce(F.col("_hl"), F.lit(0)))
              .withColumn("month_ordinal", F.col("month_ordinal") + F.coalesce(F.col("_hm"), F.lit(0)))
              .drop("_hl", "_hm"))
    already = F.coalesce(F.col("draw_free"), F.lit(False)) | F.coalesce(F.col("featured_free"), F.lit(False))
    hit = F.col("month_ordinal").isNotNull() & (F.col("month_ordinal") % n == 0)
    return o.withColumn("loyalty_free", hit & ~already)


def random_award(df: DataFrame, settings: PromoSettings = PromoSettings(),
                 history: DataFrame | None = None) -> DataFrame:
    """w5: ``random_free`` by probability, minimum visits and the daily cap (0 = no cap).

    With ``history``, its free sales of the same day count against the cap."""
    already = F.col("draw_free") | F.col("featured_free") | F.col("loyalty_free")
    enabled = settings.random_enabled and C.PROMO_RANDOM in settings.active_codes
    u = X.draw_uniform("id", settings.seed)
    cand = (F.lit(enabled) & F.col("customer_id").isNotNull()
            & (F.col("visits_before") >= settings.random_min_visits)
            & (u < F.lit(float(settings.random_prob))) & ~already)
    d = df.withColumn("_cand", cand).withColumn("_counts", (already | F.col("_cand")).cast("bigint"))
    if settings.random_daily_cap and enabled:
        d = d.withColumn("_day", X.day("washed_at"))
        d = running_sum(d, ["_day"], ORDER, F.col("_counts"), "_upto")
        before = F.col("_upto") - F.col("_counts")
        if history is not None:
            hf = (history.filter(F.col("is_free")).groupBy(X.day("washed_at").alias("_day"))
                  .agg(F.count(F.lit(1)).alias("_hf")))
            d = d.join(hf, "_day", "left")
            before = before + F.coalesce(F.col("_hf"), F.lit(0))
        d = d.withColumn("random_free", F.col("_cand") & (before < settings.random_daily_cap)) \
             .drop("_day", "_upto", *(["_hf"] if history is not None else []))
    else:
        d = d.withColumn("random_free", F.col("_cand"))
    return d.drop("_cand", "_counts")


def apply_promotions(visits: DataFrame, winners: DataFrame, featured: DataFrame,
                     settings: PromoSettings = PromoSettings(), history: DataFrame | None = None) -> DataFrame:
    """w6: the full cascade.  Adds the four step flags, ``promo_code``, ``is_free``, and sets
    price and commission percent to 0 on free sales.

    ``history``: sales booked before this batch (customer_id, vehicle_reg,
    washed_at, is_free, promo_code), all arrived before the batch.  Their
    counts enter as offsets: visits of the customer and of the customer's
    month, featured rewards already used, free sales of the day, draw days
    already awarded (a winner may also carry ``used_at``)."""
    s = draw_award(visits, winners, settings, history)
    s = featured_award(s, featured, settings, history)
    s = loyalty_award(s, history=history)
    s = visits_before(s)
    s = random_award(s, settings, history)
    active = set(settings.active_codes)

    def code(c):
        return F.lit(c if c in active else None).cast("string")

    promo = (F.when(F.col("draw_free"), code(C.PROMO_DAILY_DRAW))
              .when(F.col("featured_free"), code(C.PROMO_FEATURED))
              .when(F.col("loyalty_free"), code(C.PROMO_LOYALTY))
              .when(F.col("random_free"), code(C.PROMO_RANDOM)))
    is_free = F.col("draw_free") | F.col("featured_free") | F.col("loyalty_free") | F.col("random_free")
    out = s.withColumn("promo_code", promo).withColumn("is_free", is_free)
    out = out.withColumn("unit_price", F.when(F.col("is_free"), F.lit(0)).otherwise(F.col("unit_price"))
                         .cast("decimal(12,2)"))
    if "commission_pct" in out.columns:
        out = out.withColumn("commission_pct", F.when(F.col("is_free"), F.lit(0))
                             .otherwise(F.col("commission_pct")).cast("decimal(5,2)"))
    return out.drop("_plate", "_month")
