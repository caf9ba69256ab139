"""Join operators (section 2.4 of the survey).

Dimension joins carry no broadcast hint: AQE measures the finished shuffle
stage of each side and turns a sort-merge join into a broadcast hash join
only when the side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
That runtime check is the size bound; above it the join stays sort-merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.sources.schemas import MONEY, TOTAL


def wash_detail(washes: DataFrame, services: DataFrame, car_types: DataFrame,
                staff: DataFrame) -> DataFrame:
    """j1: sales with service and car type labels (inner) and staff name (left)."""
    s = services.select(F.col("id").alias("_sid"), F.col("name").alias("service_name"))
    ct = car_types.select(F.col("id").alias("_ctid"), F.col("label").alias("car_type_label"))
    st = staff.select(F.col("id").alias("_stid"), F.col("name").alias("staff_name"))
    return (washes.join(s, washes["service_id"] == s["_sid"])
            .join(ct, washes["car_type_id"] == ct["_ctid"])
            .join(st, washes["staff_id"] == st["_stid"], "left")
            .drop("_sid", "_ctid", "_stid"))


def receipts(washes: DataFrame, services: DataFrame, car_types: DataFrame, staff: DataFrame,
             promos: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """j2: receipt rows; ``ids`` (one column ``id``) restricts to chosen sales by a semi join."""
    if ids is not None:
        washes = washes.join(ids.select("id"), "id", "left_semi")
    d = wash_detail(washes, services, car_types, staff)
    p = promos.select(F.col("id").alias("_pid"), F.col("name").alias("promo_name"))
    d = d.join(p, d["promo_id"] == p["_pid"], "left")
    return d.select("id", "unit_price", "commission_pct", "commission_amount", "profit_amount",
                    "is_free", "vehicle_reg", "promo_name",
                    X.to_char_minute("washed_at").alias("washed_at"),
                    "service_name", "car_type_label", "staff_name")


def left_join_in_period(staff: DataFrame, washes_in_period: DataFrame) -> DataFrame:
    """j5: every staff member, with the sales of the period (filter applied before the join).

    The sales are the left side of an inner join, where a staff member with very
    many sales can be split over tasks; staff without sales are added to it."""
    w = washes_in_period.withColumnRenamed("staff_id", "_w_staff")
    sold = w.join(staff, staff["id"] == w["_w_staff"])
    active = w.select("_w_staff").distinct()
    idle = staff.join(active, staff["id"] == active["_w_staff"], "left_anti")
    return sold.select(*staff.columns, *w.columns).unionByName(idle, allowMissingColumns=True)


def with_rate(df: DataFrame, rates: DataFrame, role_col: str = "role_label",
              default=C.DEFAULT_COMMISSION_PCT) -> DataFrame:
    """j6: look up the role's rate (case-sensitive); missing -> default."""
    r = rates.select(F.col("role").alias("_role"), F.col("percentage").alias("_pct"))
    out = df.join(r, df[role_col] == r["_role"], "left")
    return out.withColumn("rate_pct", F.coalesce(F.col("_pct"), F.lit(default)).cast("decimal(5,2)")) \
        .drop("_role", "_pct")


def align_daily(left: DataFrame, right: DataFrame, key: str = "day") -> DataFrame:
    """j7: full outer join of two daily series; a missing side's measures become 0.

    Both inputs are aggregated by ``key``, so both are already hash-partitioned
    on it and the join adds no exchange.
    """
    j = left.join(right, key, "full_outer")
    measures = [c for c in left.columns + right.columns if c != key]
    return j.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast(TOTAL).alias(c) for c in measures])


def cross_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """j8: two one-row aggregates side by side (a 1 x 1 product)."""
    return a.crossJoin(b)


def candidates_with_winner(cands: DataFrame, winners: DataFrame) -> DataFrame:
    """j9: candidates plus winner id and flag; customer matched null-safe, plate by regkey."""
    w = winners.select(F.col("id").alias("winner_id"), F.col("draw_date").alias("_wd"),
                       F.col("customer_id").alias("_wc"), X.regkey("vehicle_reg").alias("_wr"))
    c = cands.withColumn("_cr", X.regkey("vehicle_reg"))
    cond = ((c["draw_date"] == w["_wd"]) & c["customer_id"].eqNullSafe(w["_wc"]) & (c["_cr"] == w["_wr"]))
    return (c.join(w, cond, "left")
            .withColumn("is_approved_winner", F.col("_wd").isNotNull())
            .drop("_wd", "_wc", "_wr", "_cr"))


def price_matrix(services: DataFrame, car_types: DataFrame, prices: DataFrame) -> DataFrame:
    """j11 (flat): every service x car type with its price, missing -> 0.

    The product of the two dimensions is the definition of the result; no hint
    is given, so the planner broadcasts a side only if its size allows it.
    """
    ct = car_types.select(F.col("id").alias("car_type_id"), F.col("label").alias("car_type_label"), F.col("sort_order"))
    grid = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name")) \
        .crossJoin(ct)
    p = prices.select("service_id", "car_type_id", "price")
    return (grid.join(p, ["service_id", "car_type_id"], "left")
            .withColumn("price", F.coalesce(F.col("price"), F.lit(0)).cast(MONEY)))


def price_matrix_nested(services: DataFrame, car_types: DataFrame, prices: DataFrame) -> DataFrame:
    """j11 (nested): one row per service with an array of prices ordered by sort_order."""
    flat = price_matrix(services, car_types, prices)
    item = F.struct(F.coalesce(F.col("sort_order"), F.lit(2**31 - 1)).alias("_o"),
                    F.col("car_type_label").alias("_l"), F.col("car_type_id"),
                    F.col("car_type_label"), F.col("price"))
    agg = flat.groupBy("service_id", "service_name").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    return agg.select("service_id", "service_name",
                      F.transform("_p", lambda s: F.struct(s["car_type_id"], s["car_type_label"], s["price"]))
                      .alias("prices"))


def catalog_flat(services: DataFrame, prices: DataFrame) -> DataFrame:
    """j11b (flat): each service with only its existing prices; none -> one row with NULL price."""
    s = services.select(F.col("id").alias("service_id"), "name",
                        F.coalesce(F.col("description"), F.lit("")).alias("description"))
    return s.join(prices.select("service_id", "car_type_id", "price"), "service_id", "left")


def catalog(services: DataFrame, prices: DataFrame) -> DataFrame:
    """j11b (nested): each service with an array of its prices; none -> empty array."""
    p = prices.groupBy("service_id").agg(
        F.sort_array(F.collect_list(F.struct("car_type_id", "price"))).alias("prices"))
    s = services.select(F.col("id").alias("service_id"), "name",
                        F.coalesce(F.col("description"), F.lit("")).alias("description"))
    out = s.join(p, "service_id", "left")
    return out.withColumn("prices", F.coalesce(F.col("prices"), F.array().cast(p.schema["prices"].dataType)))


def fill_prices(washes: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """j12: fill a missing unit price from (service, car type); absent pair -> rejected."""
    p = prices.select("service_id", "car_type_id", F.col("price").alias("_list_price"))
    j = washes.join(p, ["service_id", "car_type_id"], "left")
    filled = j.withColumn("unit_price", F.coalesce(F.col("unit_price"), F.col("_list_price")).cast(MONEY))
    ok = filled.filter(F.col("unit_price").isNotNull()).drop("_list_price")
    rejects = filled.filter(F.col("unit_price").isNull()).drop("_list_price", "unit_price") \
        .withColumn("reason", F.lit(C.MSG_NO_PRICE))
    return ok, rejects


def left_series(wash_daily: DataFrame, exp_daily: DataFrame, key: str = "day") -> DataFrame:
    """j13: add each day's expenses to the sales days only (expense-only days dropped)."""
    j = wash_daily.join(exp_daily, key, "left")
    return j.withColumn("expenses", F.coalesce(F.col("expenses"), F.lit(0)).cast(TOTAL))


def staff_with_stats(staff: DataFrame, stats: DataFrame) -> DataFrame:
    """j14: staff attributes plus period stats; staff without stats get 0."""
    st = stats.withColumnRenamed("staff_id", "_sid")
    j = staff.join(st, staff["id"] == st["_sid"], "left").drop("_sid")
    return j.select(*staff.columns,
                    F.coalesce(F.col("washes"), F.lit(0)).cast("bigint").alias("washes_today"),
                    F.coalesce(F.col("commission"), F.lit(0)).cast("decimal(24,6)").alias("commission_today"))


def day_winner(winners: DataFrame, status: str | None = "APPROVED") -> DataFrame:
    """The usable winner of each draw date: wanted status, not yet used, lowest id."""
    w = winners
    if status is not None:
        w = w.filter(F.col("status") == status)
    if "used_at" in w.columns:
        w = w.filter(F.col("used_at").isNull())
    first = w.groupBy("draw_date").agg(
        F.min(F.struct("id", "customer_id", "customer_phone", "vehicle_reg")).alias("w"))
    return first.select("draw_date", F.col("w.id").alias("winner_id"),
                        F.col("w.customer_id").alias("winner_customer_id"),
                        F.col("w.customer_phone").alias("winner_phone"),
                        F.col("w.vehicle_reg").alias("winner_reg"))


def match_winner(washes: DataFrame, winners: DataFrame, status: str | None = "APPROVED") -> DataFrame:
    """j15: flag sales that match their day's winner by customer, phone digits or plate.

    Equi-join on the draw date (one winner row per date), then an OR of three
    null-safe comparisons on cleaned values; NULL or blank never matches.
    """
    dw = day_winner(winners, status)
    w = washes.withColumn("_day", X.day("washed_at"))
    j = w.join(dw, w["_day"] == dw["draw_date"], "left")
    by_customer = (F.col("customer_id").isNotNull() & F.col("winner_customer_id").isNotNull()
                   & (F.col("customer_id") == F.col("winner_customer_id")))
    p1, p2 = X.phone_digits("customer_phone"), X.phone_digits("winner_phone")
    by_phone = (p1 != "") & (p1 == p2)
    r1, r2 = X.plate("vehicle_reg"), X.plate("winner_reg")
    by_plate = (r1 != "") & (r1 == r2)
    matched = F.coalesce(by_customer | by_phone | by_plate, F.lit(False))
    return j.withColumn("matches_winner", matched).drop("_day", "draw_date", "winner_customer_id",
                                                         "winner_phone", "winner_reg")
