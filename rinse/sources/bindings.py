"""Bindings: the business tables as views over the driver's parquet tables.

Each function only reshapes given rows into the schema an operator expects
(renames, casts, a few derived labels); no operator work happens here.  The
same definitions exist as DuckDB SQL in ``rinse.plans.bindings_sql`` so that both
sides of the correctness check start from identical inputs.  FIXTURES.md
documents every binding and why it looks the way it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.sources.schemas import MONEY, PCT, PRICE
from rinse.sources.tables import read_table

E = F.expr


def _money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales fact for money reports: one row per lineitem, no customer join."""
    li = read_table(spark, d, "lineitem")
    price = _money("l_extendedprice")
    commission = F.round(price * F.col("l_discount").cast(PCT), 2).cast(MONEY)
    return li.select(
        F.col("l_partkey").alias("service_id"),
        F.col("l_suppkey").alias("staff_id"),
        price.alias("unit_price"),
        (F.col("l_discount") * 100).cast(PCT).alias("commission_pct"),
        commission.alias("commission_amount"),
        (price - commission).cast(MONEY).alias("profit_amount"),
        (F.col("l_returnflag") == "R").alias("is_free"),
        F.col("l_shipdate").alias("washed_at"),
    )


def washes(spark: SparkSession, d: str) -> DataFrame:
    """Sales fact with customer, car type, promotion and plate (lineitem x orders)."""
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    price = _money("l_extendedprice")
    commission = F.round(price * F.col("l_discount").cast(PCT), 2).cast(MONEY)
    return j.select(
        E("concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))").alias("id"),
        F.col("l_partkey").alias("service_id"),
        F.col("o_orderpriority").alias("car_type_id"),
        F.col("l_suppkey").alias("staff_id"),
        F.col("o_custkey").alias("customer_id"),
        price.alias("unit_price"),
        (F.col("l_discount") * 100).cast(PCT).alias("commission_pct"),
        commission.alias("commission_amount"),
        (price - commission).cast(MONEY).alias("profit_amount"),
        (F.col("l_returnflag") == "R").alias("is_free"),
        E("case when l_returnflag = 'R' then case when l_linestatus = 'O' "
          "then 'FEATURED_VEHICLE' else 'FREE_WASH' end end").alias("promo_id"),
        E("concat('K', chr(cast(65 + o_custkey % 26 as int)), chr(cast(65 + o_custkey % 23 as int)), "
          "lpad(cast(o_custkey % 1000 as string), 3, '0'), 'A')").alias("vehicle_reg"),
        F.col("l_shipdate").alias("washed_at"),
    )


def expenses(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("category"),
        E("case when o_orderstatus = 'P' then null else concat('status ', o_orderstatus) end").alias("note"),
        _money("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("spent_at"),
        E("case when o_orderstatus = 'F' then null else concat('user-', cast(o_custkey % 50 as string)) end")
        .alias("created_by_user_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def services(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        E("case when p_size > 25 then null else concat(p_type, ' ', p_brand) end").alias("description"),
        F.col("p_retailprice").cast(PRICE).alias("base_price"),
    )


def car_types(spark: SparkSession, d: str) -> DataFrame:
    """Car types = the distinct order priorities, labelled like the seed car types."""
    o = read_table(spark, d, "orders").select("o_orderpriority").distinct()
    return o.select(
        F.col("o_orderpriority").alias("id"),
        E("case left(o_orderpriority, 1) when '1' then 'Salon/Small' when '2' then 'SUV' "
          "when '3' then 'Van/Bus' when '4' then 'Truck' else 'Motorbike' end").alias("label"),
        E("case when left(o_orderpriority, 1) = '2' then null else o_orderpriority end").alias("description"),
        E("case when left(o_orderpriority, 1) = '5' then null "
          "else cast(left(o_orderpriority, 1) as int) end").alias("sort_order"),
    )


def staff(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    r = read_table(spark, d, "region")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    F.col("r_name").alias("role_label")))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Commission rates for three of the five roles in use (others fall back to the default)."""
    roles = staff(spark, d).select(F.col("role_label").alias("role")).distinct()
    return (roles.filter(F.col("role").isin("AFRICA", "ASIA", "EUROPE"))
            .select("role", E("case role when 'AFRICA' then 30 when 'ASIA' then 20 else 10 end")
                    .cast(PCT).alias("percentage")))


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        E("case when c_custkey % 7 = 0 then null "
          "else concat('+254 ', lpad(cast(c_custkey % 1000 as string), 6, '0')) end").alias("phone"),
        E("case when c_custkey % 11 = 0 then '' else concat(' k', chr(cast(97 + c_custkey % 26 as int)), "
          "chr(cast(97 + c_custkey % 23 as int)), case when c_custkey % 3 = 0 then '-' else ' ' end, "
          "lpad(cast(c_custkey % 1000 as string), 3, '0'), case when c_custkey % 13 = 0 then '' else 'a' end, ' ') end")
        .alias("vehicle_reg"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Price matrix keyed (part type, brand); pairs without a small part are holes."""
    p = read_table(spark, d, "part")
    return (p.filter(F.col("p_size") <= 10)
            .groupBy(F.col("p_type").alias("service_id"), F.col("p_brand").alias("car_type_id"))
            .agg(F.min(F.col("p_retailprice").cast(MONEY)).alias("price")))


def price_services(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").select("p_type").distinct()
    return p.select(F.col("p_type").alias("id"), F.col("p_type").alias("name"),
                    E("case when p_type like 'S%' then null else lower(p_type) end").alias("description"))


def price_car_types(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").select("p_brand").distinct()
    return p.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("label"),
                    E("cast(substr(p_brand, 7) as int)").alias("sort_order"))


def unpriced_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales keyed like the price matrix; returns 'N' arrive without a price."""
    li = read_table(spark, d, "lineitem")
    p = read_table(spark, d, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        E("concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))").alias("id"),
        F.col("p_type").alias("service_id"),
        F.col("p_brand").alias("car_type_id"),
        E("case when l_returnflag = 'N' then null else cast(l_extendedprice as decimal(12,2)) end")
        .alias("unit_price"),
        F.col("l_shipdate").alias("washed_at"),
    )


def _plate_sql(u: str, sep: str, upper: bool) -> str:
    l1, l2 = f"chr(cast(97 + {u} % 26 as int))", f"chr(cast(97 + {u} % 23 as int))"
    suffix = f"case when {u} % 13 = 0 then '' else 'x' end"
    if upper:
        l1, l2, suffix = f"upper({l1})", f"upper({l2})", f"upper({suffix})"
    digits = f"lpad(cast({u} % 1000 as string), 3, '0')"
    return f"concat('k', {l1}, {l2}, '{sep}', {digits}, {suffix})" if not upper else \
        f"concat('K', {l1}, {l2}, '{sep}', {digits}, {suffix})"


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Arrival-ordered sales for the promotion cascade (events: unique id and ts)."""
    ev = read_table(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("washed_at"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("service_id"),
        E("case when event_type = 'error' then null else user_id % 20 end").alias("staff_id"),
        E("case when event_type = 'view' and user_id % 7 = 0 then null else 'STD' end").alias("car_type_id"),
        F.col("value").cast(MONEY).alias("unit_price"),
        E("cast(case when event_type = 'purchase' then null else (user_id % 4) * 10 end as decimal(5,2))")
        .alias("commission_pct"),
        E(_plate_sql("user_id", " ", False)).alias("vehicle_reg"),
        E("case when user_id % 4 = 0 then null else concat('(0712) ', lpad(cast(user_id as string), 6, '0')) end")
        .alias("customer_phone"),
    )


def featured(spark: SparkSession, d: str) -> DataFrame:
    """Featured plates per month: plates with a purchase of 100 or more that month."""
    ev = read_table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 100))
    return (ev.groupBy(E(_plate_sql("user_id", "-", False)).alias("vehicle_reg"),
                       F.trunc(F.to_date("ts"), "MM").alias("month"))
            .agg(F.min("event_id").alias("id"), F.min("ts").alias("created_at"))
            .select("id", "vehicle_reg", "month", "created_at"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events").filter(F.col("event_type") == "signup")
    return ev.select(
        F.col("event_id").alias("id"),
        F.to_date("ts").alias("draw_date"),
        E("case when user_id % 9 = 0 then null else user_id end").alias("customer_id"),
        E(f"case when user_id % 5 = 0 then '' when user_id % 5 = 1 then null "
          f"else {_plate_sql('user_id', '-', True)} end").alias("vehicle_reg"),
        E("case when user_id % 6 = 0 then null else concat('0712-', lpad(cast(user_id as string), 6, '0')) end")
        .alias("customer_phone"),
        E("concat('Member ', cast(user_id as string))").alias("customer_name"),
        F.col("ts").alias("created_at"),
    )


def winners(spark: SparkSession, d: str) -> DataFrame:
    """One winner per draw date: the first candidate of that date; status by day of month."""
    c = candidates(spark, d)
    first = c.groupBy("draw_date").agg(F.min("id").alias("id"))
    return c.join(first, ["draw_date", "id"]).select(
        "id", "draw_date", "customer_id",
        F.upper("vehicle_reg").alias("vehicle_reg"), "customer_phone", "customer_name",
        E("case when day(draw_date) % 4 = 0 then 'REVOKED' when day(draw_date) % 4 = 1 then 'PENDING' "
          "else 'APPROVED' end").alias("status"),
        "created_at",
        E("case when day(draw_date) % 4 in (2, 3) and day(draw_date) % 3 = 0 "
          "then created_at + interval 1 hour end").alias("approved_at"),
        E("case when day(draw_date) % 2 = 0 then 'picked at counter' end").alias("note"),
    )


def promotions(spark: SparkSession) -> DataFrame:
    """The promotion codes the cascade looks up (fixed configuration rows)."""
    rows = [("DAILY_DRAW", "Daily draw", True), ("FEATURED_VEHICLE", "Featured vehicle", True),
            ("LOYALTY_13TH", "Loyalty 13th", True), ("FREE_WASH", "Free wash", True)]
    return spark.createDataFrame(rows, "code string, name string, is_active boolean") \
        .select(F.col("code").alias("id"), "code", "name", "is_active")


# --- change batches for the maintenance operators ------------------------------

def price_changes(spark: SparkSession, d: str) -> DataFrame:
    """Price updates: mid-size parts re-price their (type, brand) pair; later part keys win."""
    p = read_table(spark, d, "part").filter((F.col("p_size") >= 11) & (F.col("p_size") <= 20))
    return p.select(F.col("p_type").alias("service_id"), F.col("p_brand").alias("car_type_id"),
                    F.col("p_retailprice").cast(MONEY).alias("price"), F.col("p_partkey").alias("seq"))


def featured_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests to feature a plate for a month: every purchase of 50 or more."""
    ev = read_table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 50))
    return ev.select(F.col("event_id").alias("id"), E(_plate_sql("user_id", "-", False)).alias("vehicle_reg"),
                     F.trunc(F.to_date("ts"), "MM").alias("month"), F.col("ts").alias("created_at"))


def expense_changes(spark: SparkSession, d: str) -> DataFrame:
    """Partial expense edits: NULL fields are 'not given'."""
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        E("case when o_orderstatus = 'O' then 'RECLASSIFIED' end").alias("category"),
        E("case when o_orderpriority = '1-URGENT' then cast(o_totalprice as decimal(12,2)) + 1 end").alias("amount"),
        E("case when o_orderstatus = 'F' then 'checked' end").alias("note"),
        F.col("o_orderdate").alias("seq"))


def visit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edits of sales: new price on purchases, new percent on clicks, new staff on views."""
    ev = read_table(spark, d, "events").filter(F.col("event_type").isin("purchase", "click", "view"))
    return ev.select(
        F.col("event_id").alias("id"),
        E("case when event_type = 'purchase' then cast(value as decimal(12,2)) + 5 end").alias("unit_price"),
        E("cast(case when event_type = 'click' then 15 end as decimal(5,2))").alias("commission_pct"),
        E("case when event_type = 'view' then 99 end").cast("bigint").alias("staff_id"),
        F.col("ts").alias("seq"))


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Incoming customer contacts (one per order): known or new phones, known plates, or nothing."""
    o = read_table(spark, d, "orders")
    plate = ("case when o_custkey % 11 = 0 then '' else concat(' k', chr(cast(97 + o_custkey % 26 as int)), "
             "chr(cast(97 + o_custkey % 23 as int)), case when o_custkey % 3 = 0 then '-' else ' ' end, "
             "lpad(cast(o_custkey % 1000 as string), 3, '0'), case when o_custkey % 13 = 0 then '' else 'a' end, ' ') end")
    return o.select(
        F.col("o_orderkey").alias("contact_id"),
        E("case when o_orderstatus = 'O' then null else concat('Walk-in ', cast(o_custkey as string)) end").alias("name"),
        E("case when o_orderpriority in ('1-URGENT', '2-HIGH') then concat('+254 ', lpad(cast(o_custkey % 1000 as string), 6, '0')) "
          "when o_orderpriority = '3-MEDIUM' then concat('+255 ', lpad(cast(o_custkey % 997 as string), 6, '0')) end")
        .alias("phone"),
        E(f"case when o_orderstatus = 'F' then {plate} end").alias("vehicle_reg"),
        F.col("o_orderdate").alias("seq"))


# --- inputs of the batch write path (E2) -----------------------------------------------

_VISIT_PHONE = "case when user_id % 4 = 0 then null else concat('(0712) ', lpad(cast(user_id as string), 6, '0')) end"


def new_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales as typed at the counter: views come without a price (list price applies)."""
    ev = read_table(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("service_id"),
        E("case when event_type = 'view' and user_id % 7 = 0 then null else 'STD' end").alias("car_type_id"),
        E("case when event_type = 'error' then null else user_id % 20 end").alias("staff_id"),
        E("case when event_type = 'view' then null else cast(value as decimal(12,2)) end").alias("unit_price"),
        E("cast(case when event_type = 'purchase' then null else (user_id % 4) * 10 end as decimal(5,2))")
        .alias("commission_pct"),
        F.col("ts").alias("washed_at"),
        E("concat('Member ', cast(user_id as string))").alias("customer_name"),
        E(_VISIT_PHONE).alias("customer_phone"),
        E(_plate_sql("user_id", " ", False)).alias("vehicle_reg"))


def sale_prices(spark: SparkSession, d: str) -> DataFrame:
    """List price per (service, car type): the lowest price paid for the service."""
    ev = read_table(spark, d, "events").filter(F.col("event_type") != "view")
    return (ev.groupBy(F.col("event_type").alias("service_id"))
            .agg(F.min(F.col("value").cast(MONEY)).alias("price"))
            .select("service_id", F.lit("STD").alias("car_type_id"), "price"))


def known_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers on file: everyone who signed up, with phone and clean plate."""
    ev = read_table(spark, d, "events").filter(F.col("event_type") == "signup")
    return ev.select(F.col("user_id").alias("id"), E("concat('Member ', cast(user_id as string))").alias("name"),
                     E(_VISIT_PHONE).alias("phone"),
                     F.upper(F.regexp_replace(E(_plate_sql("user_id", " ", False)), r"[\s-]", "")).alias("vehicle_reg")
                     ).distinct()
