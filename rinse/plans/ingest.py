"""The write path for a batch of new sales (the survey's lifecycle E2).

validate -> fill prices -> resolve customers -> promotion cascade ->
commission -> receipt numbers -> day-partitioned snapshot.

The original runs these steps once per request, with 5 to 15 round trips
and no transaction.  Here one job applies them to a whole batch; ordering
questions (loyalty count, daily cap, first draw match) are answered by the
cascade's ranks in arrival order, so no two sales can race.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinse.config import PromoSettings
from rinse.operators import joins as J
from rinse.operators import maintenance as M
from rinse.operators import promotions as PR
from rinse.operators import quality as Q
from rinse.operators.commissions import book_commission
from rinse.sources import batches

SALE_COLS = ["id", "service_id", "car_type_id", "staff_id", "customer_id", "vehicle_reg", "unit_price",
             "commission_pct", "commission_amount", "profit_amount", "is_free", "promo_code",
             "receipt_no", "washed_at"]


CUSTOMER_COLS = ["id", "name", "phone", "vehicle_reg"]


def current_customers(spark: SparkSession, customers: DataFrame, path: str) -> DataFrame:
    """``customers`` as they are after all batches published in the customer table at ``path``."""
    schema = customers.select(*CUSTOMER_COLS).schema.add("as_of", T.LongType())
    rows = batches.read_batches(spark, path, schema).unionByName(customers.select(*CUSTOMER_COLS, F.lit(-1).cast("bigint").alias("as_of")))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*CUSTOMER_COLS), "as_of").alias("c"))
    return last.select("c.*")


def _publish_customers(before: DataFrame, after: DataFrame, path: str, batch: int) -> None:
    """The rows that a batch has added or changed, as batch ``batch`` of the customer table."""
    old = before.select(F.col("id").alias("_id"), F.struct(*CUSTOMER_COLS).alias("_old"))
    changed = (after.join(old, F.col("id") == F.col("_id"), "left").filter(~F.struct(*CUSTOMER_COLS).eqNullSafe(F.col("_old")))
               .select(*CUSTOMER_COLS, F.lit(batch).cast("bigint").alias("as_of")))
    batches.write_batch(changed, path, batch, part=None)


def ingest_sales(new_sales: DataFrame, prices: DataFrame, customers: DataFrame, winners: DataFrame,
                 featured: DataFrame, settings: PromoSettings = PromoSettings(),
                 snapshot_path: str | None = None, history: DataFrame | None = None, batch: int = 0,
                 customers_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (booked sales, rejected rows with reasons); publishes the booked sales
    as batch ``batch`` of the day-partitioned table at ``snapshot_path`` when it is
    given, beside the sales earlier batches booked on the same days.  A batch that
    is published already is not booked again.  New customers are numbered densely after the
    highest id; the batch's new and changed customers are published as batch ``batch`` of the
    table at ``customers_path``, and ``current_customers`` gives the next batch its customers.

    ``new_sales``: id, service_id, car_type_id, staff_id, unit_price (NULL = list
    price), commission_pct (NULL = default), washed_at, customer_name,
    customer_phone, vehicle_reg (as typed).  ``history``: the sales booked by
    earlier batches (the output of earlier calls); the cascade counts them and
    receipt numbers continue after theirs."""
    valid, invalid = Q.validate_washes(new_sales)
    priced, unpriced = J.fill_prices(valid, prices)
    contacts = priced.select(F.col("id").alias("contact_id"), F.col("customer_name").alias("name"),
                             F.col("customer_phone").alias("phone"), "vehicle_reg", "washed_at")
    resolved, after = M.resolve_in_order(customers.select(*CUSTOMER_COLS), contacts, ["washed_at", "contact_id"])
    sales = priced.join(resolved.select(F.col("contact_id").alias("id"), "customer_id"), "id", "left")
    promoted = PR.apply_promotions(sales, winners, featured, settings, history)
    booked = book_commission(promoted)
    numbered = Q.assign_receipts(booked.withColumn("receipt_no", F.lit(None).cast("string")),
                                 issued=history.select("receipt_no") if history is not None else None)
    out = numbered.select(*SALE_COLS)
    if snapshot_path:
        batches.write_batch(out.withColumn("day", F.to_date("washed_at")), snapshot_path, batch)
    if customers_path:
        _publish_customers(customers, after, customers_path, batch)
    rejects = (invalid.select("id", F.array_join("errors", "; ").alias("reason"))
               .unionByName(unpriced.select("id", "reason")))
    return out, rejects
