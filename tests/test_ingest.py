"""The batch write path keeps every input row (booked or rejected) and books consistently."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rinse.config import PromoSettings
from rinse.plans.ingest import current_customers, ingest_sales
from rinse.session import shared_dir
from rinse.sources import batches
from rinse.sources import bindings as B
from tests.conftest import SMALL
from tests.test_customers import replay


def booked_schema(booked):
    return booked.withColumn("day", F.to_date("washed_at")).schema


def test_ingest_invariants(spark):
    src = B.new_sales(spark, SMALL)
    path = shared_dir(spark, "t-ingest")
    out, rejects = ingest_sales(src, B.sale_prices(spark, SMALL), B.known_customers(spark, SMALL),
                                B.winners(spark, SMALL), B.featured(spark, SMALL), PromoSettings(), path)
    n_in, n_out, n_rej = src.count(), out.count(), rejects.count()
    assert n_out + n_rej == n_in and n_rej > 0 and n_out > 0
    assert out.select("receipt_no").distinct().count() == n_out
    assert out.filter("is_free AND unit_price <> 0").count() == 0
    assert out.filter(F.col("commission_amount") + F.col("profit_amount") != F.col("unit_price")).count() == 0
    assert out.filter("customer_id IS NULL").count() == 0
    high = B.known_customers(spark, SMALL).agg(F.max("id")).first()[0]
    new = sorted(r[0] for r in out.filter(F.col("customer_id") > high).select("customer_id").distinct().collect())
    assert new == list(range(high + 1, high + 1 + len(new)))
    assert batches.read_batches(spark, path, booked_schema(out)).count() == n_out


def test_ingest_second_batch_continues_history(spark):
    src = B.new_sales(spark, SMALL)
    first = src.filter("washed_at < TIMESTAMP '2024-01-15'")
    second = src.filter("washed_at >= TIMESTAMP '2024-01-15'")
    args = (B.sale_prices(spark, SMALL), B.known_customers(spark, SMALL), B.winners(spark, SMALL),
            B.featured(spark, SMALL), PromoSettings())
    h, _ = ingest_sales(first, *args)
    h = h.checkpoint()
    out, _ = ingest_sales(second, *args, history=h)
    both = out.select("receipt_no").unionByName(h.select("receipt_no"))
    assert both.distinct().count() == both.count() > 0
    one_pass, _ = ingest_sales(src, *args)
    want = {r["id"]: r["promo_code"] for r in one_pass.filter("washed_at >= TIMESTAMP '2024-01-15'").collect()}
    got = {r["id"]: r["promo_code"] for r in out.collect()}
    assert got == want


def test_a_second_batch_of_a_day_keeps_the_first(spark):
    src = B.new_sales(spark, SMALL)
    cut = "TIMESTAMP '2024-01-15 12:00:00'"
    path = shared_dir(spark, "t-two-batches")
    args = (B.sale_prices(spark, SMALL), B.known_customers(spark, SMALL), B.winners(spark, SMALL), B.featured(spark, SMALL), PromoSettings())
    h, _ = ingest_sales(src.filter(f"washed_at < {cut}"), *args, path, batch=0)
    schema = booked_schema(h)
    first = batches.read_batches(spark, path, schema).select("id").collect()
    late, _ = ingest_sales(src.filter(f"washed_at >= {cut}"), *args, path, history=h, batch=1)
    ingest_sales(src.filter(f"washed_at >= {cut}"), *args, path, history=h, batch=1)      # a retry books nothing twice
    ids = [r["id"] for r in batches.read_batches(spark, path, schema).select("id").collect()]
    assert len(ids) == len(set(ids)) == len(first) + late.count()
    assert {r["id"] for r in first} < set(ids)


def test_customers_of_two_batches_equal_one_replay(spark):
    """New customers are numbered on, plates change hands across batches, and a retried batch changes nothing."""
    src = B.new_sales(spark, SMALL).filter("washed_at < TIMESTAMP '2024-01-20'")
    src = src.withColumn("customer_phone", F.expr("CASE WHEN id % 3 = 0 THEN customer_phone WHEN id % 3 = 1 THEN concat('07-', id % 40) END"))
    known, path = B.known_customers(spark, SMALL), shared_dir(spark, "t-customers")
    rest = (B.winners(spark, SMALL), B.featured(spark, SMALL), PromoSettings())
    prices = B.sale_prices(spark, SMALL)
    first, second = (src.filter(f"washed_at {op} TIMESTAMP '2024-01-10'") for op in ("<", ">="))
    booked = []
    for number, part in enumerate((first, second, second)):
        out, _ = ingest_sales(part, prices, current_customers(spark, known, path) if number < 2 else at_second, *rest,
                              batch=min(number, 1), customers_path=path)
        if number < 2:
            booked.append(out.select("id", "customer_id", "washed_at").collect())
        if number == 0:
            at_second = current_customers(spark, known, path).checkpoint()
    ids = {r["id"]: r["customer_id"] for part in booked for r in part}
    rows = sorted(((r["washed_at"], r["id"], r) for r in src.collect() if r["id"] in ids), key=lambda x: x[:2])
    want, want_after = replay([(r["id"], r["name"], r["phone"], r["vehicle_reg"]) for r in known.collect()],
                              [(i, r["customer_name"], r["customer_phone"], re.sub(r"[\s-]", "", r["vehicle_reg"]).upper()) for _, i, r in rows])
    assert ids == {k: c for k, c, _ in want}
    after = current_customers(spark, known, path).collect()
    assert sorted(((r["id"], r["name"], r["phone"], r["vehicle_reg"]) for r in after), key=repr) == want_after
