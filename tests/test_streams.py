"""Streams replayed from files equal their batch counterparts."""

from __future__ import annotations

import calendar
import datetime as dt

from rinse.operators import maintenance as M
from rinse.operators import promotions as PR
from rinse.session import shared_dir
from rinse.sources import bindings as B
from rinse.streaming import counters as S
from rinse.streaming import replay as RP
from tests.conftest import SMALL


def test_counters_stream_equals_batch(spark):
    src = B.washes(S.rocksdb_session(spark), SMALL).select("id", "customer_id", "washed_at")
    out = RP.replay(src, "washed_at", 4, "t-st1", "update", S.counters_stream)
    got = sorted(map(tuple, RP.latest(spark, out, ["customer_id"]).select("customer_id", "visits_count", "last_visit")
                     .collect()))
    want = sorted(map(tuple, M.customer_counters(src).select("customer_id", "visits_count", "last_visit").collect()))
    assert got == want and len(got) > 0


def test_loyalty_stream_equals_batch_ordinals(spark):
    src = B.visits(S.rocksdb_session(spark), SMALL).select("id", "customer_id", "washed_at")
    out = RP.replay(src, "washed_at", 3, "t-st2", "append", S.loyalty_stream)
    got = {r["id"]: r["ordinal"] for r in spark.read.schema(S.LOYALTY_OUT).parquet(out).collect()}
    batch = PR.loyalty_award(B.visits(spark, SMALL).selectExpr("*", "false AS draw_free", "false AS featured_free"))
    want = {r["id"]: r["month_ordinal"] for r in batch.filter("customer_id IS NOT NULL").collect()}
    assert got == want and len(got) > 0


def _sale(i, customer, day):
    return (i, customer, dt.datetime(2023, 1, 1) + dt.timedelta(days=day))


def _run(spark, batches, lateness, booked=None):
    """Results by id, and the number of state rows after each batch."""
    own = S.rocksdb_session(spark)
    source, out, ckpt = (shared_dir(own, f"t-expiry-{x}") for x in ("in", "out", "ckpt"))
    ddl, held = "id bigint, customer_id bigint, washed_at timestamp_ntz", []
    for rows in batches:
        own.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(own.createDataFrame([], ddl).schema).parquet(source)
        RP.run_available(own, S.loyalty_stream(stream, lateness=lateness, booked=booked), "append", out, ckpt)
        held.append(own.read.format("statestore").option("stateVarName", "seen").load(ckpt).count())
    return {r["id"]: r["ordinal"] for r in spark.read.schema(S.LOYALTY_OUT).parquet(out).collect()}, held


def test_months_expire_and_late_sales_up_to_the_watermark_count(spark):
    """Twenty-four months of three customers, a batch each; some sales come ten days late."""
    batches, want, n = [], {}, 0
    for k in range(24):
        first = sum(calendar.monthrange(2023 + m // 12, m % 12 + 1)[1] for m in range(k))
        rows = []
        for c in range(3):
            for j in range(4):
                n += 1
                rows.append(_sale(n, c, first + 20 + j))
                want[n] = j + 1
        if k:      # of the month before, ten days after its end at most
            n += 1
            rows.append(_sale(n, 1, first - 1))
            want[n] = 5
        batches.append(rows)
    got, held = _run(spark, batches, "40 days")
    assert got == want
    assert held[-1] <= 9 and max(held) <= 9       # three months of three customers, not 72 rows


def test_sales_beyond_the_watermark_are_left_out(spark):
    got, held = _run(spark, [[_sale(1, 7, 5)], [_sale(2, 7, 100)], [_sale(3, 7, 130)], [_sale(4, 7, 6), _sale(5, 7, 131)]], "2 days")
    assert got == {1: 1, 2: 1, 3: 1, 5: 2} and held[-1] <= 2


def test_a_stream_starts_from_booked_sales(spark):
    booked = spark.createDataFrame([(7, dt.datetime(2023, 1, 3)), (7, dt.datetime(2023, 1, 4)), (None, dt.datetime(2023, 1, 4))], "customer_id bigint, washed_at timestamp_ntz")
    got, _ = _run(spark, [[_sale(1, 7, 5)], [_sale(2, 7, 6), _sale(3, 8, 6)]], "5 days", booked)
    assert got == {1: 3, 2: 4, 3: 1}


def test_counters_are_read_from_the_state(spark):
    src = B.washes(S.rocksdb_session(spark), SMALL).select("id", "customer_id", "washed_at")
    ckpt, old = shared_dir(spark, "t-st1-state"), "washed_at < TIMESTAMP '1995-01-01'"
    RP.replay(src.filter(f"NOT {old}"), "washed_at", 2, "t-st1-state", "state", S.counters_stream, ckpt)
    cols = ["customer_id", "visits_count", "last_visit"]
    got = sorted(map(tuple, S.counters_now(spark, ckpt, B.washes(spark, SMALL).filter(old)).select(*cols).collect()))
    assert got == sorted(map(tuple, M.customer_counters(B.washes(spark, SMALL)).select(*cols).collect()))


def test_customers_share_calls_and_state(spark, monkeypatch):
    """Three hundred customers of one month: the state has a value per bucket, not one per customer, and every count is right."""
    monkeypatch.setattr(S, "BUCKETS", 4)
    batches = [[_sale(1000 * b + 3 * c + j, c, 2 * b + j) for c in range(300) for j in range(3 if c % 2 else b)] for b in range(3)]
    booked = spark.createDataFrame([(c, dt.datetime(2023, 1, 1)) for c in range(0, 300, 5)], "customer_id bigint, washed_at timestamp_ntz")
    got, held = _run(spark, batches, "5 days", booked)
    seen, want = {c: 1 for c in range(0, 300, 5)}, {}
    for rows in batches:
        for i, c, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = seen[c] = seen.get(c, 0) + 1
    assert got == want and max(held) <= 4

