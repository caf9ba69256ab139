"""Registered streaming queries and the batch write path.

The streams replay the sales as a file stream in arrival order (one time
slice per micro-batch) and return the stream's final result; both results are
SQL-expressible, so both have an oracle.  The write path (``e2_ingest``) is
checked rows-only here and by invariants in ``tests/test_ingest.py``."""

from __future__ import annotations

from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.registry import register
from rinse.session import shared_dir
from rinse.sources import bindings as B
from rinse.streaming import counters as S
from rinse.streaming import replay as RP


@register("st1_counters_stream", W(["b_washes"], """
SELECT customer_id, COUNT(*) AS visits_count, MAX(washed_at) AS last_visit FROM b_washes
WHERE customer_id IS NOT NULL GROUP BY customer_id"""))
def q_st1(spark, d):
    src = B.washes(S.rocksdb_session(spark), d).select("id", "customer_id", "washed_at")
    out = RP.replay(src, "washed_at", 6, "st1", "update", S.counters_stream)
    return RP.latest(spark, out, ["customer_id"])


@register("st2_loyalty_stream", W(["b_visits"], """
SELECT id, customer_id, CAST(date_trunc('month', washed_at) AS DATE) AS month,
       ROW_NUMBER() OVER (PARTITION BY customer_id, date_trunc('month', washed_at) ORDER BY washed_at, id) AS ordinal,
       ROW_NUMBER() OVER (PARTITION BY customer_id, date_trunc('month', washed_at) ORDER BY washed_at, id) % 13 = 0 AS loyalty_hit
FROM b_visits WHERE customer_id IS NOT NULL"""))
def q_st2(spark, d):
    src = B.visits(S.rocksdb_session(spark), d).select("id", "customer_id", "washed_at")
    out = RP.replay(src, "washed_at", 5, "st2", "append", S.loyalty_stream)
    return spark.read.schema(S.LOYALTY_OUT).parquet(out)


_RESUMED_AT = "TIMESTAMP '2024-01-16'"


@register("st1_counters_resumed", W(["b_washes"], """
SELECT customer_id, COUNT(*) AS visits_count, MAX(washed_at) AS last_visit FROM b_washes
WHERE customer_id IS NOT NULL GROUP BY customer_id"""))
def q_st1_resumed(spark, d):
    """Sales up to 1995 booked before, the others as a stream; the result is read from the stream's state."""
    own = S.rocksdb_session(spark)
    src = B.washes(own, d).select("id", "customer_id", "washed_at")
    old = "washed_at < TIMESTAMP '1996-01-01'"
    ckpt = shared_dir(own, "st1-state")
    RP.replay(src.filter(f"NOT {old}"), "washed_at", 3, "st1-resumed", "state", S.counters_stream, ckpt)
    return S.counters_now(spark, ckpt, B.washes(spark, d).filter(old))


@register("st2_loyalty_resumed", W(["b_visits"], f"""
, n AS (SELECT id, customer_id, washed_at, CAST(date_trunc('month', washed_at) AS DATE) AS month,
               ROW_NUMBER() OVER (PARTITION BY customer_id, date_trunc('month', washed_at) ORDER BY washed_at, id) AS ordinal
        FROM b_visits WHERE customer_id IS NOT NULL)
SELECT id, customer_id, month, ordinal, ordinal % 13 = 0 AS loyalty_hit FROM n WHERE washed_at >= {_RESUMED_AT}"""))
def q_st2_resumed(spark, d):
    """The first half month booked before; the stream starts from its counts and lets months expire two days after their end."""
    src = B.visits(S.rocksdb_session(spark), d).select("id", "customer_id", "washed_at")
    booked = src.filter(f"washed_at < {_RESUMED_AT}")
    out = RP.replay(src.filter(f"washed_at >= {_RESUMED_AT}"), "washed_at", 3, "st2-resumed", "append",
                    lambda stream: S.loyalty_stream(stream, lateness="2 days", booked=booked))
    return spark.read.schema(S.LOYALTY_OUT).parquet(out)


@register("e2_ingest")
def q_e2(spark, d):
    """Rows-only check (cascade over resolved new customers has no compact SQL form);
    tests/test_ingest.py checks its invariants."""
    from rinse.config import PromoSettings
    from rinse.plans.ingest import ingest_sales
    out, _ = ingest_sales(B.new_sales(spark, d), B.sale_prices(spark, d), B.known_customers(spark, d),
                          B.winners(spark, d), B.featured(spark, d), PromoSettings())
    return out
