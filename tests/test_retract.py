"""Counters kept up under inserts, patches and deletes against a recompute."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from rinse.operators import retract
from rinse.session import shared_dir

DDL = "id bigint, customer_id bigint, washed_at timestamp_ntz"
T0 = dt.datetime(2025, 1, 1)


def brute(rows):
    out = {}
    for _, c, t in rows:
        if c is not None and t is not None:
            n, last = out.get(c, (0, t))
            out[c] = (n + 1, max(last, t))
    return sorted((c, *v) for c, v in out.items())


def counters(df):
    return sorted((r["customer_id"], r["visits_count"], r["last_visit"]) for r in df.collect())


def stored(spark, df):
    path = shared_dir(spark, "t-retract")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("keep", [1, 3])
def test_ten_batches(spark, keep):
    """A customer with most of the sales, equal times, moves between customers, everything deleted at the end."""
    rng = random.Random(keep)
    sale = lambda: (rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([T0 + dt.timedelta(hours=rng.randrange(30))] * 9 + [None]))
    table = {i: sale() for i in range(120)}
    frame = lambda: spark.createDataFrame([(i, *v) for i, v in table.items()], DDL)
    before = frame()
    state = stored(spark, retract.counters_state(before, keep))
    assert counters(state) == brute([(i, *v) for i, v in table.items()])
    for batch in range(10):
        for i in rng.sample(sorted(table), min(len(table), 25)):
            if rng.random() < 0.6:
                del table[i]
            else:
                table[i] = (table[i][0] if rng.random() < 0.5 else sale()[0], sale()[1])
        for k in range(rng.choice((0, 12))):
            table[1000 * (batch + 1) + k] = sale()
        if batch == 9:
            table.clear()
        after = frame()
        state = stored(spark, retract.apply_changes(state, retract.changes_between(before, after), after, keep))
        assert counters(state) == brute([(i, *v) for i, v in table.items()]), batch
        before = after


def test_untouched_customers_keep_their_row(spark):
    before = spark.createDataFrame([(1, 1, T0), (2, 2, T0)], DDL)
    after = spark.createDataFrame([(1, 1, T0), (2, 2, T0), (3, 2, T0 - dt.timedelta(days=1))], DDL)
    state = retract.counters_state(before)
    changes = retract.changes_between(before, after)
    assert [tuple(r) for r in changes.collect()] == [(None, None, 2, T0 - dt.timedelta(days=1))]
    assert counters(retract.apply_changes(state, changes, after)) == [(1, 1, T0), (2, 2, T0)]


def test_taking_back_what_is_not_there_is_an_error(spark):
    state = retract.counters_state(spark.createDataFrame([(1, 1, T0)], DDL))
    changes = spark.createDataFrame([(1, T0 + dt.timedelta(days=1), None, None)], "old_customer_id bigint, old_washed_at timestamp_ntz, new_customer_id bigint, new_washed_at timestamp_ntz")
    with pytest.raises(Exception, match="not there"):
        retract.apply_changes(state, changes, spark.createDataFrame([], DDL)).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    state = retract.counters_state(none)
    assert counters(retract.apply_changes(state, retract.changes_between(none, none), none)) == []


def test_sales_are_read_again_only_where_needed(spark):
    """No customer has lost all recent visits, so the result's plan has no table of sales."""
    before = spark.createDataFrame([(i, i % 4, T0 + dt.timedelta(hours=i)) for i in range(40)], DDL)
    after = stored(spark, before.filter("id <> 39"))
    state = stored(spark, retract.counters_state(before, 3))
    now = retract.apply_changes(state, retract.changes_between(before, after), after, 3)
    assert counters(now) == brute([tuple(r) for r in after.collect()])
    folder = after.inputFiles()[0].rsplit("/", 1)[0]
    assert not [f for f in now.inputFiles() if f.startswith(folder)]


def test_m12_joins_the_sales_once(spark, monkeypatch):
    from rinse.plans import q_upkeep as U
    calls = []
    monkeypatch.setattr(U, "materialise", lambda df, name, f=U.materialise: calls.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or f(df, name))
    U.q_m12_kept_up(spark, "/root/testdata/sf0.001")
    assert [name for name, plan in calls if "lineitem" in plan or "l_orderkey" in plan] == ["sales"]
