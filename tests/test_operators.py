"""Edge cases and invariants of the report, maintenance, draw and quality operators."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from rinse.functions import expr as X
from rinse.functions import periods as P
from rinse.operators import commissions as CM
from rinse.operators import draw as D
from rinse.operators import joins as J
from rinse.operators import maintenance as M
from rinse.operators import quality as Q
from rinse.operators import rankings as K
from rinse.operators import reports as R

SALES = ("service_id long, staff_id long, unit_price decimal(12,2), commission_pct decimal(5,2), "
         "commission_amount decimal(12,2), profit_amount decimal(12,2), is_free boolean, washed_at timestamp_ntz")
EXP = "id long, category string, note string, amount decimal(12,2), spent_at timestamp_ntz"
T0 = dt.datetime(2025, 3, 10, 9, 0)


def _d(x):
    return Decimal(str(x))


def _sale(day_offset, price, pct=10, staff=1, service=1, free=False):
    c = (_d(price) * _d(pct) / 100).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return (service, staff, _d(price), _d(pct), c, _d(price) - c, free, T0 + dt.timedelta(days=day_offset))


# --- periods ---------------------------------------------------------------------------

def test_resolve_range_rules():
    assert P.resolve_range(month="2025-13") == (dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1))
    assert P.resolve_range(month="2025-00") == (dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1))
    assert P.resolve_range(month="2025-02", from_="2020-01-01") == (dt.datetime(2025, 2, 1), dt.datetime(2025, 3, 1))
    assert P.resolve_range(from_="2025-01-05", to="2025-01-07") == (dt.datetime(2025, 1, 5), dt.datetime(2025, 1, 8))
    assert P.resolve_range(from_="2025-01-05") == (dt.datetime(2025, 1, 5), dt.datetime(2025, 1, 6))
    # 'to' alone is ignored; a badly shaped date falls back to the day of as_of
    assert P.resolve_range(to="2025-01-07", as_of="2025-06-01") == (dt.datetime(2025, 6, 1), dt.datetime(2025, 6, 2))
    assert P.resolve_range(date="2025/01/07", as_of="2025-06-01") == (dt.datetime(2025, 6, 1), dt.datetime(2025, 6, 2))
    with pytest.raises(ValueError):
        P.resolve_range(from_="not a date")
    assert P.rolling_bounds("week", "2025-01-10T12:00:00") == (dt.datetime(2025, 1, 3, 12), None)
    assert P.month_bounds("bad", "2025-04-09") == (dt.datetime(2025, 4, 1), dt.datetime(2025, 5, 1))


def test_period_filter_is_pushed_to_parquet(spark):
    from rinse.sources import bindings as B
    df = P.month_filter(B.sales(spark, "/root/testdata/sf0.001"), "washed_at", "1998-07", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


# --- reports -----------------------------------------------------------------------------

def test_empty_period_gives_one_row_of_zeros(spark):
    s = spark.createDataFrame([_sale(0, 100)], SALES)
    e = spark.createDataFrame([], EXP)
    r = R.summary_totals(s, e, month="1990-01").collect()
    assert len(r) == 1 and r[0]["wash_count"] == 0 and r[0]["revenue"] == 0 and r[0]["net_income"] == 0


def test_pnl_daily_keeps_one_sided_days_and_sums_match_totals(spark):
    s = spark.createDataFrame([_sale(0, 100), _sale(0, 50, free=True), _sale(1, 80)], SALES)
    e = spark.createDataFrame([(1, "x", None, _d(30), T0 + dt.timedelta(days=1)),
                               (2, "x", None, _d(5), T0 + dt.timedelta(days=2))], EXP)
    daily = {r["day"]: r for r in R.pnl_daily(s, e, from_="2025-03-01", to="2025-03-31").collect()}
    assert len(daily) == 3 and daily[(T0 + dt.timedelta(days=2)).date()]["revenue"] == 0
    tot = R.pnl_totals(s, e, from_="2025-03-01", to="2025-03-31").first()
    assert sum(r["net"] for r in daily.values()) == tot["net_income"]
    series = R.summary_daily(s, e, from_="2025-03-01", to="2025-03-31").collect()
    assert {r["day"] for r in series} <= set(daily)          # sales days only
    assert sum(r["wash_count"] for r in series) == 3          # free sales are counted


def test_day_over_day_zero_yesterday_gives_null_delta(spark):
    s = spark.createDataFrame([_sale(0, 100)], SALES)
    e = spark.createDataFrame([], EXP)
    r = R.day_over_day(s, e, T0.date().isoformat()).first()
    assert r["t_wash_count"] == 1 and r["y_net_income"] == 0 and r["delta_pct"] is None


def test_three_commission_definitions_differ(spark):
    staff = spark.createDataFrame([(1, "Ann", "ASIA"), (2, "Bob", "MOON"), (3, "Cy", "ASIA")],
                                  "id long, name string, role_label string")
    rates = spark.createDataFrame([("ASIA", _d(20))], "role string, percentage decimal(5,2)")
    s = spark.createDataFrame([_sale(0, 10.05, pct=10, staff=1), _sale(0, 10.05, pct=10, staff=1),
                               _sale(0, 100, pct=50, staff=2)], SALES)
    booked = {r["staff_name"]: r["commission_to_pay"] for r in R.by_staff(s, staff, month="2025-03").collect()}
    by_role = {r["name"]: r for r in CM.commission_by_role(staff, s, rates).collect()}
    by_sale = {r["name"]: r["commission_today"] for r in CM.staff_stats(staff, s).collect()}
    assert booked == {"Ann": _d("2.02"), "Bob": _d("50.00")}
    assert by_role["Ann"]["commission"] == _d("4.02") and by_role["Bob"]["commission"] == _d("30.00")
    assert by_role["Cy"]["washes"] == 0 and by_role["Cy"]["revenue"] == 0
    assert by_sale["Ann"] == _d("2.01") and by_sale["Bob"] == _d("50") and by_sale["Cy"] == 0
    t = CM.commission_totals(CM.commission_by_role(staff, s.limit(0), rates)).first()
    assert t["commission_percent"] == 0 and t["profit_percent"] == 0


def test_same_named_services_merge(spark):
    svc = spark.createDataFrame([(1, "Wash"), (2, "Wash"), (3, "Wax")], "id long, name string")
    s = spark.createDataFrame([_sale(0, 10, service=1), _sale(0, 20, service=2), _sale(0, 5, service=3)], SALES)
    got = {r["service"]: r["washes_count"] for r in R.by_service(s, svc, month="2025-03").collect()}
    assert got == {"Wash": 2, "Wax": 1}


# --- rankings -----------------------------------------------------------------------------

def test_top_k_ties_are_stable_and_limits_clamp(spark):
    df = spark.createDataFrame([(i, 5, T0) for i in range(10)], "k long, n long, t timestamp_ntz")
    order = [F.col("n").desc(), F.col("t").desc(), F.col("k").asc()]
    assert [r["k"] for r in K.top_k(df.repartition(7), order, 3, 5, 1, 50).collect()] == [0, 1, 2]
    assert K.top_k(df, order, 500, 5, 1, 50).count() == 10
    assert K.top_k(df, order, "abc", 5, 1, 50).count() == 5
    assert K.top_k(df, order, 0, 5, 1, 50).count() == 1


def test_eligibles_group_anonymous_sales_together(spark):
    washes = spark.createDataFrame(
        [(None, 1, "kaa 001a", T0), (None, 1, None, T0), (7, 1, None, T0), (7, 1, None, T0)],
        "customer_id long, service_id long, vehicle_reg string, washed_at timestamp_ntz")
    cust = spark.createDataFrame([(7, "Al", "0700", " kbb 002b ")], "id long, name string, phone string, vehicle_reg string")
    svc = spark.createDataFrame([(1, "Full Wash")], "id long, name string")
    rows = {r["customer_id"]: r for r in K.eligible_customers(washes, cust, svc, "2025-03-10", min_washes=2).collect()}
    assert rows[None]["wash_count"] == 2 and rows[None]["vehicle_reg"] == "KAA 001A"
    assert rows[7]["vehicle_reg"] == "KBB 002B" and rows[7]["customer_phone"] == "0700"


def test_price_matrix_nested_and_catalog_empty(spark):
    svc = spark.createDataFrame([("A", "A", None), ("B", "B", "b")], "id string, name string, description string")
    ct = spark.createDataFrame([("x", "X", 2), ("y", "Y", None), ("z", "Z", 1)], "id string, label string, sort_order int")
    pr = spark.createDataFrame([("A", "x", _d(5))], "service_id string, car_type_id string, price decimal(12,2)")
    nested = {r["service_id"]: r["prices"] for r in J.price_matrix_nested(svc, ct, pr).collect()}
    assert [p["car_type_id"] for p in nested["A"]] == ["z", "x", "y"]
    assert [p["price"] for p in nested["A"]] == [0, 5, 0]
    cat = {r["service_id"]: r for r in J.catalog(svc, pr).collect()}
    assert cat["B"]["prices"] == [] and cat["A"]["description"] == "" and len(cat["A"]["prices"]) == 1


# --- maintenance ---------------------------------------------------------------------------

def test_upsert_is_idempotent_and_last_change_wins(spark):
    t = spark.createDataFrame([("s", "c", _d(1)), ("s", "d", _d(2))], "service_id string, car_type_id string, price decimal(12,2)")
    ch = spark.createDataFrame([("s", "c", _d(9), 1), ("s", "c", _d(7), 2), ("n", "c", _d(3), 1)],
                               "service_id string, car_type_id string, price decimal(12,2), seq long")
    once = M.upsert(t, ch, ["service_id", "car_type_id"], ["seq"])
    twice = M.upsert(once, ch, ["service_id", "car_type_id"], ["seq"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert ("s", "c", _d(7)) in a and ("n", "c", _d(3)) in a and ("s", "d", _d(2)) in a


def test_patch_takes_last_non_null_per_column(spark):
    t = spark.createDataFrame([(1, "a", "n0", _d(1))], "id long, category string, note string, amount decimal(12,2)")
    ch = spark.createDataFrame([(1, "b", None, None, 1), (1, None, "n2", None, 2), (9, "z", None, None, 1)],
                               "id long, category string, note string, amount decimal(12,2), seq long")
    r = M.patch(t, ch, "id", ["seq"]).collect()
    assert [tuple(x) for x in r] == [(1, "b", "n2", _d(1))]


def test_patch_washes_resets_percent_and_recomputes(spark):
    w = CM.book_commission(spark.createDataFrame([(1, 1, 2, _d(100), _d(10)), (2, 1, 2, _d(50), _d(10))],
                                                 "id long, service_id long, staff_id long, unit_price decimal(12,2), commission_pct decimal(5,2)"))
    ch = spark.createDataFrame([(1, _d(200), None, 1)], "id long, unit_price decimal(12,2), commission_pct decimal(5,2), seq long")
    got = {r["id"]: r for r in M.patch_washes(w, ch, ["seq"]).collect()}
    assert got[1]["commission_pct"] == 30 and got[1]["commission_amount"] == _d("60.00") and got[1]["profit_amount"] == _d("140.00")
    assert got[2]["commission_pct"] == 10 and got[2]["commission_amount"] == _d("5.00")


def test_delete_restrict_and_cascade(spark):
    svc = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    used = spark.createDataFrame([(1,)], "service_id long")
    prices = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "service_id long, price long")
    kept, refused, (pr,) = M.delete_keys(svc, spark.createDataFrame([(1,), (2,)], "id long"), "id",
                                         restrict=[(used, "service_id")], cascade=[(prices, "service_id")])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    assert [r["id"] for r in refused.collect()] == [1]
    assert sorted(r["service_id"] for r in pr.collect()) == [1, 3]


def test_insert_if_absent_keeps_existing(spark):
    t = spark.createDataFrame([(1, "A", dt.date(2025, 1, 1))], "id long, vehicle_reg string, month date")
    rows = spark.createDataFrame([(5, "A", dt.date(2025, 1, 1)), (7, "B", dt.date(2025, 1, 1)), (6, "B", dt.date(2025, 1, 1))],
                                 "id long, vehicle_reg string, month date")
    got = sorted(map(tuple, M.insert_if_absent(t, rows, ["vehicle_reg", "month"], ["id"]).collect()))
    assert got == [(1, "A", dt.date(2025, 1, 1)), (6, "B", dt.date(2025, 1, 1))]


def test_resolve_customers_rules(spark):
    cust = spark.createDataFrame([(3, "a", "071", "KAA1"), (2, "b", "071", None), (5, "c", None, "KBB2")],
                                 "id long, name string, phone string, vehicle_reg string")
    con = spark.createDataFrame([(1, "x", "071", "KBB2", 1), (2, "y", "099", "KBB2", 2), (3, "z", "", "NEW", 3),
                                 (4, None, None, None, 4), (5, None, "088", None, 5)],
                                "contact_id long, name string, phone string, vehicle_reg string, seq long")
    res = {r["contact_id"]: (r["customer_id"], r["match"], r["new_customer_key"])
           for r in M.resolve_customers(cust, con).collect()}
    assert res == {1: (2, "phone", None), 2: (5, "plate", None), 3: (None, "new", "plate NEW"),
                   4: (None, "none", None), 5: (None, "new", "phone 088")}
    chain = spark.createDataFrame([(1, "p9", "KBB111B"), (2, None, "KBB111B"), (3, "p9", "KCC222C"), (4, None, "KCC222C"), (5, "p8", None)],
                                  "contact_id long, phone string, vehicle_reg string").withColumn("name", F.lit(None).cast("string"))
    keys = {r["contact_id"]: r["new_customer_key"] for r in M.resolve_customers(cust, chain).collect()}
    assert keys == {1: "phone p9", 2: "phone p9", 3: "phone p9", 4: "phone p9", 5: "phone p8"}
    patched = {r["id"]: r for r in M.patch_matched_customers(cust, con, M.resolve_customers(cust, con),
                                                             ["seq", "contact_id"]).collect()}
    assert patched[2]["name"] == "x" and patched[2]["phone"] == "071" and patched[5]["name"] == "y"


# --- draw workflow ---------------------------------------------------------------------------

WCOLS = ("id long, draw_date date, customer_id long, vehicle_reg string, customer_phone string, "
         "customer_name string, status string, created_at timestamp_ntz, approved_at timestamp_ntz, note string")
CCOLS = ("id long, draw_date date, customer_id long, vehicle_reg string, customer_phone string, "
         "customer_name string, created_at timestamp_ntz")
D1, D2 = dt.date(2025, 1, 1), dt.date(2025, 1, 2)


def test_approve_conflicts(spark):
    cands = spark.createDataFrame([(1, D1, 1, "A", None, None, T0), (2, D2, 2, "B", None, None, T0),
                                   (3, D2, 3, "C", None, None, T0)], CCOLS)
    winners = spark.createDataFrame([(9, D1, 9, "Z", None, None, "APPROVED", T0, T0, None)], WCOLS)
    req = spark.createDataFrame([(10, 1, None, 1), (11, 3, None, 3), (12, 2, None, 2), (13, 77, None, 4)],
                                "request_id long, candidate_id long, draw_date date, seq long")
    after, refused = D.approve(cands, winners, req, "2025-01-03 00:00:00")
    assert sorted(r["id"] for r in after.collect()) == [2, 9]
    reasons = {r["request_id"]: r["reason"] for r in refused.collect()}
    assert reasons[10].startswith("an approved") and reasons[11].startswith("date already") \
        and reasons[13] == "candidate not found"
    assert after.filter("status = 'APPROVED'").groupBy("draw_date").count().filter("count > 1").count() == 0


def test_reschedule_collisions(spark):
    cands = spark.createDataFrame([(1, D1, 1, "a", None, None, T0), (2, D2, 1, "A", None, None, T0),
                                   (3, D1, None, "", None, None, T0), (4, D1, None, None, None, None, T0)], CCOLS)
    req = spark.createDataFrame([(1, D2, 1), (3, D2, 2), (4, D2, 3)], "candidate_id long, new_date date, seq long")
    after, refused = D.reschedule(cands, req)
    dates = {r["id"]: r["draw_date"] for r in after.collect()}
    assert dates == {1: D1, 2: D2, 3: D2, 4: D1}
    assert {r["candidate_id"] for r in refused.collect()} == {1, 4}


def test_revoke_appends_reasons_in_order(spark):
    w = spark.createDataFrame([(9, D1, 9, "Z", None, None, "APPROVED", T0, T0, "old")], WCOLS)
    req = spark.createDataFrame([(9, "second", 2), (9, "first", 1), (9, None, 3), (5, "x", 1)],
                                "winner_id long, reason string, seq long")
    after, refused = D.revoke(w, req)
    r = after.first()
    assert r["status"] == "REVOKED" and r["note"] == "old\n[REVOCATION] first\n[REVOCATION] second"
    assert [x["winner_id"] for x in refused.collect()] == [5]
    gone, missing = D.revoke(w, spark.createDataFrame([(D1,), (D2,)], "draw_date date"), mode="delete")
    assert gone.count() == 0 and [x["draw_date"] for x in missing.collect()] == [D2]


def test_backfill_status(spark):
    w = spark.createDataFrame([(1, D1, 1, "", None, None, "REVOKED", T0, None, None),
                               (2, D2, 1, "", None, None, "APPROVED", T0, None, None)], WCOLS)
    got = {r["id"]: r for r in D.backfill_status(w).collect()}
    assert got[1]["status"] == "APPROVED" and got[1]["approved_at"] == T0 and got[2]["approved_at"] is None


# --- quality ------------------------------------------------------------------------------------

def test_validation_collects_all_messages(spark):
    df = spark.createDataFrame([(None, None, None, " "), (1, 1, "c", "kdp-547z"), (1, 1, "c", "ab1")],
                               "service_id long, staff_id long, car_type_id string, vehicle_reg string")
    valid, rejects = Q.validate_washes(df)
    assert [r["vehicle_reg"] for r in valid.collect()] == ["KDP547Z"]
    errs = sorted(len(r["errors"]) for r in rejects.collect())
    assert errs == [1, 4]


def test_unique_and_refs(spark):
    df = spark.createDataFrame([("A", 1), ("a", 1), (None, 2), (None, 2)], "name string, k long")
    assert Q.check_unique(df, ["name"], casefold=True).count() == 1
    assert Q.check_unique(df, ["name"]).count() == 0
    child = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id long, fk long")
    parent = spark.createDataFrame([(10,)], "pk long")
    assert [r["id"] for r in Q.check_refs(child, parent, ["fk"], ["pk"]).collect()] == [3]


def test_receipts_unique_and_continue_after_existing(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), None) for i in range(50)]
    rows[0] = (0, T0, "SH20250310-7")
    df = spark.createDataFrame(rows, "id long, washed_at timestamp_ntz, receipt_no string")
    got = Q.assign_receipts(df).collect()
    nos = [r["receipt_no"] for r in got]
    assert len(set(nos)) == 50 and "SH20250310-8" in nos and "SH20250310-7" in nos


# --- scalar functions and time zones ---------------------------------------------------------------

def test_scalar_functions(spark):
    df = spark.createDataFrame([(" kdp-547 z ", "+254 (712) 000-001", "2025-13"), (None, None, "2025-02")],
                               "reg string, phone string, m string")
    r = df.select(X.plate("reg").alias("p"), X.phone_digits("phone").alias("d"), X.reg("reg").alias("r"),
                  X.regkey("reg").alias("k"), X.to_month("m", "2024-07-09").alias("mo")).collect()
    assert tuple(r[0]) == ("KDP547Z", "254712000001", "KDP-547 Z", " KDP-547 Z ", dt.date(2024, 7, 1))
    assert tuple(r[1]) == ("", "", None, "", dt.date(2025, 2, 1))


@pytest.mark.parametrize("tz", ["Africa/Nairobi", "Europe/Berlin", "America/New_York"])
def test_reports_do_not_depend_on_session_time_zone(spark, tz):
    from rinse.sources import bindings as B
    d = "/root/testdata/sf0.001"
    base = sorted(map(tuple, R.pnl_daily(B.sales(spark, d), B.expenses(spark, d), month="1998-03").collect()))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        other = sorted(map(tuple, R.pnl_daily(B.sales(spark, d), B.expenses(spark, d), month="1998-03").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other and len(base) > 0


def test_price_matrix_holds_every_pair(spark):
    svc = spark.createDataFrame([("A", "A")], "id string, name string")
    ct = spark.createDataFrame([(str(i), str(i), i) for i in range(30)], "id string, label string, sort_order int")
    pr = spark.createDataFrame([], "service_id string, car_type_id string, price decimal(12,2)")
    assert J.price_matrix(svc, ct, pr).count() == 30


def test_typed_read_fails_on_drift(spark):
    from rinse.session import shared_dir
    from rinse.sources import tables as TB

    schema = TB.DRIVER_SCHEMAS["supplier"]
    path = shared_dir(spark, "t-drift")
    good = TB.read_table(spark, "/root/testdata/sf0.001", "supplier")
    for i, (df, part) in enumerate([(good.withColumnRenamed("s_name", "s_nom"), "s_name"),
                                    (good.withColumn("s_suppkey", F.col("s_suppkey").cast("string")), "s_suppkey")]):
        df.write.parquet(f"{path}/{i}")
        with pytest.raises(TB.SchemaDrift, match=part):
            TB.read_typed(spark, f"{path}/{i}", schema)
    good.withColumn("more", F.lit(1)).write.parquet(f"{path}/more")
    assert TB.read_typed(spark, f"{path}/more", schema).columns == schema.names


def test_left_join_in_period_with_one_hot_member(spark):
    staff = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    sales = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (None, 7), (9, 7)], "staff_id long, amount long")
    got = J.left_join_in_period(staff, sales).groupBy("id").agg(F.count("amount").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted(map(tuple, got)) == [(1, 500, 500), (2, 1, 1), (3, 0, 1)]


def test_spaces_only_plate_passes_nonblank_then_trims_to_empty(spark):
    df = spark.createDataFrame([(1, "   "), (2, ""), (3, None), (4, " kaa 001a ")], "id long, vehicle_reg string")
    kept = P.nonblank_filter(df, "vehicle_reg")
    assert sorted(r["id"] for r in kept.collect()) == [1, 4]
    regs = {r["id"]: r["r"] for r in kept.select("id", X.reg("vehicle_reg").alias("r")).collect()}
    assert regs == {1: "", 4: "KAA 001A"}


def test_to_before_from_is_an_empty_period(spark):
    s = spark.createDataFrame([_sale(0, 100)], SALES)
    lo, hi = P.resolve_range(from_="2025-03-12", to="2025-03-09")
    assert hi < lo
    assert P.period_filter(s, "washed_at", from_="2025-03-12", to="2025-03-09").count() == 0
    e = spark.createDataFrame([], EXP)
    assert R.pnl_daily(s, e, from_="2025-03-12", to="2025-03-09").count() == 0


def test_service_keyword_wildcards_and_default_words(spark):
    svc = spark.createDataFrame([(1, "Full Wash"), (2, "Complete Detail"), (3, "Flash"), (4, "Under_Wash"),
                                 (5, "Carpet 50% off")], "id long, name string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(P.service_filter(svc)) == [1, 2]
    assert ids(P.service_filter(svc, keyword="r_w")) == [4]          # '_' matches any one character
    assert ids(P.service_filter(svc, keyword="FULL")) == [1]
    assert ids(P.service_filter(svc, keyword="%")) == [1, 2, 3, 4, 5]
    assert ids(P.service_filter(svc, service_id=3)) == [3]
