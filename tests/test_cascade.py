"""The promotion cascade against a row-at-a-time simulation of the reference's
per-sale logic, on inline tables with the hard cases: a hot customer, anonymous
sales, matching by phone or plate, featured plates with separators, the daily
cap, and a skewed day."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rinse.config import PromoSettings
from rinse.operators import promotions as PR
from rinse.operators.ordered import ordinal, running_sum

VIS = ("id long, washed_at timestamp_ntz, customer_id long, vehicle_reg string, customer_phone string, "
       "unit_price decimal(12,2), commission_pct decimal(5,2)")
WIN = ("id long, draw_date date, customer_id long, vehicle_reg string, customer_phone string, "
       "customer_name string, status string")
FEAT = "id long, vehicle_reg string, month date, created_at timestamp_ntz"


def _plate(s):
    return re.sub(r"[\s-]", "", s.upper()) if s else ""


def _digits(s):
    return re.sub(r"\D+", "", s) if s else ""


def _u(i, seed):
    return int(hashlib.md5(f"{i}{seed}".encode()).hexdigest()[:8], 16) / 2**32


def simulate(visits, winners, featured, cfg: PromoSettings):
    """Sequential replay of the reference's decision for each new sale."""
    day_winner = {}
    for w in sorted(winners, key=lambda w: w[0]):
        if w[6] == cfg.winner_status and w[1] not in day_winner:
            day_winner[w[1]] = w
    feat = {(_plate(f[1]), f[2]) for f in featured if _plate(f[1])}
    used_winner, feat_used, month_n, life_n, free_day = set(), set(), {}, {}, {}
    out = {}
    for v in sorted(visits, key=lambda r: (r[1], r[0])):
        vid, ts, cust, reg, phone = v[0], v[1], v[2], v[3], v[4]
        day, month = ts.date(), ts.date().replace(day=1)
        code = None
        w = day_winner.get(day)
        if w is not None and w[0] not in used_winner:
            m = (cust is not None and w[2] is not None and cust == w[2]) \
                or (_digits(phone) != "" and _digits(phone) == _digits(w[4])) \
                or (_plate(reg) != "" and _plate(reg) == _plate(w[3]))
            if m:
                code = "DAILY_DRAW"
                used_winner.add(w[0])
        if code is None and (_plate(reg), month) in feat:
            key = (_plate(reg), month)
            if not cfg.featured_once_per_month or key not in feat_used:
                code = "FEATURED_VEHICLE"
                feat_used.add(key)
        if code is None and cust is not None:
            if (month_n.get((cust, month), 0) + 1) % 13 == 0:
                code = "LOYALTY_13TH"
        if code is None and cfg.random_enabled and cust is not None:
            if life_n.get(cust, 0) >= cfg.random_min_visits:
                under = not cfg.random_daily_cap or free_day.get(day, 0) < cfg.random_daily_cap
                if under and _u(vid, cfg.seed) < cfg.random_prob:
                    code = "FREE_WASH"
        if code is not None:
            free_day[day] = free_day.get(day, 0) + 1
        if cust is not None:
            month_n[(cust, month)] = month_n.get((cust, month), 0) + 1
            life_n[cust] = life_n.get(cust, 0) + 1
        out[vid] = code
    return out


def _fixture(n=1500, seed=7):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    visits = []
    for i in range(n):
        ts = start + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 45))
        if rnd.random() < 0.3:
            cust = 1                                   # a hot customer: a third of all sales
        elif rnd.random() < 0.15:
            cust = None                                # anonymous
        else:
            cust = rnd.randrange(2, 40)
        reg = rnd.choice([None, "", f"k{chr(97 + (cust or 0) % 26)}b {((cust or 0) * 7) % 1000:03d}x",
                          f"KAB-{rnd.randrange(0, 5):03d}X"])
        phone = rnd.choice([None, f"0712 {(cust or 0):06d}", "(0712) 000003"])
        visits.append((i, ts, cust, reg, phone, None, None))
    visits.append((n, start + dt.timedelta(days=3), 5, None, None, None, None))
    visits.append((n + 1, start + dt.timedelta(days=3), 6, None, None, None, None))   # same ts, id breaks tie
    winners = [(100 + d, (start + dt.timedelta(days=d)).date(), rnd.choice([1, 3, None]),
                rnd.choice([None, "KAB-001X", "kab 002x"]), rnd.choice([None, "0712-000003"]), "W",
                rnd.choice(["APPROVED", "APPROVED", "REVOKED"])) for d in range(0, 45, 2)]
    winners.append((999, start.date(), 7, None, None, "W", "APPROVED"))           # two approved on one day
    featured = [(1, " kab-003x", dt.date(2024, 1, 1), start), (2, "KAB 001X", dt.date(2024, 2, 1), start),
                (3, "kbb 007x", dt.date(2024, 1, 1), start)]
    return visits, winners, featured


@pytest.mark.parametrize("cfg", [
    PromoSettings(random_prob=0.3, random_min_visits=2, random_daily_cap=4),
    PromoSettings(random_prob=0.5, random_min_visits=0, random_daily_cap=0, featured_once_per_month=False),
    PromoSettings(random_enabled=False),
])
def test_cascade_equals_sequential_replay(spark, cfg):
    visits, winners, featured = _fixture()
    expected = simulate(visits, winners, featured, cfg)
    v = spark.createDataFrame(visits, VIS)
    w = spark.createDataFrame(winners, WIN)
    f = spark.createDataFrame(featured, FEAT)
    got = {r["id"]: r["promo_code"] for r in PR.apply_promotions(v, w, f, cfg).select("id", "promo_code").collect()}
    assert got == expected
    assert sum(1 for c in expected.values() if c) > 50


def test_daily_cap_never_exceeded_by_random(spark):
    cfg = PromoSettings(random_prob=0.9, random_min_visits=0, random_daily_cap=3)
    visits, winners, featured = _fixture(n=800, seed=3)
    v = spark.createDataFrame(visits, VIS)
    out = PR.apply_promotions(v, spark.createDataFrame(winners, WIN), spark.createDataFrame(featured, FEAT), cfg)
    per_day = out.filter("random_free").groupBy(F.to_date("washed_at")).count().collect()
    assert per_day and max(r["count"] for r in per_day) <= 3


def test_skew_safe_ordinal_matches_row_number(spark):
    rows = [(i, 0 if i % 3 else i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 13 % 5000))
            for i in range(3000)]                        # group 0 holds two thirds of the rows
    df = spark.createDataFrame(rows, "id long, g long, ts timestamp_ntz")
    from pyspark.sql import Window
    ref = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy("ts", "id"))).collect()}
    sliced = {r["id"]: r["o"] for r in ordinal(df, ["g"], ["ts", "id"], "o", partitions=16).collect()}
    one = {r["id"]: r["o"] for r in ordinal(df, ["g"], ["ts", "id"], "o", partitions=1).collect()}
    assert sliced == ref and one == ref


def test_running_sum_with_null_group(spark):
    rows = [(i, None if i % 2 else 1, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    got = {r["id"]: r["s"] for r in running_sum(df, ["g"], ["id"], F.col("v"), "s", partitions=5).collect()}
    acc, exp = {}, {}
    for i, g, v in rows:
        acc[g] = acc.get(g, 0) + v
        exp[i] = acc[g]
    assert got == exp


@pytest.mark.parametrize("cut", [0.4, 0.75])
def test_incremental_batches_equal_one_pass(spark, cut):
    """Booking in two batches, the second seeing the first as history, gives the
    same promotions as one sequential pass over everything."""
    cfg = PromoSettings(random_prob=0.3, random_min_visits=2, random_daily_cap=4)
    visits, winners, featured = _fixture(seed=11)
    expected = simulate(visits, winners, featured, cfg)
    ordered = sorted(visits, key=lambda r: (r[1], r[0]))
    k = int(len(ordered) * cut)
    old, new = ordered[:k], ordered[k:]
    hist = spark.createDataFrame(
        [(r[2], r[3], r[1], expected[r[0]] is not None, expected[r[0]]) for r in old],
        "customer_id long, vehicle_reg string, washed_at timestamp_ntz, is_free boolean, promo_code string")
    w = spark.createDataFrame(winners, WIN)        # draw days used by history are derived from it
    got = PR.apply_promotions(spark.createDataFrame(new, VIS), w, spark.createDataFrame(featured, FEAT), cfg, hist)
    got = {r["id"]: r["promo_code"] for r in got.select("id", "promo_code").collect()}
    assert got == {r[0]: expected[r[0]] for r in new}


def test_salted_top_k_per_group_equals_plain_window(spark):
    from pyspark.sql import Window
    from rinse.operators.ordered import top_k_per_group
    rows = [(i, 0 if i % 4 else i % 5, (i * 7919) % 97, i) for i in range(4000)]   # group 0: three quarters
    df = spark.createDataFrame(rows, "id long, g long, score long, tie long")
    order = [F.col("score").desc(), F.col("tie").asc()]
    want = {(r["g"], r["id"], r["rk"]) for r in df.withColumn(
        "rk", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("rk <= 7").collect()}
    got = {(r["g"], r["id"], r["rank"]) for r in top_k_per_group(df, ["g"], order, 7, F.col("id"), salts=16).collect()}
    assert got == want


def test_first_per_group_carries_nulls(spark):
    from rinse.operators.ordered import first_per_group
    df = spark.createDataFrame([(1, 5, None), (1, 3, None), (1, 4, "x"), (2, 9, "y"), (None, 1, "z"), (None, 0, None)],
                               "g long, o long, v string")
    got = {r["g"]: (r["o"], r["v"]) for r in first_per_group(df, ["g"], ["o"], ["o", "v"]).collect()}
    assert got == {1: (3, None), 2: (9, "y"), None: (0, None)}
