"""Candidate moves against a replay of the requests one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from rinse.operators import draw
from rinse.operators.draw import reschedule

D0 = dt.date(2025, 3, 1)
CANDS = "id bigint, draw_date date, customer_id bigint, vehicle_reg string, other string"
REQS = "candidate_id bigint, new_date date, seq int, draw_date string"


def replay(cands, reqs):
    at = {i: (d, c, (v or "").upper()) for i, d, c, v in cands}
    refused = []
    for i, new, _ in sorted(reqs, key=lambda r: (r[2], r[0] or 0, r[1] or D0)):
        if i is None or new is None:
            refused.append((i, new, "candidate_id and new_date are required"))
        elif i not in at:
            refused.append((i, new, "candidate not found"))
        elif any(o != i and at[o] == (new, *at[i][1:]) for o in at):
            refused.append((i, new, "same candidate already on the new date"))
        else:
            at[i] = (new, *at[i][1:])
    return sorted((i, v[0]) for i, v in at.items()), sorted(refused, key=repr)


def check(spark, cands, reqs):
    after, refused = reschedule(spark.createDataFrame([(*c, "x") for c in cands], CANDS), spark.createDataFrame([(*r, "x") for r in reqs], REQS))
    want, want_refused = replay(cands, reqs)
    assert sorted((r["id"], r["draw_date"]) for r in after.collect()) == want
    assert sorted(((r["candidate_id"], r["new_date"], r["reason"]) for r in refused.collect()), key=repr) == want_refused
    assert after.columns == ["id", "draw_date", "customer_id", "vehicle_reg", "other"]


def day(n):
    return D0 + dt.timedelta(days=n)


def test_chain_of_ten_moves_each_frees_the_next_date(spark):
    cands = [(i, day(i), 7, "KAA 1") for i in range(10)]
    check(spark, cands, [(i, day(i + 1), 100 - i) for i in range(10)])          # all move, last first
    check(spark, cands, [(i, day(i + 1), i) for i in range(10)])                # only the last one moves


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches(spark, seed):
    """Few dates and persons, many moves per candidate, one anonymous person with a third of all rows."""
    rng = random.Random(seed)
    people = [(None, None), (None, None), (None, ""), (1, "a"), (1, "A"), (1, "b"), (2, None), (3, "")]
    cands = [(i, day(rng.randrange(5)), *rng.choice(people)) for i in range(40)]
    reqs = [(rng.choice([*range(42), None] if rng.random() < 0.1 else range(40)), rng.choice([day(rng.randrange(6))] * 19 + [None]), s) for s in range(120)]
    check(spark, cands, reqs)


def test_no_requests(spark):
    check(spark, [(1, D0, 1, "a")], [])
    check(spark, [], [(1, D0, 1)])


def test_small_persons_need_no_rounds(spark, monkeypatch):
    """Persons of few rows are replayed in one place; the rounds, left to larger ones, decide the same."""
    rng = random.Random(5)
    cands = [(i, day(rng.randrange(5)) if rng.random() < 0.9 else None, *rng.choice([(1, "a"), (1, "b"), (None, "")])) for i in range(30)]
    cands += [(30, day(1), 2, "x"), (30, day(1), 2, "x"), (31, day(2), 2, "x"), (32, day(4), 2, "x"), (32, day(4), 3, "y"), (33, day(4), 3, "y")]
    reqs = [(rng.randrange(35), day(rng.randrange(6)), rng.choice([s // 2, None])) for s in range(120)]
    frames = spark.createDataFrame([(*c, "x") for c in cands], CANDS), spark.createDataFrame([(*r, "x") for r in reqs], REQS)
    both = [sorted(map(repr, [*after.collect(), *refused.collect()])) for after, refused in
            (draw.reschedule(*frames, replay_most=0), draw.reschedule(*frames, replay_most=40), draw.reschedule(*frames))]
    assert both[0] == both[1] == both[2]
    monkeypatch.setattr(draw, "_judge_moves", lambda *a: pytest.fail("a round for small persons"))
    check(spark, [(i, day(i % 4), i // 8, "a") for i in range(40)], [(i, day((i * 7 + s) % 6), s * 40 + i) for i in range(40) for s in range(3)])
