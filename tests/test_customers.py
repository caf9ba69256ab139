"""Customers resolved in order against a replay contact by contact; as-of lookups against all pairs."""

from __future__ import annotations

import random

import pytest

from rinse.operators.asof import least_active
from rinse.operators.maintenance import resolve_in_order
from rinse.sources import bindings as B
from tests.conftest import SMALL

CUSTOMERS = "id bigint, name string, phone string, vehicle_reg string, tier string"
CONTACTS = "contact_id bigint, name string, phone string, vehicle_reg string, seq int, id string, no int"


def replay(customers, contacts):
    """``customers``: (id, name, phone, plate); ``contacts``: (contact_id, name, phone, plate) in order."""
    table = {i: [n, p, v] for i, n, p, v in customers}
    high, out = max(table, default=0), []
    for k, name, phone, plate in contacts:
        name, phone, plate = name or None, phone or None, plate or None
        if not phone and not plate:
            out.append((k, None, "none"))
            continue
        who = min((i for i, c in table.items() if phone and c[1] == phone), default=None)
        match = "phone"
        if who is None:
            who, match = min((i for i, c in table.items() if plate and c[2] == plate), default=None), "plate"
        if who is None:
            high += 1
            who, match = high, "new"
            table[who] = [name, phone, plate]
        else:
            table[who][0], table[who][2] = name or table[who][0], plate or table[who][2]
        out.append((k, who, match))
    return sorted(out), sorted(((i, *c) for i, c in table.items()), key=repr)


def check(spark, customers, contacts):
    cdf = spark.createDataFrame([(*c, "gold") for c in customers], CUSTOMERS)
    kdf = spark.createDataFrame([(k, n, p, v, s, "x", 7) for s, (k, n, p, v) in enumerate(contacts)], CONTACTS).repartition(4)
    resolved, after = resolve_in_order(cdf, kdf, ["seq", "contact_id"])
    want, want_after = replay(customers, contacts)
    assert sorted((r["contact_id"], r["customer_id"], r["match"]) for r in resolved.collect()) == want
    assert sorted(((r["id"], r["name"], r["phone"], r["vehicle_reg"]) for r in after.collect()), key=repr) == want_after
    assert after.columns == cdf.columns


def test_a_plate_changes_hands_inside_the_batch(spark):
    customers = [(1, "Ann", "11", "KAA"), (2, "Bob", "22", "KBB"), (5, None, None, "KCC")]
    contacts = [(1, None, None, "KAA"), (2, None, "22", "KAA"), (3, "x", None, "KBB"), (4, None, "11", "KDD"), (5, None, None, "KAA"),
                (6, "new", "99", None), (7, "", "99", "KEE"), (8, "late", None, "KEE"), (9, None, "77", "KCC"), (10, None, "77", None), (11, None, "", ""), (12, "z", "22", "KBB")]
    check(spark, customers, contacts)


def test_a_chain_of_ten_matches(spark):
    """Each contact finds the plate that the one before has set."""
    contacts = [(0, "a", "1", "P0")]
    for k in range(1, 11):
        contacts += [(2 * k, None, "1", f"P{k}"), (2 * k + 1, f"n{k}", None, f"P{k}"), (100 + k, None, None, f"P{k - 1}")]
    check(spark, [(3, "old", "5", "P4")], contacts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    """Few phones and plates; one plate on a third of all contacts."""
    rng = random.Random(seed)
    phones, plates = [None, "", *map(str, range(8))], [None, "", *["hot"] * 5, *(f"K{k}" for k in range(7))]
    customers = [(i, rng.choice([None, f"c{i}"]), rng.choice(phones), rng.choice(plates)) for i in range(1, 8)]
    contacts = [(k, rng.choice([None, "", f"n{k}"]), rng.choice(phones), rng.choice(plates)) for k in range(150)]
    check(spark, customers, contacts)


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "a", "1", "P")], [])
    check(spark, [], [(1, "a", None, "P"), (2, "b", None, "P")])


def test_whole_small_table(spark):
    cu, co = B.customers(spark, SMALL), B.contacts(spark, SMALL)
    resolved, after = resolve_in_order(cu, co, ["seq", "contact_id"])
    rows = sorted(co.collect(), key=lambda r: (r["seq"], r["contact_id"]))
    want, want_after = replay([(r["id"], r["name"], r["phone"], r["vehicle_reg"]) for r in cu.collect()],
                              [(r["contact_id"], r["name"], r["phone"], r["vehicle_reg"]) for r in rows])
    assert sorted((r["contact_id"], r["customer_id"], r["match"]) for r in resolved.collect()) == want
    assert sorted(((r["id"], r["name"], r["phone"], r["vehicle_reg"]) for r in after.select("id", "name", "phone", "vehicle_reg").collect()), key=repr) == want_after


def test_least_active_interval(spark):
    rng = random.Random(4)
    spans = [(rng.choice("abc"), a := rng.randrange(60), rng.choice([None, a, a + rng.randrange(40)]), v) for v in range(200)]
    asked = [(k, t) for k in "abcd" for t in range(0, 110, 3)]
    got = least_active(spark.createDataFrame(spans, "key string, start bigint, stop bigint, value bigint"), spark.createDataFrame(asked, "key string, at bigint"))
    want = [(k, t, min((v for x, a, b, v in spans if x == k and a < t and (b is None or t <= b)), default=None)) for k, t in asked]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
