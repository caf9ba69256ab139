"""Batch table maintenance (section 2.8 of the survey).

The reference changes one row per request (INSERT ... ON CONFLICT, UPDATE ...
COALESCE, DELETE).  Here a *batch* of changes is applied to a table and the
result is the table's next snapshot.  Plain Parquet has no MERGE, so each
operation is a join: the latest change per key is found with a grouped max
over a struct (map-side partial aggregation, no whole key group in one task)
and then joined to the target on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.operators.asof import least_active
from rinse.operators.commissions import book_commission
from rinse.operators.ordered import ordinal
from rinse.sources import sinks
from rinse.sources.schemas import MONEY, PCT


def _keys_on(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k] == right[f"{prefix}{k}"])
    return cond


def latest_per_key(changes: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The values of ``cols`` on the last change (largest ``order``) of each key."""
    s = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                       *[F.col(c).alias(f"_v_{c}") for c in cols])).alias("_m")
    return changes.groupBy(*keys).agg(s).select(*keys, *[F.col(f"_m._v_{c}").alias(c) for c in cols])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """m1: insert or replace rows on ``keys``; several changes of one key -> the last one wins."""
    cols = [c for c in target.columns if c not in keys]
    last = latest_per_key(changes, keys, order, cols).withColumn("_present", F.lit(True))
    last = last.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in cols],
                       "_present")
    j = target.join(last, _keys_on(target, last, keys, "_n_"), "full_outer")
    new = F.coalesce(F.col("_present"), F.lit(False))
    return j.select(*[F.coalesce(F.col(k), F.col(f"_n_{k}")).alias(k) for k in keys],
                    *[F.when(new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """m2: add rows whose key is not in the table yet (ON CONFLICT DO NOTHING); incoming
    duplicates of one key keep the first by ``order``."""
    cols = [c for c in target.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                                                   *[F.col(c).alias(f"_v_{c}") for c in cols])).alias("_m"))
    first = first.select(*keys, *[F.col(f"_m._v_{c}").alias(c) for c in cols])
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def patch(target: DataFrame, changes: DataFrame, key: str, order: list[str],
          cols: list[str] | None = None) -> DataFrame:
    """m3: partial update, NULL means keep (a value can never be cleared).

    With several changes of a key, each column takes its last non-NULL value,
    which is what applying them one after another gives."""
    cols = cols or [c for c in changes.columns if c != key and c not in order]
    aggs = [F.max(F.when(F.col(c).isNotNull(),
                         F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                                  F.col(c).alias("v")))).alias(f"_m_{c}") for c in cols]
    last = changes.groupBy(key).agg(*aggs)
    last = last.select(F.col(key).alias("_k"), *[F.col(f"_m_{c}.v").alias(f"_n_{c}") for c in cols])
    j = target.join(last, target[key] == last["_k"], "left")
    return j.select(*[(F.coalesce(F.col(f"_n_{c}"), F.col(c)).cast(target.schema[c].dataType).alias(c)
                       if c in cols else F.col(c)) for c in target.columns])


def patch_washes(washes: DataFrame, changes: DataFrame, order: list[str],
                 default_pct=C.DEFAULT_COMMISSION_PCT) -> DataFrame:
    """m3b: patch sales, then recompute commission and profit.

    As in the reference update, a change that omits the percent resets it to
    the default (30) instead of keeping the stored one; rows without a
    change keep their booked amounts."""
    ch = changes.withColumn("commission_pct", F.coalesce(F.col("commission_pct"),
                                                         F.lit(default_pct).cast(PCT)))
    touched = ch.select(F.col("id").alias("_tid")).distinct().withColumn("_touched", F.lit(True))
    cols = [c for c in ["service_id", "car_type_id", "staff_id", "unit_price", "commission_pct", "washed_at"]
            if c in ch.columns and c in washes.columns]
    w = (washes.withColumn("_old_commission_amount", F.col("commission_amount"))
               .withColumn("_old_profit_amount", F.col("profit_amount")))
    p = patch(w, ch, "id", order, cols)
    p = p.join(touched, p["id"] == touched["_tid"], "left").drop("_tid")
    recomputed = book_commission(p, default_pct)
    t = F.coalesce(F.col("_touched"), F.lit(False))
    out = recomputed
    for c in ("commission_amount", "profit_amount"):
        out = out.withColumn(c, F.when(t, F.col(c)).otherwise(F.col(f"_old_{c}")).cast(MONEY))
    return out.drop("_touched", "_old_commission_amount", "_old_profit_amount")


def delete_keys(target: DataFrame, keys: DataFrame, key: str,
                restrict: list[tuple[DataFrame, str]] | None = None,
                cascade: list[tuple[DataFrame, str]] | None = None):
    """m4: delete requested keys.  A key referenced by a ``restrict`` child is refused
    (FK without ON DELETE); rows of ``cascade`` children referencing a deleted
    key are deleted too.  Returns (kept, refused, cascaded children kept)."""
    req = keys.select(F.col(key).alias("_del")).distinct()
    refused = req.limit(0)
    for child, fk in restrict or []:
        # distinct first: a key with very many children is one row per task from here on
        refs = child.select(F.col(fk).alias("_del")).filter(F.col("_del").isNotNull()).distinct()
        refused = refused.unionByName(req.join(refs, "_del", "left_semi"))
    refused = refused.distinct()
    deleted = req.join(refused, "_del", "left_anti")
    kept = target.join(deleted, target[key] == deleted["_del"], "left_anti")
    children = [child.join(deleted, child[fk] == deleted["_del"], "left_anti") for child, fk in cascade or []]
    return kept, refused.withColumnRenamed("_del", key), children


def seed_prices(services: DataFrame, car_types: DataFrame, prices: DataFrame,
                rules: dict | None = None) -> DataFrame:
    """m5: a price for every (service, car type) pair from a CASE on the car-type label,
    only where no price exists.  Returns the rows to insert."""
    ct = car_types.select(F.col("id").alias("car_type_id"), "label")
    grid = services.select(F.col("id").alias("service_id")).crossJoin(ct)
    grid = grid.withColumn("price", X.price_case("label", rules).cast(MONEY)).drop("label")
    return grid.join(prices.select("service_id", "car_type_id"), ["service_id", "car_type_id"], "left_anti")


def resolve_customers(customers: DataFrame, contacts: DataFrame) -> DataFrame:
    """m11: match each incoming contact to a customer: phone first, else plate, else new.

    Lookups are exact, as in the reference; several customers with the same
    phone or plate resolve to the lowest id.  Contacts are resolved against
    the table as it stood.  New contacts that share a phone or a plate, directly
    or through others, are one new customer; ``new_customer_key`` is the smallest
    of the group's phones (``phone ...``), else plates (``plate ...``).  A contact
    with neither gets none."""
    def blank_to_null(c):
        return F.when(F.col(c) != "", F.col(c))

    c = contacts.withColumn("_phone", blank_to_null("phone")).withColumn("_plate", blank_to_null("vehicle_reg"))
    by_phone = (customers.filter(F.col("phone").isNotNull() & (F.col("phone") != ""))
                .groupBy(F.col("phone").alias("_pk")).agg(F.min("id").alias("_by_phone")))
    by_plate = (customers.filter(F.col("vehicle_reg").isNotNull() & (F.col("vehicle_reg") != ""))
                .groupBy(F.col("vehicle_reg").alias("_rk")).agg(F.min("id").alias("_by_plate")))
    j = (c.join(by_phone, c["_phone"] == by_phone["_pk"], "left")
          .join(by_plate, c["_plate"] == by_plate["_rk"], "left"))
    match = (F.when(F.col("_by_phone").isNotNull(), F.lit("phone"))
              .when(F.col("_by_plate").isNotNull(), F.lit("plate"))
              .when(F.col("_phone").isNotNull() | F.col("_plate").isNotNull(), F.lit("new"))
              .otherwise(F.lit("none")))
    seen = j.select("contact_id", F.coalesce(F.col("_by_phone"), F.col("_by_plate")).alias("customer_id"), match.alias("match"),
                    F.when(match == "new", F.concat(F.lit("phone "), "_phone")).alias("_p"),
                    F.when(match == "new", F.concat(F.lit("plate "), "_plate")).alias("_v"))
    root = same_person(seen.select("_p", "_v"))
    own = F.coalesce("_p", "_v")
    return (seen.withColumn("_own", own).join(root, F.col("_own") == root["node"], "left")
            .select("contact_id", "customer_id", "match", F.col("root").alias("new_customer_key")))


def same_person(marks: DataFrame) -> DataFrame:
    """``node, root`` for the phones and plates in the two columns of ``marks``: nodes on one row are one person.

    The root is the smallest node of the person.  Labels spread over the rows and
    then jump to the label of their label, until none changes; the number of
    rounds grows with the logarithm of a chain's length, and there is no bound on it."""
    pairs = marks.toDF("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = sinks.materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "person-pairs")
    nodes = marks.select(F.explode(F.array(*[F.col(c) for c in marks.columns])).alias("node")).filter("node IS NOT NULL").distinct()
    labels = sinks.materialise(nodes.withColumn("root", F.col("node")), "person")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        now = sinks.materialise(step.join(jump, "next").select("node", "root", F.least("next", "far").alias("next")), "person")
        labels = now.select("node", F.col("next").alias("root"))
        if now.filter("root <> next").isEmpty():
            return labels


def resolve_in_order(customers: DataFrame, contacts: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """m11, one contact after the other: ``(resolved, customers after)``.

    ``customers``: id, name, phone, vehicle_reg; ``contacts``: contact_id, name,
    phone, vehicle_reg and the columns ``order`` (a total order; the last is a
    unique key).  A contact belongs to the customer with its phone, else to the
    one who drives its plate *at that moment* (the lowest id, if several), else
    it becomes a new customer.  Each match patches the name and the plate with
    what the contact gives, never the phone, so a plate may change hands inside
    the batch.  Empty strings count as NULL; a contact with neither phone nor
    plate belongs to nobody (``match`` none).

    ``resolved``: contact_id, customer_id, match (phone, plate, new, none).  New
    customers are numbered densely after the highest id, in order of arrival.

    A contact depends only on earlier ones.  From a first guess, each round
    turns the assignment into intervals of plate ownership, looks every contact
    up as of its arrival and assigns anew, until nothing changes.  After k
    rounds the first k contacts are right, so the fixed point is the sequential
    result; the rounds needed are as many as matches hang on one another."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    arrived = contacts.select("contact_id", blank("name"), blank("phone"), blank("vehicle_reg"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    known = customers.select("id", "name", blank("phone"), blank("vehicle_reg"))
    by_phone = known.filter("phone IS NOT NULL").groupBy("phone").agg(F.min("id").alias("by_phone"))
    rows = ordinal(arrived, [], [f"_o{i}" for i in range(len(order))], out="no").join(by_phone, "phone", "left")
    rows = sinks.materialise(rows.select("no", "contact_id", "name", "phone", F.col("vehicle_reg").alias("plate"), "by_phone"), "arrivals")
    highest = customers.agg(F.max("id")).first()[0] or 0

    plates = rows.filter("plate IS NOT NULL").select("plate").distinct()
    stood = sinks.materialise(known.select(F.col("id").alias("cust"), F.col("vehicle_reg").alias("plate")).join(plates, "plate", "left_semi"), "plates")
    drivers = stood.groupBy("plate").agg(F.min("cust").alias("owner"))
    # a new customer is known by the number of the contact that brought it, above all ids
    guess = _assign(rows.join(drivers, "plate", "left").withColumn("creator", F.lit(None).cast("bigint")), highest)
    state = sinks.materialise(guess, "assigned")
    while True:
        now = sinks.materialise(_look_up(rows, state, stood, highest), "assigned")
        changed = now.alias("n").join(state.alias("s"), "no").filter("NOT (n.cust <=> s.cust) OR n.match <> s.match")
        state, done = now, changed.isEmpty()
        if done:
            break

    born = ordinal(state.filter("match = 'new'").select("no", F.col("cust").alias("raw")), [], ["no"], out="rank")
    numbers = sinks.materialise(born.select("raw", (F.lit(highest) + F.col("rank")).alias("id")), "numbers")
    final = sinks.materialise(state.join(rows, "no").join(numbers, F.col("cust") == F.col("raw"), "left")
                              .select("no", "contact_id", F.coalesce("id", "cust").alias("customer_id"), "match", "name", "phone", "plate"), "resolved")

    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("no")))
    told = final.filter("customer_id IS NOT NULL").groupBy(F.col("customer_id").alias("id")).agg(
        latest("name").alias("n_name"), latest("plate").alias("n_plate"), F.max(F.when(F.col("match") == "new", F.col("phone"))).alias("n_phone"),
        F.max((F.col("match") == "new").cast("int")).alias("is_new"))
    patched = customers.join(told, "id", "left").select(*[
        F.coalesce("n_name", customers["name"]).alias("name") if c == "name" else
        F.coalesce("n_plate", customers["vehicle_reg"]).alias("vehicle_reg") if c == "vehicle_reg" else customers[f"`{c}`"] for c in customers.columns])
    new = told.filter("is_new = 1").select("id", F.col("n_name").alias("name"), F.col("n_phone").alias("phone"), F.col("n_plate").alias("vehicle_reg"))
    return final.select("contact_id", "customer_id", "match"), patched.unionByName(new, allowMissingColumns=True)


def _assign(rows: DataFrame, highest: int) -> DataFrame:
    """``no, cust, match`` from each contact's ``by_phone`` (table), ``creator`` (new customer with its phone) and ``owner`` (of its plate)."""
    made = F.col("creator").isNotNull() & (F.col("creator") < F.col("no"))
    some = F.col("phone").isNotNull() | F.col("plate").isNotNull()
    match = (F.when(F.col("by_phone").isNotNull() | made, F.lit("phone")).when(F.col("owner").isNotNull(), F.lit("plate"))
             .when(some, F.lit("new")).otherwise(F.lit("none")))
    cust = (F.when(F.col("by_phone").isNotNull(), F.col("by_phone")).when(made, F.lit(highest) + F.col("creator"))
            .when(F.col("owner").isNotNull(), F.col("owner")).when(some, F.lit(highest) + F.col("no")))
    return rows.select("no", cust.alias("cust"), match.alias("match"))


def _look_up(rows: DataFrame, state: DataFrame, stood: DataFrame, highest: int) -> DataFrame:
    """One round: who drives which plate when, if ``state`` holds, and the assignment that follows from it."""
    placed = rows.join(state, "no")
    creators = placed.filter("match = 'new' AND phone IS NOT NULL").groupBy("phone").agg(F.min("no").alias("creator"))
    events = stood.select("cust", F.lit(0).cast("bigint").alias("no"), "plate").unionByName(
        placed.filter("cust IS NOT NULL AND plate IS NOT NULL").select("cust", "no", "plate"))
    until = F.lead("no").over(Window.partitionBy("cust").orderBy("no"))
    spans = events.select(F.col("plate").alias("key"), F.col("no").alias("start"), until.alias("stop"), F.col("cust").alias("value"))
    asked = rows.filter("by_phone IS NULL AND plate IS NOT NULL").select(F.col("plate").alias("key"), F.col("no").alias("at"))
    owners = least_active(spans, asked).select(F.col("at").alias("no"), F.col("least").alias("owner"))
    return _assign(rows.join(creators, "phone", "left").join(owners, "no", "left"), highest)


def patch_matched_customers(customers: DataFrame, contacts: DataFrame, resolved: DataFrame,
                            order: list[str]) -> DataFrame:
    """m11 (second output): matched customers get name and plate patched (never the phone);
    the last non-NULL value per customer wins, as with sequential updates."""
    ch = (resolved.filter(F.col("customer_id").isNotNull()).join(contacts, "contact_id")
          .select(F.col("customer_id").alias("id"), F.col("name"),
                  F.when(F.col("vehicle_reg") != "", F.col("vehicle_reg")).alias("vehicle_reg"), *order))
    return patch(customers, ch, "id", order, ["name", "vehicle_reg"])


def customer_counters(washes: DataFrame) -> DataFrame:
    """m12: visits_count and last_visit per customer, recomputed from the sales."""
    return (washes.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("visits_count"), F.max("washed_at").alias("last_visit")))
