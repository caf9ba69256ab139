"""Registered table-maintenance and draw-workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinse.functions import expr as X
from rinse.operators import draw as D
from rinse.operators import maintenance as M
from rinse.operators import rankings as K
from rinse.operators import retract as RT
from rinse.operators.commissions import book_commission
from rinse.plans.bindings_sql import with_bindings as W
from rinse.plans.q_ranking import ELIGIBLES_BY_MONTH_SQL, KEYWORD, MIN_WASHES
from rinse.plans.registry import register
from rinse.sources import bindings as B
from rinse.sources.sinks import materialise
from rinse.sources.tables import read_table

SEED = "rinse"
AS_OF = "2024-02-01 00:00:00"

# --- m1 / m2 / m3 / m3b ---------------------------------------------------------------

@register("m1_upsert", W(["b_prices", "b_price_changes"], """
, last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service_id, car_type_id ORDER BY seq DESC) AS rn
                          FROM b_price_changes) x WHERE rn = 1)
SELECT COALESCE(t.service_id, l.service_id) AS service_id, COALESCE(t.car_type_id, l.car_type_id) AS car_type_id,
       CASE WHEN l.service_id IS NOT NULL THEN l.price ELSE t.price END AS price
FROM b_prices t FULL OUTER JOIN last l ON t.service_id = l.service_id AND t.car_type_id = l.car_type_id"""))
def q_m1(spark, d):
    ch = B.price_changes(spark, d)
    return M.upsert(B.prices(spark, d), ch, ["service_id", "car_type_id"], ["seq"])


@register("m2_insert_if_absent", W(["b_featured", "b_featured_requests"], """
, first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_reg, month ORDER BY id) AS rn
                           FROM b_featured_requests) x WHERE rn = 1)
SELECT id, vehicle_reg, month, created_at FROM b_featured
UNION ALL
SELECT f.id, f.vehicle_reg, f.month, f.created_at FROM first f
WHERE NOT EXISTS (SELECT 1 FROM b_featured t WHERE t.vehicle_reg = f.vehicle_reg AND t.month = f.month)"""))
def q_m2(spark, d):
    return M.insert_if_absent(B.featured(spark, d), B.featured_requests(spark, d), ["vehicle_reg", "month"], ["id"])


@register("m3_patch", W(["b_expenses", "b_expense_changes"], """
, c AS (SELECT id,
               arg_max(category, seq) FILTER (WHERE category IS NOT NULL) AS category,
               arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount,
               arg_max(note, seq) FILTER (WHERE note IS NOT NULL) AS note
        FROM b_expense_changes GROUP BY id)
SELECT t.id, COALESCE(c.category, t.category) AS category, COALESCE(c.note, t.note) AS note,
       CAST(COALESCE(c.amount, t.amount) AS DECIMAL(12,2)) AS amount, t.spent_at, t.created_by_user_id, t.created_at
FROM b_expenses t LEFT JOIN c ON c.id = t.id"""))
def q_m3(spark, d):
    return M.patch(B.expenses(spark, d), B.expense_changes(spark, d), "id", ["seq"])


@register("m3b_patch_washes", W(["b_visits", "b_visit_changes"], """
, booked AS (SELECT id, staff_id, unit_price, CAST(COALESCE(commission_pct, 30) AS DECIMAL(5,2)) AS commission_pct,
                    CAST(ROUND(unit_price * COALESCE(commission_pct, 30) * 0.01, 2) AS DECIMAL(12,2)) AS commission_amount
             FROM b_visits),
  c AS (SELECT id, arg_max(unit_price, seq) FILTER (WHERE unit_price IS NOT NULL) AS unit_price,
               arg_max(COALESCE(commission_pct, 30), seq) AS commission_pct,
               arg_max(staff_id, seq) FILTER (WHERE staff_id IS NOT NULL) AS staff_id
        FROM b_visit_changes GROUP BY id),
  p AS (SELECT b.id, COALESCE(c.staff_id, b.staff_id) AS staff_id,
               CAST(COALESCE(c.unit_price, b.unit_price) AS DECIMAL(12,2)) AS unit_price,
               CAST(COALESCE(c.commission_pct, b.commission_pct) AS DECIMAL(5,2)) AS commission_pct,
               c.id IS NOT NULL AS touched, b.commission_amount AS old_commission
        FROM booked b LEFT JOIN c ON c.id = b.id)
SELECT id, staff_id, unit_price, commission_pct,
       CAST(CASE WHEN touched THEN ROUND(unit_price * commission_pct * 0.01, 2) ELSE old_commission END AS DECIMAL(12,2)) AS commission_amount,
       CAST(unit_price - CASE WHEN touched THEN ROUND(unit_price * commission_pct * 0.01, 2) ELSE old_commission END AS DECIMAL(12,2)) AS profit_amount
FROM p"""))
def q_m3b(spark, d):
    booked = book_commission(B.visits(spark, d))
    out = M.patch_washes(booked, B.visit_changes(spark, d), ["seq"])
    return out.select("id", "staff_id", "unit_price", "commission_pct", "commission_amount", "profit_amount")


# --- m4 delete --------------------------------------------------------------------------

def _delete_staff(spark, d):
    req = read_table(spark, d, "supplier").filter(F.col("s_acctbal") < 2000).select(F.col("s_suppkey").alias("id"))
    return M.delete_keys(B.staff(spark, d), req, "id", restrict=[(B.visits(spark, d), "staff_id")])


_DEL_SQL = """
, req AS (SELECT DISTINCT s_suppkey AS id FROM supplier WHERE s_acctbal < 2000),
  refused AS (SELECT id FROM req WHERE EXISTS (SELECT 1 FROM b_visits v WHERE v.staff_id = req.id)),
  deleted AS (SELECT id FROM req WHERE id NOT IN (SELECT id FROM refused))
"""


@register("m4_delete_kept", W(["b_staff", "b_visits"], _DEL_SQL +
                              "SELECT * FROM b_staff s WHERE NOT EXISTS (SELECT 1 FROM deleted x WHERE x.id = s.id)"))
def q_m4_kept(spark, d):
    return _delete_staff(spark, d)[0]


@register("m4_delete_refused", W(["b_staff", "b_visits"], _DEL_SQL + "SELECT id FROM refused"))
def q_m4_refused(spark, d):
    return _delete_staff(spark, d)[1]


@register("m4_delete_cascade", W(["b_price_services", "b_prices"], """
SELECT p.* FROM b_prices p
WHERE NOT EXISTS (SELECT 1 FROM b_price_services s WHERE s.id LIKE 'S%' AND s.id = p.service_id)"""))
def q_m4_cascade(spark, d):
    svc = B.price_services(spark, d)
    req = svc.filter(F.col("id").like("S%")).select("id")
    _, _, children = M.delete_keys(svc, req, "id", cascade=[(B.prices(spark, d), "service_id")])
    return children[0]


@register("m5_seed_matrix", W(["b_price_services", "b_price_car_types", "b_prices"], """
SELECT s.id AS service_id, ct.id AS car_type_id,
       CAST(CASE ct.label WHEN 'Salon/Small' THEN 600 WHEN 'SUV' THEN 800 WHEN 'Van/Bus' THEN 1000
                          WHEN 'Truck' THEN 1500 ELSE 0 END AS DECIMAL(12,2)) AS price
FROM b_price_services s CROSS JOIN b_price_car_types ct
WHERE NOT EXISTS (SELECT 1 FROM b_prices p WHERE p.service_id = s.id AND p.car_type_id = ct.id)"""))
def q_m5(spark, d):
    return M.seed_prices(B.price_services(spark, d), B.price_car_types(spark, d), B.prices(spark, d))


# --- draw workflow ----------------------------------------------------------------------

@register("m6_backfill_status", W(["b_winners"], """
SELECT id, draw_date, customer_id, vehicle_reg, customer_phone, customer_name, 'APPROVED' AS status, created_at,
       CASE WHEN status IS DISTINCT FROM 'APPROVED' THEN COALESCE(approved_at, created_at) ELSE approved_at END AS approved_at,
       note
FROM b_winners"""))
def q_m6(spark, d):
    return D.backfill_status(B.winners(spark, d))


def _approve(spark, d):
    c = B.candidates(spark, d)
    req = c.select(F.col("id").alias("request_id"), F.col("id").alias("candidate_id"),
                   F.lit(None).cast("date").alias("draw_date"), F.col("id").alias("seq"),
                   F.lit("batch approval").alias("note"))
    return D.approve(c, B.winners(spark, d), req, AS_OF)


_APPROVE_SQL = f"""
, r AS (SELECT id AS request_id, id AS seq, draw_date AS _date, * EXCLUDE (id, draw_date, created_at), id AS cid
        FROM b_candidates),
  open AS (SELECT * FROM r WHERE _date NOT IN (SELECT draw_date FROM b_winners WHERE status = 'APPROVED')),
  ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY _date ORDER BY seq, request_id) AS rn FROM open)
"""


@register("m7_approve", W(["b_candidates", "b_winners"], _APPROVE_SQL + f"""
SELECT id, draw_date, customer_id, vehicle_reg, customer_phone, customer_name, status, created_at, approved_at, note
FROM b_winners
UNION ALL
SELECT cid, _date, customer_id, vehicle_reg, customer_phone, customer_name, 'APPROVED',
       TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}', 'batch approval'
FROM ranked WHERE rn = 1"""))
def q_m7(spark, d):
    return _approve(spark, d)[0]


@register("m7_approve_refused", W(["b_candidates", "b_winners"], _APPROVE_SQL + """
SELECT request_id, 'an approved winner already exists for the date' AS reason FROM r
WHERE _date IN (SELECT draw_date FROM b_winners WHERE status = 'APPROVED')
UNION ALL
SELECT request_id, 'date already taken in this batch' FROM ranked WHERE rn > 1"""))
def q_m7_refused(spark, d):
    return _approve(spark, d)[1]


def _reschedule(spark, d):
    c = B.candidates(spark, d)
    req = c.select(F.col("id").alias("candidate_id"), F.date_add("draw_date", 1).alias("new_date"),
                   F.col("id").alias("seq"))
    return D.reschedule(c, req)


def _resched_sql(requests: str) -> str:
    """The requests replayed one by one, per person, on the list of the person's candidates and dates."""
    return f"""
, asked AS (SELECT id AS candidate_id, new_date, seq, concat(COALESCE(CAST(customer_id AS VARCHAR), '-'), '|', COALESCE(UPPER(vehicle_reg), '')) AS p
            FROM ({requests})),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY seq, candidate_id, new_date) AS k FROM asked),
  held AS (SELECT concat(COALESCE(CAST(customer_id AS VARCHAR), '-'), '|', COALESCE(UPPER(vehicle_reg), '')) AS p,
                  list({{'c': id, 'd': draw_date}}) AS pos FROM b_candidates GROUP BY 1),
  replay(p, k, pos, candidate_id, new_date, ok) AS (
    SELECT p, CAST(0 AS BIGINT), pos, CAST(NULL AS BIGINT), CAST(NULL AS DATE), CAST(NULL AS BOOLEAN) FROM held
    UNION ALL
    SELECT p, k, CASE WHEN ok THEN list_transform(pos, lambda x: CASE WHEN x.c = cand THEN {{'c': x.c, 'd': nd}} ELSE x END) ELSE pos END, cand, nd, ok
    FROM (SELECT s.p, r.k, s.pos, r.candidate_id AS cand, r.new_date AS nd,
                 len(list_filter(s.pos, lambda x: x.c <> r.candidate_id AND x.d = r.new_date)) = 0 AS ok
          FROM replay s JOIN r ON r.p = s.p AND r.k = s.k + 1)),
  final AS (SELECT candidate_id, arg_max(new_date, k) AS new_date FROM replay WHERE ok GROUP BY candidate_id)
"""


_NEXT_DAY = "SELECT *, draw_date + 1 AS new_date, id AS seq FROM b_candidates"
#: three moves each, the latest dates first, so that a move frees the date that the next one wants
_CHAIN = ("SELECT *, draw_date + CAST(step AS INTEGER) AS new_date, place * 100000 - (draw_date - DATE '1970-01-01') AS seq "
          "FROM b_candidates, (VALUES (0, 1), (1, 2), (2, -1)) AS m(place, step)")
_MOVED = """
SELECT c.id, COALESCE(m.new_date, c.draw_date) AS draw_date, c.customer_id, c.vehicle_reg, c.customer_phone,
       c.customer_name, c.created_at
FROM b_candidates c LEFT JOIN final m ON m.candidate_id = c.id"""
_NOT_MOVED = "SELECT candidate_id, new_date, 'same candidate already on the new date' AS reason FROM replay WHERE NOT ok"
_CAND_COLS = ["id", "draw_date", "customer_id", "vehicle_reg", "customer_phone", "customer_name", "created_at"]


@register("m8_reschedule", W(["b_candidates"], _resched_sql(_NEXT_DAY) + _MOVED, recursive=True))
def q_m8(spark, d):
    return _reschedule(spark, d)[0].select(*_CAND_COLS)


@register("m8_reschedule_refused", W(["b_candidates"], _resched_sql(_NEXT_DAY) + _NOT_MOVED, recursive=True))
def q_m8_refused(spark, d):
    return _reschedule(spark, d)[1]


def _chained(spark, d):
    c = B.candidates(spark, d)
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(s).alias("step")) for p, s in ((0, 1), (1, 2), (2, -1))]))
    req = c.select(F.col("id").alias("candidate_id"), "draw_date", steps.alias("m")).select(
        "candidate_id", F.date_add("draw_date", F.col("m.step")).alias("new_date"),
        (F.col("m.place") * 100000 - F.datediff("draw_date", F.lit("1970-01-01").cast("date"))).alias("seq"))
    return D.reschedule(c, req)


@register("m8_reschedule_chain", W(["b_candidates"], _resched_sql(_CHAIN) + _MOVED, recursive=True))
def q_m8_chain(spark, d):
    return _chained(spark, d)[0].select(*_CAND_COLS)


@register("m8_reschedule_chain_refused", W(["b_candidates"], _resched_sql(_CHAIN) + _NOT_MOVED, recursive=True))
def q_m8_chain_refused(spark, d):
    return _chained(spark, d)[1]


def _revoke(spark, d):
    c = B.candidates(spark, d)
    req = c.select(F.col("id").alias("winner_id"),
                   F.when(F.col("customer_id").isNotNull(),
                          F.concat(F.lit("duplicate of "), F.col("customer_id").cast("string"))).alias("reason"),
                   F.col("id").alias("seq"))
    return D.revoke(B.winners(spark, d), req)


_REVOKE_SQL = """
, req AS (SELECT id AS winner_id, CASE WHEN customer_id IS NOT NULL THEN concat('duplicate of ', CAST(customer_id AS VARCHAR)) END AS reason,
                 id AS seq FROM b_candidates)
"""


@register("m9_revoke", W(["b_candidates", "b_winners"], _REVOKE_SQL + """
SELECT w.id, w.draw_date, w.customer_id, w.vehicle_reg, w.customer_phone, w.customer_name,
       CASE WHEN r.winner_id IS NOT NULL THEN 'REVOKED' ELSE w.status END AS status, w.created_at, w.approved_at,
       CASE WHEN r.winner_id IS NOT NULL THEN concat(COALESCE(w.note, ''),
            CASE WHEN r.reason IS NOT NULL THEN concat(chr(10), '[REVOCATION] ', r.reason) ELSE '' END) ELSE w.note END AS note
FROM b_winners w LEFT JOIN req r ON r.winner_id = w.id"""))
def q_m9(spark, d):
    return _revoke(spark, d)[0]


@register("m9_revoke_refused", W(["b_candidates", "b_winners"], _REVOKE_SQL + """
SELECT winner_id, reason, seq, 'winner not found' AS refusal FROM req
WHERE winner_id NOT IN (SELECT id FROM b_winners)"""))
def q_m9_refused(spark, d):
    return _revoke(spark, d)[1].select("winner_id", "reason", "seq", "refusal")


@register("m9_revoke_delete", W(["b_candidates", "b_winners"], """
SELECT * FROM b_winners WHERE draw_date NOT IN (SELECT DISTINCT draw_date + 15 FROM b_candidates)"""))
def q_m9_delete(spark, d):
    dates = B.candidates(spark, d).select(F.date_add("draw_date", 15).alias("draw_date")).distinct()
    return D.revoke(B.winners(spark, d), dates, mode="delete")[0]


@register("m10_autodraw", W(["b_washes", "b_customers", "b_services", "b_winners", "b_candidates"],
                            ELIGIBLES_BY_MONTH_SQL + f"""
, elig AS (SELECT * FROM ranked WHERE rank <= 200),
  dates AS (SELECT DISTINCT CAST(washed_at AS DATE) AS draw_date FROM b_washes),
  open AS (SELECT draw_date, CAST(date_trunc('month', draw_date) AS DATE) AS month FROM dates
           WHERE draw_date NOT IN (SELECT draw_date FROM b_winners)),
  pool AS (SELECT o.draw_date, e.*, md5(concat(COALESCE(CAST(e.customer_id AS VARCHAR), ''), '|',
                                               CAST(o.draw_date AS VARCHAR), '|{SEED}')) AS k
           FROM open o JOIN elig e ON e.month = o.month),
  picked AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY draw_date ORDER BY k, customer_id) AS rn FROM pool) x
             WHERE rn = 1)
SELECT id, draw_date, customer_id, vehicle_reg, customer_phone, customer_name, status, created_at, approved_at, note
FROM b_winners
UNION ALL
SELECT -CAST(draw_date - DATE '1970-01-01' AS BIGINT), draw_date, customer_id, vehicle_reg, customer_phone, customer_name,
       'APPROVED', TIMESTAMP '{AS_OF}', CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
FROM picked"""))
def q_m10(spark, d):
    w = B.washes(spark, d)
    dates = w.select(X.day("washed_at").alias("draw_date")).distinct()
    elig = K.eligibles_by_month(w, B.customers(spark, d), B.services(spark, d),
                                min_washes=MIN_WASHES, limit=200, keyword=KEYWORD)
    return D.auto_draw(dates, elig, B.winners(spark, d), SEED, as_of=AS_OF)


# --- customers ----------------------------------------------------------------------------

_RESOLVE_SQL = """
, ph AS (SELECT phone AS pk, MIN(id) AS by_phone FROM b_customers WHERE phone IS NOT NULL AND phone <> '' GROUP BY phone),
  pl AS (SELECT vehicle_reg AS rk, MIN(id) AS by_plate FROM b_customers WHERE vehicle_reg IS NOT NULL AND vehicle_reg <> ''
         GROUP BY vehicle_reg),
  c AS (SELECT *, NULLIF(phone, '') AS _phone, NULLIF(vehicle_reg, '') AS _plate FROM b_contacts),
  found AS (SELECT c.contact_id, COALESCE(ph.by_phone, pl.by_plate) AS customer_id,
                   CASE WHEN ph.by_phone IS NOT NULL THEN 'phone' WHEN pl.by_plate IS NOT NULL THEN 'plate'
                        WHEN c._phone IS NOT NULL OR c._plate IS NOT NULL THEN 'new' ELSE 'none' END AS match,
                   'phone ' || c._phone AS p, 'plate ' || c._plate AS v
            FROM c LEFT JOIN ph ON c._phone = ph.pk LEFT JOIN pl ON c._plate = pl.rk),
  marks AS (SELECT DISTINCT p, v FROM found WHERE match = 'new'),
  reach(node, root) AS (SELECT coalesce(p, v), coalesce(p, v) FROM marks UNION SELECT v, v FROM marks WHERE v IS NOT NULL
          UNION SELECT CASE WHEN m.p = r.node THEN m.v ELSE m.p END, r.root FROM reach r JOIN marks m ON r.node IN (m.p, m.v)
                WHERE m.p IS NOT NULL AND m.v IS NOT NULL),
  persons AS (SELECT node, MIN(root) AS root FROM reach GROUP BY node),
  res AS (SELECT contact_id, customer_id, match, root AS new_customer_key
          FROM found LEFT JOIN persons ON match = 'new' AND node = coalesce(p, v))
"""


@register("m11_resolve_customers", W(["b_customers", "b_contacts"], _RESOLVE_SQL + "SELECT * FROM res", recursive=True))
def q_m11(spark, d):
    return M.resolve_customers(B.customers(spark, d), B.contacts(spark, d))


@register("m11_patched_customers", W(["b_customers", "b_contacts"], _RESOLVE_SQL + """
, ch AS (SELECT r.customer_id AS id, k.name, NULLIF(k.vehicle_reg, '') AS vehicle_reg, k.seq, k.contact_id
         FROM res r JOIN b_contacts k ON k.contact_id = r.contact_id WHERE r.customer_id IS NOT NULL),
  last AS (SELECT id, arg_max(name, (seq, contact_id)) FILTER (WHERE name IS NOT NULL) AS name,
                  arg_max(vehicle_reg, (seq, contact_id)) FILTER (WHERE vehicle_reg IS NOT NULL) AS vehicle_reg
           FROM ch GROUP BY id)
SELECT t.id, COALESCE(l.name, t.name) AS name, t.phone, COALESCE(l.vehicle_reg, t.vehicle_reg) AS vehicle_reg
FROM b_customers t LEFT JOIN last l ON l.id = t.id""", recursive=True))
def q_m11p(spark, d):
    cu, co = B.customers(spark, d), B.contacts(spark, d)
    return M.patch_matched_customers(cu, co, M.resolve_customers(cu, co), ["seq", "contact_id"])


# A replay contact by contact is too slow in SQL on whole tables; tests/test_customers.py replays it in memory.
@register("m11_resolve_in_order")
def q_m11_in_order(spark, d):
    return M.resolve_in_order(B.customers(spark, d), B.contacts(spark, d), ["seq", "contact_id"])[0]


@register("m11_customers_after")
def q_m11_after(spark, d):
    return M.resolve_in_order(B.customers(spark, d), B.contacts(spark, d), ["seq", "contact_id"])[1]


@register("m12_counters_kept_up", W(["b_washes"], """
, changed AS (SELECT CASE WHEN hour(washed_at) % 2 = 0 AND unit_price > 30000 THEN NULLIF(customer_id % 97, 0) ELSE customer_id END AS customer_id,
                     CASE WHEN unit_price > 60000 THEN washed_at - INTERVAL 400 DAY ELSE washed_at END AS washed_at
              FROM b_washes WHERE unit_price >= 2000)
SELECT customer_id, COUNT(*) AS visits_count, MAX(washed_at) AS last_visit FROM changed WHERE customer_id IS NOT NULL GROUP BY customer_id"""))
def q_m12_kept_up(spark, d):
    """Counters of all sales, then three batches: the cheap sales deleted, some given to other customers, the dear ones put back in time."""
    # read again for each batch, so joined once
    w = materialise(B.washes(spark, d).select("customer_id", "washed_at", "unit_price"), "sales")
    given = F.expr("CASE WHEN hour(washed_at) % 2 = 0 AND unit_price > 30000 THEN nullif(customer_id % 97, 0) ELSE customer_id END")
    back = F.expr("CASE WHEN unit_price > 60000 THEN washed_at - INTERVAL 400 DAY ELSE washed_at END")
    kept = w.filter("unit_price >= 2000")
    given_away = kept.withColumn("customer_id", given)
    put_back = given_away.withColumn("washed_at", back)
    # one change per sale; the fixture's sales have no unique id to compare tables by
    change = lambda df, who, when: df.select(F.col("customer_id").alias("old_customer_id"), F.col("washed_at").alias("old_washed_at"),
                                             who.alias("new_customer_id"), when.alias("new_washed_at"))
    nobody, never = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    batches = [(change(w.filter("unit_price < 2000"), nobody, never), kept),
               (change(kept, given, F.col("washed_at")).filter("NOT old_customer_id <=> new_customer_id"), given_away),
               (change(given_away, F.col("customer_id"), back).filter("old_washed_at <> new_washed_at"), put_back)]
    state = materialise(RT.counters_state(w), "counters")
    for changes, after in batches:
        state = materialise(RT.apply_changes(state, changes, after), "counters")
    return state.select("customer_id", "visits_count", "last_visit")


@register("m12_customer_counters", W(["b_washes"], """
SELECT customer_id, COUNT(*) AS visits_count, MAX(washed_at) AS last_visit FROM b_washes
WHERE customer_id IS NOT NULL GROUP BY customer_id"""))
def q_m12(spark, d):
    return M.customer_counters(B.washes(spark, d))
