"""The bindings of ``rinse.sources.bindings`` as DuckDB SQL (for the oracle).

Each entry is the body of a CTE over the driver's pre-registered views.
``with_bindings`` prepends the CTEs a query needs, dependencies first.
"""

from __future__ import annotations


def _plate(u: str, sep: str, upper: bool) -> str:
    l1, l2 = f"chr(CAST(97 + {u} % 26 AS INT))", f"chr(CAST(97 + {u} % 23 AS INT))"
    suffix = f"CASE WHEN {u} % 13 = 0 THEN '' ELSE 'x' END"
    digits = f"lpad(CAST({u} % 1000 AS VARCHAR), 3, '0')"
    if upper:
        return f"concat('K', upper({l1}), upper({l2}), '{sep}', {digits}, upper({suffix}))"
    return f"concat('k', {l1}, {l2}, '{sep}', {digits}, {suffix})"


BINDINGS: dict[str, str] = {
    "b_sales": """
SELECT l_partkey AS service_id, l_suppkey AS staff_id,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
       CAST(l_discount * 100 AS DECIMAL(5,2)) AS commission_pct,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(5,2)), 2) AS DECIMAL(12,2)) AS commission_amount,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2))
            - CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(5,2)), 2) AS DECIMAL(12,2))
            AS DECIMAL(12,2)) AS profit_amount,
       l_returnflag = 'R' AS is_free,
       l_shipdate AS washed_at
FROM lineitem""",
    "b_washes": """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS id,
       l_partkey AS service_id, o_orderpriority AS car_type_id, l_suppkey AS staff_id,
       o_custkey AS customer_id,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
       CAST(l_discount * 100 AS DECIMAL(5,2)) AS commission_pct,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(5,2)), 2) AS DECIMAL(12,2)) AS commission_amount,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2))
            - CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(5,2)), 2) AS DECIMAL(12,2))
            AS DECIMAL(12,2)) AS profit_amount,
       l_returnflag = 'R' AS is_free,
       CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'FEATURED_VEHICLE' ELSE 'FREE_WASH' END END AS promo_id,
       concat('K', chr(CAST(65 + o_custkey % 26 AS INT)), chr(CAST(65 + o_custkey % 23 AS INT)),
              lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'), 'A') AS vehicle_reg,
       l_shipdate AS washed_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "b_expenses": """
SELECT o_orderkey AS id, o_orderpriority AS category,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('status ', o_orderstatus) END AS note,
       CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderdate AS spent_at,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('user-', CAST(o_custkey % 50 AS VARCHAR)) END AS created_by_user_id,
       o_orderdate AS created_at
FROM orders""",
    "b_services": """
SELECT p_partkey AS id, p_name AS name, p_type AS kind,
       CASE WHEN p_size > 25 THEN NULL ELSE concat(p_type, ' ', p_brand) END AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS base_price
FROM part""",
    "b_car_types": """
SELECT o_orderpriority AS id,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'Salon/Small' WHEN '2' THEN 'SUV'
            WHEN '3' THEN 'Van/Bus' WHEN '4' THEN 'Truck' ELSE 'Motorbike' END AS label,
       CASE WHEN left(o_orderpriority, 1) = '2' THEN NULL ELSE o_orderpriority END AS description,
       CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL ELSE CAST(left(o_orderpriority, 1) AS INT) END AS sort_order
FROM (SELECT DISTINCT o_orderpriority FROM orders) d""",
    "b_staff": """
SELECT s_suppkey AS id, s_name AS name, r_name AS role_label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "b_rates": """
SELECT role, CAST(CASE role WHEN 'AFRICA' THEN 30 WHEN 'ASIA' THEN 20 ELSE 10 END AS DECIMAL(5,2)) AS percentage
FROM (SELECT DISTINCT role_label AS role FROM b_staff) r
WHERE role IN ('AFRICA', 'ASIA', 'EUROPE')""",
    "b_customers": """
SELECT c_custkey AS id, c_name AS name,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            ELSE concat('+254 ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0')) END AS phone,
       CASE WHEN c_custkey % 11 = 0 THEN ''
            ELSE concat(' k', chr(CAST(97 + c_custkey % 26 AS INT)), chr(CAST(97 + c_custkey % 23 AS INT)),
                        CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE ' ' END,
                        lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'),
                        CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'a' END, ' ') END AS vehicle_reg
FROM customer""",
    "b_prices": """
SELECT p_type AS service_id, p_brand AS car_type_id, MIN(CAST(p_retailprice AS DECIMAL(12,2))) AS price
FROM part WHERE p_size <= 10 GROUP BY p_type, p_brand""",
    "b_price_services": """
SELECT p_type AS id, p_type AS name, CASE WHEN p_type LIKE 'S%' THEN NULL ELSE lower(p_type) END AS description
FROM (SELECT DISTINCT p_type FROM part) d""",
    "b_price_car_types": """
SELECT p_brand AS id, p_brand AS label, CAST(substr(p_brand, 7) AS INT) AS sort_order
FROM (SELECT DISTINCT p_brand FROM part) d""",
    "b_unpriced": """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS id,
       p_type AS service_id, p_brand AS car_type_id,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS unit_price,
       l_shipdate AS washed_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "b_visits": f"""
SELECT event_id AS id, ts AS washed_at, user_id AS customer_id, event_type AS service_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 20 END AS staff_id,
       CASE WHEN event_type = 'view' AND user_id % 7 = 0 THEN NULL ELSE 'STD' END AS car_type_id,
       CAST(value AS DECIMAL(12,2)) AS unit_price,
       CAST(CASE WHEN event_type = 'purchase' THEN NULL ELSE (user_id % 4) * 10 END AS DECIMAL(5,2)) AS commission_pct,
       {_plate('user_id', ' ', False)} AS vehicle_reg,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('(0712) ', lpad(CAST(user_id AS VARCHAR), 6, '0')) END AS customer_phone
FROM events""",
    "b_featured": f"""
SELECT MIN(event_id) AS id, {_plate('user_id', '-', False)} AS vehicle_reg,
       CAST(date_trunc('month', ts) AS DATE) AS month, MIN(ts) AS created_at
FROM events WHERE event_type = 'purchase' AND value >= 100
GROUP BY 2, 3""",
    "b_candidates": f"""
SELECT event_id AS id, CAST(ts AS DATE) AS draw_date,
       CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS customer_id,
       CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN NULL
            ELSE {_plate('user_id', '-', True)} END AS vehicle_reg,
       CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('0712-', lpad(CAST(user_id AS VARCHAR), 6, '0')) END AS customer_phone,
       concat('Member ', CAST(user_id AS VARCHAR)) AS customer_name,
       ts AS created_at
FROM events WHERE event_type = 'signup'""",
    "b_winners": """
SELECT c.id, c.draw_date, c.customer_id, upper(c.vehicle_reg) AS vehicle_reg, c.customer_phone, c.customer_name,
       CASE WHEN day(c.draw_date) % 4 = 0 THEN 'REVOKED' WHEN day(c.draw_date) % 4 = 1 THEN 'PENDING'
            ELSE 'APPROVED' END AS status,
       c.created_at,
       CASE WHEN day(c.draw_date) % 4 IN (2, 3) AND day(c.draw_date) % 3 = 0
            THEN c.created_at + INTERVAL 1 HOUR END AS approved_at,
       CASE WHEN day(c.draw_date) % 2 = 0 THEN 'picked at counter' END AS note
FROM b_candidates c JOIN (SELECT draw_date, MIN(id) AS id FROM b_candidates GROUP BY draw_date) f
  ON c.draw_date = f.draw_date AND c.id = f.id""",
    "b_promos": """
SELECT * FROM (VALUES ('DAILY_DRAW', 'DAILY_DRAW', 'Daily draw', TRUE),
                      ('FEATURED_VEHICLE', 'FEATURED_VEHICLE', 'Featured vehicle', TRUE),
                      ('LOYALTY_13TH', 'LOYALTY_13TH', 'Loyalty 13th', TRUE),
                      ('FREE_WASH', 'FREE_WASH', 'Free wash', TRUE)) t(id, code, name, is_active)""",
    "b_price_changes": """
SELECT p_type AS service_id, p_brand AS car_type_id, CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_partkey AS seq
FROM part WHERE p_size >= 11 AND p_size <= 20""",
    "b_featured_requests": f"""
SELECT event_id AS id, {_plate('user_id', '-', False)} AS vehicle_reg, CAST(date_trunc('month', ts) AS DATE) AS month,
       ts AS created_at
FROM events WHERE event_type = 'purchase' AND value >= 50""",
    "b_expense_changes": """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'RECLASSIFIED' END AS category,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(12,2)) + 1 END AS amount,
       CASE WHEN o_orderstatus = 'F' THEN 'checked' END AS note, o_orderdate AS seq
FROM orders""",
    "b_visit_changes": """
SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) + 5 END AS unit_price,
       CAST(CASE WHEN event_type = 'click' THEN 15 END AS DECIMAL(5,2)) AS commission_pct,
       CAST(CASE WHEN event_type = 'view' THEN 99 END AS BIGINT) AS staff_id, ts AS seq
FROM events WHERE event_type IN ('purchase', 'click', 'view')""",
    "b_contacts": """
SELECT o_orderkey AS contact_id,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('Walk-in ', CAST(o_custkey AS VARCHAR)) END AS name,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN concat('+254 ', lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0'))
            WHEN o_orderpriority = '3-MEDIUM' THEN concat('+255 ', lpad(CAST(o_custkey % 997 AS VARCHAR), 6, '0')) END AS phone,
       CASE WHEN o_orderstatus = 'F' THEN
            CASE WHEN o_custkey % 11 = 0 THEN ''
                 ELSE concat(' k', chr(CAST(97 + o_custkey % 26 AS INT)), chr(CAST(97 + o_custkey % 23 AS INT)),
                             CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE ' ' END,
                             lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'),
                             CASE WHEN o_custkey % 13 = 0 THEN '' ELSE 'a' END, ' ') END END AS vehicle_reg,
       o_orderdate AS seq
FROM orders""",
}

DEPENDS = {"b_rates": ["b_staff"], "b_winners": ["b_candidates"]}


def with_bindings(names: list[str], body: str, recursive: bool = False) -> str:
    """``WITH <bindings>[, <extra ctes>] <select>``.

    ``body`` is either a SELECT, or extra CTEs followed by the SELECT and
    introduced by a leading comma (``", x AS (...) SELECT ..."``).
    """
    order: list[str] = []

    def add(n):
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in order)
    body = body.strip()
    start = "WITH RECURSIVE" if recursive else "WITH"
    if body.startswith(","):
        return f"{start} {ctes}{body}"
    return f"{start} {ctes}\n{body}"
