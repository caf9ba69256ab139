"""Every registered query equals its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from rinse.plans import registry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()
registry.load_all()
KEYS = sorted(registry.ORACLE)   # the corpus operators have tests of their own


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _duck_type(spark_type: str) -> str:
    return SPARK_TO_DUCK.get(spark_type, spark_type.upper())


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    q, o = set(registry.QUERIES), set(registry.ORACLE)
    assert q - o == {"e2_ingest", "m11_resolve_in_order", "m11_customers_after"}, f"queries without oracle: {sorted(q - o)}"


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = registry.QUERIES[key](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.ORACLE[key])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    d_types = {c[0]: str(c[1]) for c in cur.description}
    assert {n: _duck_type(t) for n, t in df.dtypes} == d_types
    assert len(s_rows) == len(d_rows)
    a, b = _digest(df.columns, s_rows), _digest(d_cols, d_rows)
    assert hashlib.sha256("\n".join(a).encode()).digest() == hashlib.sha256("\n".join(b).encode()).digest(), \
        (set(a) - set(b), set(b) - set(a))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "revenue", "commission", "profit", "expenses", "net"]
    assert df.count() > 0
