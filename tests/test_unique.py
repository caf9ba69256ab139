"""All unique indexes of a table in one pass."""

from __future__ import annotations

from collections import Counter

from rinse.operators.quality import UniqueIndex, index_clashes
from rinse.session import shared_dir

DDL = "index bigint, a string, b int, `c.d` string"
INDEXES = (UniqueIndex("plain", ("a",)), UniqueIndex("folded", ("lower(a)",)), UniqueIndex("pair", ("a", "b")),
           UniqueIndex("partial", ("b",), "`c.d` = 'on'"), UniqueIndex("dotted", ("`c.d`", "a")))


def test_composite_partial_folded_and_hot_keys(spark):
    rows = [(1, "x", 1, "on"), (2, "X", 1, "on"), (3, "x", 1, "off"), (4, "y", None, "on"), (5, "y", None, None), (6, None, 2, "on"), (7, None, 2, "off"),
            (8, 'q"', 3, "on"), (9, 'q"', 3, "on")] + [(10 + k, "hot", k % 2, "off") for k in range(300)]
    got = {(r["index"], r["key"]): r["n"] for r in index_clashes(spark.createDataFrame(rows, DDL).repartition(5), INDEXES).collect()}
    want = Counter()
    for _, a, b, c in rows:
        for name, key, ok in (("plain", (a,), True), ("folded", (a and a.lower(),), True), ("pair", (a, b), True), ("partial", (b,), c == "on"), ("dotted", (c, a), True)):
            if ok and None not in key:
                want[name, "[" + ",".join('"' + str(k).replace('"', '\\"') + '"' for k in key) + "]"] += 1
    assert got == {k: n for k, n in want.items() if n > 1}


def test_empty_table_and_no_clash(spark):
    assert index_clashes(spark.createDataFrame([], DDL), INDEXES).count() == 0
    assert index_clashes(spark.createDataFrame([(1, "x", 1, "on"), (2, "y", 2, "on")], DDL), INDEXES).count() == 0


def test_one_scan_a_pass(spark):
    """However many indexes: one scan of the table for the sketch and one for the suspects."""
    path = shared_dir(spark, "t-unique")
    spark.createDataFrame([(1, "x", 1, "on"), (2, "x", 2, "on")], DDL).write.parquet(path)
    plan = index_clashes(spark.read.parquet(path), INDEXES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2      # the table and the suspects
