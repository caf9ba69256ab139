"""The snapshot sink replaces exactly the days contained in a batch."""

from __future__ import annotations

import datetime as dt

from rinse.session import shared_dir
from rinse.sources import sinks

SCHEMA = "id long, amount long, day date"
D1, D2, D3 = dt.date(2025, 1, 1), dt.date(2025, 1, 2), dt.date(2025, 1, 3)


def test_snapshot_replaces_only_the_batch_days(spark):
    path = shared_dir(spark, "t-sink")
    sinks.write_snapshot(spark.createDataFrame([(1, 10, D1), (2, 20, D2), (3, 30, D2)], SCHEMA), path)
    sinks.write_snapshot(spark.createDataFrame([(4, 40, D2), (5, 50, D3)], SCHEMA), path)
    got = sorted((r["id"], r["amount"], r["day"]) for r in sinks.read_snapshot(spark, path).collect())
    assert got == [(1, 10, D1), (4, 40, D2), (5, 50, D3)]
