"""Published batches: once, whole or not at all."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from rinse.session import shared_dir
from rinse.sources import batches as T_

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a.b", T.StringType()), T.StructField("day", T.DateType())])
D1, D2, D3 = (dt.date(2025, 1, k) for k in (1, 2, 3))


def df(spark, *rows):
    return spark.createDataFrame([(i, f"v{i}", d) for i, d in rows], SCHEMA)


def ids(spark, path):
    got = T_.read_batches(spark, path, SCHEMA)
    assert got.schema.names == SCHEMA.names
    rows = got.collect()
    assert all(r["a.b"] == f"v{r['id']}" for r in rows)
    return sorted((r["id"], str(r["day"])) for r in rows)


@pytest.fixture
def path(spark):
    return shared_dir(spark, "t-batches")


def test_table_without_batches_is_empty(spark, path):
    assert ids(spark, path) == [] and T_.compact(spark, path, SCHEMA) is None


def test_a_batch_written_twice_counts_once(spark, path):
    rows = df(spark, (1, D1), (2, D2), (2, D2), (3, None))
    assert T_.write_batch(rows, path, 0) and not T_.write_batch(rows, path, 0)
    assert T_.write_batch(df(spark, (4, D1)), path, 1)
    assert ids(spark, path) == [(1, "2025-01-01"), (2, "2025-01-02"), (2, "2025-01-02"), (3, "None"), (4, "2025-01-01")]


def test_a_write_that_breaks_off_is_invisible(spark, path):
    T_.write_batch(df(spark, (1, D1)), path, 0)
    T_.stage(df(spark, (8, D1), (9, D2)), path, 1)
    assert ids(spark, path) == [(1, "2025-01-01")]
    assert T_.write_batch(df(spark, (2, D1)), path, 1)
    assert ids(spark, path) == [(1, "2025-01-01"), (2, "2025-01-01")]


def test_a_task_that_fails_leaves_no_trace(spark, path):
    T_.write_batch(df(spark, (1, D1)), path, 0)
    bad = df(spark, (2, D1), (3, D2)).selectExpr("CASE WHEN id = 3 THEN raise_error('broken') ELSE id END AS id", "`a.b`", "day")
    with pytest.raises(Exception, match="broken"):
        T_.write_batch(bad.select(bad["id"].cast("bigint").alias("id"), "`a.b`", "day"), path, 1)
    assert ids(spark, path) == [(1, "2025-01-01")] and not T_.is_published(spark, path, 1)


def test_the_second_of_two_attempts_does_not_count(spark, path):
    one, two = T_.stage(df(spark, (1, D1)), path, 0), T_.stage(df(spark, (1, D1)), path, 0)
    assert T_.publish(spark, path, 0, one, SCHEMA) and not T_.publish(spark, path, 0, two, SCHEMA)
    assert ids(spark, path) == [(1, "2025-01-01")]


def test_a_replacing_batch_hides_earlier_ones_on_its_days_only(spark, path):
    T_.write_batch(df(spark, (1, D1), (2, D2), (3, None)), path, 0)
    T_.write_batch(df(spark, (5, D2), (6, D3)), path, 2, mode=T_.REPLACE)
    T_.write_batch(df(spark, (7, D2)), path, 3)
    T_.write_batch(df(spark, (4, D2), (8, D1)), path, 1)          # late: before the replacing batch in order
    assert ids(spark, path) == [(1, "2025-01-01"), (3, "None"), (5, "2025-01-02"), (6, "2025-01-03"), (7, "2025-01-02"), (8, "2025-01-01")]
    T_.write_batch(df(spark, (9, None)), path, 4, mode=T_.REPLACE)
    assert (3, "None") not in ids(spark, path) and (9, "None") in ids(spark, path)


def test_compaction_keeps_the_rows_and_shortens_the_log(spark, path):
    for k in range(3):
        T_.write_batch(df(spark, (k, D1), (10 + k, D2)), path, k)
    T_.write_batch(df(spark, (5, D1)), path, 3, mode=T_.REPLACE)
    before = ids(spark, path)
    assert T_.compact(spark, path, SCHEMA) == 3
    assert ids(spark, path) == before and T_.counting(spark, path).count() == 1
    assert not T_.write_batch(df(spark, (0, D1)), path, 0)         # inside the base
    T_.write_batch(df(spark, (6, D1)), path, 4)
    assert ids(spark, path) == sorted([*before, (6, "2025-01-01")])
    assert T_.compact(spark, path, SCHEMA) == 4 and len(ids(spark, path)) == len(before) + 1


def test_empty_batch_is_published(spark, path):
    assert T_.write_batch(df(spark), path, 0) and not T_.write_batch(df(spark, (1, D1)), path, 0)
    assert T_.write_batch(df(spark, (1, D1)), path, 1, part=None)
    assert ids(spark, path) == [(1, "2025-01-01")]


@pytest.mark.parametrize(("batch", "part", "mode"), [(-1, "day", "append"), (0, None, "replace"), (0, "day", "upsert")])
def test_arguments(spark, path, batch, part, mode):
    with pytest.raises(ValueError):
        T_.write_batch(df(spark), path, batch, part, mode)
