"""Files of one table whose columns are not the declared ones."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from rinse.session import shared_dir
from rinse.sources.tables import SchemaDrift, check_files, file_fill, read_typed

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a.b", T.DoubleType())])


def written(spark, *tables) -> str:
    path = shared_dir(spark, "t-drift")
    for t in tables:
        t.coalesce(1).write.mode("append").parquet(path)
    return path


def good(spark, low: int):
    return spark.range(low, low + 3).selectExpr("id", "CAST(id AS DOUBLE) AS `a.b`")


def test_a_column_missing_in_one_file_is_named_with_it(spark):
    path = written(spark, good(spark, 0), good(spark, 3), spark.range(6, 9))
    assert spark.read.schema(SCHEMA).parquet(path).count() == 9
    lacking = {r["file"] for r in file_fill(spark, path, SCHEMA).filter("n_values = 0").collect()}
    assert len(lacking) == 1
    with pytest.raises(SchemaDrift) as e:
        check_files(spark, path, SCHEMA)
    assert lacking.pop() in str(e.value) and "a.b: double declared, missing found" in str(e.value) and "\n" not in str(e.value)


def test_a_column_of_nulls_is_no_drift(spark):
    path = written(spark, good(spark, 0), spark.range(3, 6).selectExpr("id", "CAST(NULL AS DOUBLE) AS `a.b`"), good(spark, 0).limit(0))
    check_files(spark, path, SCHEMA)
    assert read_typed(spark, path, SCHEMA).count() == 6


def test_a_column_of_another_type_in_one_file_fails(spark):
    path = written(spark, good(spark, 0), spark.range(3, 6).selectExpr("id", "'x' AS `a.b`"))
    with pytest.raises(Exception, match="t-drift"):
        check_files(spark, path, SCHEMA)
