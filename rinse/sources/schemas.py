"""Logical schemas of the business tables (declared, never inferred).

Money is decimal with the precision of the original DDL; ids are strings or
longs (the fixtures use the driver's integer keys); timestamps are kept as
``timestamp_ntz`` so that no session time-zone shift happens on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
PRICE = T.DecimalType(10, 2)
PCT = T.DecimalType(5, 2)
TOTAL = T.DecimalType(22, 2)   # type of every reported sum (Spark sum of decimal(12,2))
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


WASHES = T.StructType([
    _f("id", T.StringType(), False), _f("service_id", T.LongType(), False),
    _f("car_type_id", T.StringType()), _f("staff_id", T.LongType()),
    _f("customer_id", T.LongType()), _f("unit_price", MONEY, False),
    _f("commission_pct", PCT, False), _f("commission_amount", MONEY, False),
    _f("profit_amount", MONEY, False), _f("is_free", T.BooleanType(), False),
    _f("promo_id", T.StringType()), _f("vehicle_reg", T.StringType()),
    _f("washed_at", TS, False),
])

EXPENSES = T.StructType([
    _f("id", T.LongType(), False), _f("category", T.StringType(), False),
    _f("note", T.StringType()), _f("amount", MONEY, False), _f("spent_at", TS, False),
    _f("created_by_user_id", T.StringType()), _f("created_at", TS),
])

WINNERS = T.StructType([
    _f("id", T.LongType(), False), _f("draw_date", T.DateType(), False),
    _f("customer_id", T.LongType()), _f("vehicle_reg", T.StringType()),
    _f("customer_phone", T.StringType()), _f("customer_name", T.StringType()),
    _f("status", T.StringType(), False), _f("created_at", TS), _f("approved_at", TS),
    _f("note", T.StringType()), _f("used_at", TS),
])


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add missing ones.

    A missing column becomes its default (``defaults[name]``) or NULL.  This is
    the batch form of ``ADD COLUMN IF NOT EXISTS ... DEFAULT``.
    """
    defaults = defaults or {}
    present = set(df.columns)
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in present:
            c = F.col(field.name).cast(field.dataType)
        else:
            c = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name in defaults:
            c = F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType))
        cols.append(c.alias(field.name))
    return df.select(*cols)
