"""Data-quality jobs (section 2.10 of the survey).

The reference rejects one bad row at write time (validation middleware and
table constraints).  Over tables these become split-or-report jobs: every
check is one pass with built-in expressions; counts come from a single
aggregate, duplicates and orphans from a grouped count and an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.operators.ordered import ordinal
from rinse.sources.sinks import materialise


def validation_errors(strict: bool = False, service="service_id", staff="staff_id",
                      car_type="car_type_id", plate="vehicle_reg") -> Column:
    """Array of all messages for a new sale (empty when valid)."""
    m = C.VALIDATION_MESSAGES
    norm = X.plate(plate)
    checks = [
        F.when(norm == "", F.lit(m["plate"]))
         .when(~X.plate_valid(norm, strict), F.lit(m["plate_format"])),
        F.when(F.col(service).isNull(), F.lit(m["service"])),
        F.when(F.col(staff).isNull(), F.lit(m["staff"])),
        F.when(F.col(car_type).isNull(), F.lit(m["car_type"])),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_washes(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """q1: split into (valid rows with the normalised plate, rejects with all messages)."""
    d = df.withColumn("errors", validation_errors(strict))
    valid = d.filter(F.size("errors") == 0).drop("errors").withColumn("vehicle_reg", X.plate("vehicle_reg"))
    return valid, d.filter(F.size("errors") > 0)


def validation_counts(df: DataFrame, strict: bool = False) -> DataFrame:
    """q1 report: number of rows per message, and of valid rows under 'OK'."""
    d = df.select(validation_errors(strict).alias("errors"))
    msgs = d.select(F.explode(F.when(F.size("errors") == 0, F.array(F.lit("OK"))).otherwise(F.col("errors")))
                    .alias("message"))
    return msgs.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """q2: one row, one column per rule: rows violating it.  Like a SQL CHECK, a rule
    that evaluates to NULL passes."""
    return df.agg(*[F.count(F.when(~rule, 1)).alias(f"bad_{name}") for name, rule in rules.items()])


def wash_rules(codes=(C.PROMO_DAILY_DRAW, C.PROMO_FEATURED, C.PROMO_LOYALTY, C.PROMO_RANDOM)) -> dict[str, Column]:
    """The constraints of the sales table as column rules."""
    return {
        "price_nonneg": F.col("unit_price") >= 0,
        "pct_range": (F.col("commission_pct") >= 0) & (F.col("commission_pct") <= 100),
        "amounts_add_up": (F.col("commission_amount") + F.col("profit_amount")) == F.col("unit_price"),
        "promo_known": F.col("promo_id").isin(*codes),
    }


def check_unique(df: DataFrame, keys: list[str], where: Column | None = None,
                 casefold: bool = False) -> DataFrame:
    """q3: keys held by more than one row.  Rows with a NULL key part never clash
    (as in a unique index); ``where`` makes it a partial index; ``casefold`` compares
    lower-cased text."""
    d = df if where is None else df.filter(where)
    cols = [F.lower(F.col(k)).alias(k) if casefold else F.col(k) for k in keys]
    d = d.select(*cols).dropna(subset=keys)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


@dataclass(frozen=True)
class UniqueIndex:
    """A unique index: its name, the SQL expressions of its key and the rows it is for (a partial index)."""
    name: str
    key: tuple[str, ...]
    where: str | None = None


#: The unique indexes of the schema by table; composite, partial and folded ones among them.
UNIQUE_INDEXES: dict[str, tuple[UniqueIndex, ...]] = {
    "services": (UniqueIndex("services_name", ("name",)), UniqueIndex("services_name_folded", ("lower(name)",))),
    "prices": (UniqueIndex("prices_service_car_type", ("service_id", "car_type_id")),),
    "rates": (UniqueIndex("rates_role", ("role",)),),
    "customers": (UniqueIndex("customers_phone", ("phone",), "phone IS NOT NULL"),),
    "candidates": (UniqueIndex("candidates_day_customer_plate", ("draw_date", "customer_id", "vehicle_reg")),),
    "winners": (UniqueIndex("winners_approved_day", ("draw_date",), "status = 'APPROVED'"),),
    "washes": (UniqueIndex("washes_id", ("id",)),),
}


def index_clashes(df: DataFrame, indexes: Sequence[UniqueIndex]) -> DataFrame:
    """q3 for all indexes of a table: ``index, key, n``, a row per key that more than one row holds.

    ``key`` is the key as a JSON array.  Rows with a NULL key part never clash,
    nor do rows outside a partial index.  The table is scanned once for a sketch
    that counts 64-bit key hashes per index, summed per task first; only keys of
    hashes that occur twice are built, compared in full and shuffled, in a
    second scan that reads the hashes' few rows out.  Equal hashes of different
    keys cost a row in that scan and nothing else."""
    def entry(i: UniqueIndex, *more: Column) -> Column:
        parts = [F.expr(k) for k in i.key]
        held = reduce(Column.__and__, [p.isNotNull() for p in parts])
        if i.where is not None:
            held = held & F.expr(i.where)
        return F.when(held, F.struct(F.lit(i.name).alias("index"), F.xxhash64(F.lit(i.name), *parts).alias("hash"), *[m(parts) for m in more]))

    def expanded(*more) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*[entry(i, *more) for i in indexes]))).alias("e")).select("e.*")

    suspects = expanded().groupBy("index", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("index", "hash")
    suspects = materialise(suspects, "suspects")
    key = lambda parts: F.to_json(F.array(*[p.cast("string") for p in parts])).alias("key")
    return (expanded(key).join(suspects, ["index", "hash"], "left_semi").groupBy("index", "key").agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))


def all_clashes(tables: dict[str, DataFrame], indexes: dict[str, Sequence[UniqueIndex]] = UNIQUE_INDEXES) -> DataFrame:
    """``index_clashes`` of every table that has unique indexes."""
    return reduce(DataFrame.unionByName, [index_clashes(tables[name], of) for name, of in indexes.items()])


def check_refs(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """q4: child rows whose (non-NULL) foreign key has no parent row."""
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, fk)]).distinct()
    c = child.dropna(subset=fk)
    return c.join(p, fk, "left_anti")


def assign_receipts(washes: DataFrame, existing_col: str = "receipt_no",
                    issued: DataFrame | None = None) -> DataFrame:
    """q5: give every sale without a receipt number a unique one: 'SH' + day + '-' + n,
    n counting that day's new receipts in (washed_at, id) order after the day's
    highest existing n (in ``washes`` or in the ``issued`` receipts of earlier
    batches).  Repeatable, and no single task sees a whole day."""
    d = washes.withColumn("_day", X.day("washed_at"))
    if existing_col not in d.columns:
        d = d.withColumn(existing_col, F.lit(None).cast("string"))
    have = d.filter(F.col(existing_col).isNotNull())
    need = d.filter(F.col(existing_col).isNull())
    pattern = r"^SH(\d{8})-(\d+)$"
    seen = have.select(existing_col)
    if issued is not None:
        seen = seen.unionByName(issued.select(existing_col))
    top = (seen.filter(F.col(existing_col).rlike(pattern))
           .groupBy(F.regexp_extract(existing_col, pattern, 1).alias("_dkey"))
           .agg(F.max(F.regexp_extract(existing_col, pattern, 2).cast("bigint")).alias("_base")))
    numbered = ordinal(need, ["_day"], ["washed_at", "id"], "_n")
    numbered = numbered.withColumn("_dkey", F.date_format("_day", "yyyyMMdd"))
    numbered = numbered.join(top, "_dkey", "left")
    numbered = numbered.withColumn(
        existing_col, F.concat(F.lit(C.RECEIPT_PREFIX), F.col("_dkey"), F.lit("-"),
                               (F.col("_n") + F.coalesce(F.col("_base"), F.lit(0))).cast("string")))
    cols = [c for c in d.columns if c != "_day"]
    return have.select(*cols).unionByName(numbered.select(*cols))
