"""Typed reads of the driver's parquet tables.

Schemas are declared and compared with the file's own (its footer), so a
drifted file fails before a job starts: a missing or retyped column raises,
further columns are ignored.  Such a read sees the footer of one file;
``check_files`` finds the files of a table that lack a column.  Reading with an explicit schema keeps column
pruning and filter pushdown: only the columns a job selects reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
}


class SchemaDrift(ValueError):
    """A file's columns are not the declared ones."""


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read Parquet with a declared schema; raise ``SchemaDrift`` if the file has other columns or types."""
    if wrong := differences(spark, path, schema):
        raise SchemaDrift(f"{path}: {wrong}")
    return spark.read.schema(schema).parquet(path)


def differences(spark: SparkSession, path: str, schema: T.StructType) -> str:
    """How the footer Spark reads at ``path`` differs from the declared columns; empty if it does not."""
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    return "; ".join(f"{f.name}: {f.dataType.simpleString()} declared, {found[f.name].simpleString() if f.name in found else 'missing'} found"
                     for f in schema.fields if found.get(f.name) != f.dataType)


def file_fill(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``file, column, n_rows, n_values`` for each file and declared column: its rows and those where the column is not NULL.

    One scan with partial counts per file, so as many rows are shuffled as there are files and tasks.
    A file with a type that cannot be read as the declared one fails the job, which names the file."""
    counts = [F.count(F.col(f"`{f.name}`")).alias(f"v{i}") for i, f in enumerate(schema.fields)]
    per_file = (spark.read.schema(schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
                .agg(F.count(F.lit(1)).alias("n_rows"), *counts))
    columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"v{i}").alias("n_values")) for i, f in enumerate(schema.fields)])
    return per_file.select("file", "n_rows", F.explode(columns).alias("c")).select("file", "c.column", "n_rows", "c.n_values")


def check_files(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Raise ``SchemaDrift`` that names every file of ``path`` whose columns are not the declared ones.

    A missing column reads as NULL, so only files with a column of NULLs alone can lack one; the
    footers of these files, and no others, are read one by one.  It scans the declared columns: meant
    to run once after a load.  Files without rows pass."""
    suspects = file_fill(spark, path, schema).filter("n_values = 0").select("file").distinct().orderBy("file")
    wrong = [f"{r['file']}: {w}" for r in suspects.toLocalIterator() if (w := differences(spark, r["file"], schema))]
    if wrong:
        raise SchemaDrift("\n".join(wrong))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table with its declared schema."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = DRIVER_SCHEMAS.get(name)
    return read_typed(spark, path, schema) if schema is not None else spark.read.parquet(path)
