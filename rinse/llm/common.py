"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.session import shared_dir

#: The white space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str = "step", spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there, in the session ``spark`` if given.

    Used for intermediate tables that several later jobs read; it cuts the
    lineage, so a lost executor never re-runs the text scan.  Unlike a
    checkpoint, the table read back brings no constraints of its old plan
    along, which in loops would make planning ever slower.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only: a NULL text is empty, other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


MAP_BITS = 32_768  # of one bitmap, fixed by Spark's bitmap functions
MOST_MAPS = 4_096
BITS_PER_KEY = 32


def maybe_in(rows: DataFrame, col: str, keys: DataFrame, n_keys: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where ``rows[col]`` is surely not among ``keys[col]``.

    The keys set bits of a hashed bitmap of ``BITS_PER_KEY`` bits a key and at
    most ``MOST_MAPS`` pieces of 4 KB (16 MB), so it may be broadcast whatever
    the data; with very many keys it only lets more rows pass as possible."""
    maps = max(1, min(MOST_MAPS, -(-n_keys * BITS_PER_KEY // MAP_BITS)))
    bit = F.pmod(F.xxhash64(F.col(col)), F.lit(maps * MAP_BITS)) + 1
    pieces = (keys.select(bit.alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_map")))
    at = F.bitmap_bit_position("_b")
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.withColumn("_b", bit).withColumn("_piece", F.bitmap_bucket_number("_b"))
            .join(F.broadcast(pieces), "_piece", "left").withColumn(flag, found).drop("_b", "_piece", "_map"))


def without_copies(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with those rows of ``verdict (doc_id, digest, kept)`` that it keeps, once each, and all rows that are not in it.

    ``verdict`` has a row for each row that belongs to a group of several; a row
    is known by its id, NULL included, and the ``digest`` of its text.  Of rows
    that repeat both, the one with the smallest text stays.  Column names of
    ``docs`` may hold dots or equal those used here.

    The keys that need action are written first; a bitmap of their ids tells
    most rows that none concerns them.  Of the others only ids and digests are
    compared with the keys, and a text moves only where its row may stay."""
    keys = durable(verdict.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                   .filter("NOT kept OR n > 1"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    flagged = maybe_in(rows, "doc_id", keys, keys.count(), "maybe")
    suspects = flagged.filter("maybe").drop("maybe")
    known = suspects.select("doc_id", digest(F.col("t")).alias("digest"))
    clear = durable(known.join(keys, _same(known, keys), "left_anti").distinct())
    out = flagged.filter("NOT maybe").select("row").unionByName(_hits(suspects, clear, digest).select("row"))
    repeated = keys.filter("kept")
    if not repeated.isEmpty():
        out = out.unionByName(_hits(suspects, repeated, digest)
                              .groupBy("doc_id", "digest").agg(F.min_by("row", "t").alias("row")).select("row"))
    return out.select("row.*")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])


def _hits(rows: DataFrame, keys: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``rows (doc_id, t, row)`` whose id and digest are among ``keys``."""
    near = maybe_in(rows, "doc_id", keys, keys.count(), "near").filter("near").withColumn("digest", digest(F.col("t")))
    return near.join(keys, _same(near, keys), "left_semi")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
