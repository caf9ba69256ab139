"""Exact duplicate removal by progressive refinement (DataFrame functions only).

Rows are equal when their texts are identical after every run of white space
is replaced by one space.  Three ever finer groupings decide that:

1. by length in bytes: a length that occurs once ends there;
2. by length and the hash of a short prefix, among what is left;
3. by the SHA-256 of the whole text, for the members of groups that survive.

Steps 1 and 2 work on a table of (id, length, prefix hash).  Step 3 hashes the
text in the scan, so no text is ever shuffled: only ids, lengths and hashes
move.  Every grouping is pre-aggregated per task.  The group table that the
rows are joined back to is written first and has one row per group, so a group
with a third of all rows only makes a skewed left side, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import SPACE_CLASS, durable, texts, without_copies

PREFIX_CHARS = 256


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every input row.

    Of equal texts the smallest id stays.  A NULL text equals an empty one.  A
    NULL id sorts after every other and is kept only if its whole group has
    none.  Rows that repeat an id and a text share one result.  Other columns
    are ignored; an empty table gives an empty result.  ``text_sha256`` is
    filled for members of surviving groups, and for every row with
    ``digest_all``.
    """
    base = texts(docs, id_col, text_col).select("doc_id", single_spaced(F.col("text")).alias("norm"))
    keyed = base.select("doc_id", "norm", F.octet_length("norm").alias("len"),
                        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))

    # counted per task first, so that copies of one text are one row here
    seen = durable(keyed.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")))
    lengths = seen.groupBy("len").agg(F.sum("n").alias("n")).filter("n > 1").select("len")
    survivors = (seen.join(lengths, "len", "left_semi").filter("n > 1")
                     .select("len", "prefix", F.lit(True).alias("open")))

    flagged = keyed.select("doc_id", "len", "prefix", F.sha2("norm", 256).alias("sha")) if digest_all else (
        keyed.join(survivors.select("len", "prefix"), ["len", "prefix"], "left_semi")
             .select("doc_id", "len", "prefix", F.sha2("norm", 256).alias("sha"))
        .unionByName(keyed.join(survivors, ["len", "prefix"], "left_anti")
                          .select("doc_id", "len", "prefix", F.lit(None).cast("string").alias("sha"))))
    full = durable(flagged.join(survivors, ["len", "prefix"], "left"))

    # written, so that the join has a plain exchange on both sides, which adaptive execution can split
    groups = durable(full.filter("open").groupBy("len", "prefix", "sha")
                         .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    grouped = full.filter("open").join(groups, ["len", "prefix", "sha"])
    single = full.filter("open IS NULL").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint")})
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256")]
    return grouped.select(*cols).unionByName(single.select(*cols))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest id, for each group of equal texts.

    Rows are told apart by id and text: a row that shares only its id with a
    dropped one stays.  Of rows that repeat the smallest id one stays, and of a
    group without ids one.  Very long texts are hashed in the scan; only rows
    whose id may be on the list of copies are shuffled.
    """
    copies = exact_dedup(docs, id_col, text_col, digest_all=True).filter("group_size > 1")
    return without_copies(docs, copies.select("doc_id", F.col("text_sha256").alias("digest"), "kept"), id_col, text_col,
                          lambda text: F.sha2(single_spaced(text), 256))


ORACLE = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
per_text AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT n.doc_id, p.keep_id, CAST(p.group_size AS BIGINT) AS group_size,
       n.doc_id = p.keep_id AS kept, sha256(n.t) AS text_sha256
FROM norm n JOIN per_text p ON n.t = p.t
"""
