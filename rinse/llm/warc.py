"""WARC archives: write records, read them back by boundary-chain verification.

Writing.  Payloads are compared by SHA-1 digest and length; the smallest id of
equal payloads becomes a ``response`` record, the others ``revisit`` records
that refer to it.  Spark's text writer puts the records into files, one row a
record, with the blank lines that end a record as the row separator.

Reading.  A text may contain anything, so a magic string does not make a
record.  Spark's text reader splits the files at every magic string, in many
tasks at once, and each split piece is a candidate: if it starts like a
record, its header gives the offset at which the next record must start.
Offsets come from the lengths of the pieces, summed within each input split
and then over the splits of a file.  From the file's start, pointers are
followed by pointer jumping: every candidate doubles the distance of its
jump per round, and what the start reaches in 1, 2, 4, ... steps is marked, so
a file of n records takes log2(n) rounds.  Candidates that are never reached
were magic strings inside payloads; their bytes belong to the record around
them, whose payload is put together again from its pieces.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinse.llm.common import durable, shuffle_parts
from rinse.session import shared_dir

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
HEAD_END = "\r\n\r\n"
DIGEST = "WARC-Payload-Digest: sha1:"
LENGTH = "X-Payload-Length: "


def _digests(batches):
    for b in batches:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("url"), b.column("payload"), pa.array([len(x) for x in raw], pa.int64()),
             pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw], pa.string())],
            ["id", "url", "payload", "bytes", "digest"])


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """``id, record`` texts: the header, a blank line and, in a response, the payload.

    A NULL payload is empty, a NULL URL is written as an empty target, a NULL
    id as an empty record id.  Line breaks in a URL are written as spaces.
    Rows that repeat an id and a payload are written once each, all alike.
    """
    p = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    d = p.mapInArrow(_digests, "id bigint, url string, payload string, bytes bigint, digest string")
    first = durable(d.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("digest", "bytes", "first"))
    j = d.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name("id"), F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", " "),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), name("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\n" + DIGEST), "digest", F.lit("\r\n" + LENGTH), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"),
        F.lit(HEAD_END))
    return j.select("id", F.when(revisit, head).otherwise(F.concat(head, "payload")).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0, records_per_file: int = 50_000) -> None:
    """Write ``records`` as files under ``path``."""
    (records(pages, id_col, url_col, payload_col, min_revisit_bytes).select(F.col("record").alias("value"))
     .write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path))


def _locate(batches):
    """Offsets within the input split, and what a piece's header says."""
    base: dict = {}
    for b in batches:
        out = []
        for file, block, raw in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("raw").to_pylist()):
            at = base.get((file, block), 0)
            base[file, block] = at + len(raw) + len(MAGIC)
            out.append((file, block, at, len(raw), *_header(raw), raw))
        cols = list(zip(*out)) or [()] * 7
        types = (*[pa.int64()] * 6, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "block", "at", "size", "head", "body", "raw"])


def _header(raw: bytes) -> tuple[int | None, int | None]:
    """Bytes of the header (after the magic) and of the body, if this starts like a record."""
    end = raw.find(HEAD_END.encode())
    if end < 0:
        return None, None
    for line in raw[:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return end + len(HEAD_END), int(value)
    return None, None


def pinned_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose input splits stay as they are now.

    Spark computes the splits of a scan anew for each execution, from settings
    of the session that opened the files and the number of cores registered at
    that moment.  Here that number is fixed, and nobody else changes the settings."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k) or not k.startswith("spark."):
            own.conf.set(k, v)
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.conf.get("spark.sql.files.minPartitionNum", None) or cores))
    return own


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, size, head, body, raw``: every magic string's piece and where its record would end.

    ``file`` is the hash of the file's path, ``block`` the start of the input
    split, ``at`` the piece's place within it.  Every execution has the same
    splits.
    """
    # Spark's text reader drops nothing but the separator, here the magic string
    pieces = (pinned_session(spark).read.option("lineSep", MAGIC).text(path)
              .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").cast("binary").alias("raw")))
    return pieces.mapInArrow(_locate, "file bigint, block bigint, at bigint, size bigint, head bigint, body bigint, raw binary")


def placed(pieces: DataFrame, bases: DataFrame) -> DataFrame:
    """``pieces`` with their offset in the file; a piece of a split that ``bases (file, block, base)`` lacks is an error.

    A piece begins right after a magic string, a record at the magic string.
    """
    # the random part keeps the optimizer from evaluating the error, or from taking the outer join for an inner one
    lost = F.raise_error(F.concat(F.lit("an input split of the archives was not there when offsets were counted: "), F.col("block").cast("string"),
                                  F.substring(F.uuid(), 1, 0))).cast("bigint")
    return (bases.join(pieces, ["file", "block"], "right").withColumn("off", F.coalesce("base", lost) + F.col("at") - len(MAGIC))
            .drop("block", "at", "base"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, off, header, payload`` (both binary) of every record of the archives under ``path``.

    A file that does not start with a record gives none; a chain that meets an
    offset without a record ends there.  Chains are followed on a table of
    offsets only.  The archives are then read a second time, in the same input
    splits: a piece that is a
    whole reachable record is one already, and only the pieces of records with
    magic strings inside are brought together.
    """
    pieces = candidates(spark, path)
    places = durable(pieces.drop("raw"), spark=spark)
    # a split starts after the separator that ends the pieces before it, so its place is the sum of what they hold
    splits = places.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = durable(splits.select("file", "block", before.alias("base")))

    known = durable(placed(places, bases))
    nxt = F.col("off") + len(MAGIC) + F.col("head") + F.col("body") + len(RECORD_END)
    chain = durable(known.filter("head IS NOT NULL AND off >= 0").select("file", "off", nxt.alias("nxt")))
    real = reachable(chain).join(chain, ["file", "off"])

    owner = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.when(F.col("nxt").isNotNull(), F.struct(F.col("off").alias("start"), F.col("nxt").alias("end")))
    owned = (known.join(real, ["file", "off"], "left").withColumn("own", F.last(mine, ignorenulls=True).over(owner))
             .select("file", "off", "nxt", "size", F.col("own.start").alias("start"), F.col("own.end").alias("end")))
    whole = F.col("nxt").isNotNull() & (F.col("off") + len(MAGIC) + F.col("size") >= F.col("nxt"))
    parted = durable(owned.filter(~whole).select("file", "off", "start", "end"))
    # an open record's own piece is parted too, so all its pieces meet here
    apart = placed(pieces, bases).join(parted, ["file", "off"])
    joined = (apart.filter("start IS NOT NULL").groupBy("file", "start", "end")
              .agg(F.sort_array(F.collect_list(F.struct("off", "raw"))).alias("parts")).select("file", "start", "end", "parts"))
    one = (placed(pieces, bases).join(parted.select("file", "off"), ["file", "off"], "left_anti")
           .select("file", F.col("off").alias("start"), nxt.alias("end"), F.array(F.struct("off", "raw")).alias("parts")))
    return one.unionByName(joined).mapInArrow(_assemble, "file bigint, off bigint, header binary, payload binary")


def reachable(chain: DataFrame) -> DataFrame:
    """``file, off`` of the records that the first offset of each file leads to, by pointer jumping.

    ``chain`` has ``file, off, nxt``.  After round k the marked records are
    those within 2^k steps of a file's start, and every pointer spans 2^k.
    """
    marked = chain.filter("off = 0").select("file", "off")
    jumps, count = chain, -1
    while True:
        step = marked.join(jumps, ["file", "off"]).select("file", F.col("nxt").alias("off")).join(chain.select("file", "off"), ["file", "off"], "left_semi")
        marked = durable(marked.unionByName(step).distinct())
        now = marked.count()
        if now == count:
            return marked
        count = now
        jumps = durable(jumps.alias("a").join(jumps.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.nxt") == F.col("b.off")))
                        .select("a.file", "a.off", "b.nxt"))


def _assemble(batches):
    for b in batches:
        out = []
        for file, start, nxt, parts in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end", "parts"))):
            if nxt <= start + len(MAGIC) or parts[0]["off"] != start:
                continue
            raw = MAGIC.encode().join(p["raw"] for p in parts)
            end = raw.find(HEAD_END.encode()) + len(HEAD_END)
            out.append((file, start, raw[:end], raw[end:nxt - start - len(MAGIC) - len(RECORD_END)]))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                          pa.array(cols[3], pa.binary())], ["file", "off", "header", "payload"])


def _described(batches):
    """One line per record read: ids and type from the header, the payload checked against its digest."""
    for b in batches:
        out = []
        for head, payload in zip(b.column("header").to_pylist(), b.column("payload").to_pylist()):
            f = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
            page, refers = ((f.get(k) or "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
            kind, digest, size = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
            if kind == "response" and (size, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                raise ValueError(f"record {page}: the payload read back is not the one written")
            out.append((int(page) if page else None, size, digest, kind, int(refers) if kind == "revisit" else None))
        cols = list(zip(*out)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and describe the records read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row
    per input row; see ``records`` for NULLs.  An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    return read_archives(spark, path).mapInArrow(
        _described, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
