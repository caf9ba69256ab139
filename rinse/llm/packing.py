"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents (pieces) of one length are interchangeable, and so are sequences
with one amount of room.  Both are therefore kept as runs, sorted by size:
``n`` documents of a size with consecutive ranks, ``n`` gaps of a size with
consecutive sequence numbers.  There are at most as many document runs as
sizes, whatever the number of documents.

A round matches every waiting document with its successor, the smallest gap
that holds it: going down the merged sizes, a gap is put on a stack and a
document takes the top one.  Conflicts over a gap are settled by rank: larger
documents go first, and of one size the lower rank.  Matches inside a range of
sizes do not depend on other ranges, so tasks sweep ranges side by side, and
what is left over of neighbouring ranges is swept again, half as many ranges
at a time, until one is left.  Then all gaps are updated and the next round
begins.  When no document fits, the largest waiting ones open new sequences.

Only runs reach the driver between rounds.  The documents themselves stay
distributed: each gets its rank among the documents of its size from a count
per partition, and finds its run, and so its place, by a join.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from heapq import merge

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from rinse.llm.common import durable, texts

CAPACITY = 1024
END = 2
RANGES = 8
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Run = tuple[int, int, int]  # size, first rank or sequence, how many


@lru_cache(maxsize=1)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file for the faster library (equal ids; see the tests)."""
    t = Tokenizer.from_file(path)
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    alphabet = sorted(ByteLevel.alphabet())
    # the alphabet shows printable bytes as themselves, the others in byte order from U+0100 on
    shown = [c for c in alphabet if ord(c) < 256]
    hidden = sorted(set(range(256)) - set(map(ord, shown)))
    byte = {c: ord(c) for c in shown} | {c: b for c, b in zip((c for c in alphabet if ord(c) >= 256), hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in t.get_vocab(with_added_tokens=False).items() if token not in special}
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def own_library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def ids_of(path: str, text: str) -> list[int]:
    """The ids of a whole text.  The faster library gives up on very long runs of white space; the tokenizer's own takes those texts."""
    try:
        return encoding(path).encode(text, allowed_special="all")
    except ValueError:
        return own_library(path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, k bigint"


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = array("I", ids_of(path, text))
                ids.append(end)
                raw = ids.tobytes()
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, i, start, n, zlib.crc32(raw[4 * start:4 * (start + n)]), part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])
    return run


def sweep(docs: list[Run], gaps: list[Run]) -> tuple[list[tuple[int, int, int, int, int]], list[Run], list[Run]]:
    """Matches ``(size, rank, n, gap, sequence)`` and what is left of runs sorted by falling size."""
    matches, left, stack = [], [], []
    # at one size the gaps come first: they hold documents of that very size
    for _, kind, run in merge(((-g[0], 0, g) for g in gaps), ((-d[0], 1, d) for d in docs)):
        if kind == 0:
            stack.append(run)
            continue
        size, rank, n = run
        while n and stack:
            gap, seq, m = stack.pop()
            k = min(n, m)
            matches.append((size, rank, k, gap, seq))
            rank, n = rank + k, n - k
            if m > k:
                stack.append((gap, seq + k, m - k))
        if n:
            left.append((size, rank, n))
    return matches, left, stack


def _sweep_part(frames):
    rows = pd.concat(frames)
    pick = lambda kind: sorted(map(tuple, rows[rows.kind == kind][["size", "first", "n"]].values.tolist()), key=lambda r: (-r[0], r[1]))
    matches, docs, gaps = sweep(pick(1), pick(0))
    out = [(2, *m) for m in matches] + [(1, *d, 0, 0) for d in docs] + [(0, *g, 0, 0) for g in gaps]
    yield pd.DataFrame(out, columns=["kind", "size", "first", "n", "gap", "seq"])


def distributed_sweep(spark: SparkSession, docs: list[Run], gaps: list[Run], ranges: int):
    """One round's matching: ranges of sizes swept by tasks, leftovers by half as many, down to one."""
    matches: list = []
    while True:
        rows = sorted([(0, *g) for g in gaps] + [(1, *d) for d in docs], key=lambda r: (-r[1], r[0], r[2]))
        width = max(1, -(-len(rows) // ranges))
        sizes = [r[1] for r in rows]
        bounds = sorted({sizes[i] for i in range(width, len(rows), width)}, reverse=True)
        where = np.searchsorted(-np.array(bounds or [0]), -np.array(sizes), side="right") if bounds else np.zeros(len(rows), int)
        frame = pd.DataFrame(rows, columns=["kind", "size", "first", "n"]).assign(range=where)
        parts = [p.drop(columns="range") for _, p in frame.groupby("range")]
        swept = spark.sparkContext.parallelize(parts, len(parts)).mapPartitions(
            lambda part: [x for f in part for x in next(_sweep_part([f])).itertuples(index=False, name=None)]).collect()
        matches += [x[1:] for x in swept if x[0] == 2]
        docs = sorted((x[1:4] for x in swept if x[0] == 1), key=lambda r: (-r[0], r[1]))
        gaps = sorted((x[1:4] for x in swept if x[0] == 0), key=lambda r: (-r[0], r[1]))
        if len(parts) == 1 or not docs or not gaps:
            return matches, docs, gaps
        ranges = max(1, ranges // 2)


def merge_runs(runs: list[Run]) -> list[Run]:
    """Sorted by falling size, neighbours of one size put together."""
    out: list[Run] = []
    for size, first, n in sorted(runs, key=lambda r: (-r[0], r[1])):
        if out and out[-1][0] == size and out[-1][1] + out[-1][2] == first:
            out[-1] = (size, out[-1][1], out[-1][2] + n)
        else:
            out.append((size, first, n))
    return out


def open_sequences(docs: list[Run], count: int, seq: int, capacity: int):
    """The ``count`` largest documents open sequences from number ``seq`` on: places, waiting documents, gaps, next number."""
    placed, left, gaps = [], [], []
    for size, first, n in docs:
        k = min(n, count)
        if k:
            placed.append((size, first, k, capacity, seq))
            gaps += [(capacity - size, seq, k)] * (size < capacity)
            seq, count = seq + k, count - k
        if n > k:
            left.append((size, first + k, n - k))
    return placed, left, gaps, seq


def plan(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, ranges: int = RANGES):
    """Places ``(size, rank, n, gap, sequence)`` for all documents, from the number of documents of each size."""
    docs = [(s, 0, n) for s, n in sorted(counts.items(), reverse=True)]
    # two documents over half the capacity never share a sequence
    placed, docs, gaps, seq = open_sequences(docs, sum(n for s, _, n in docs if 2 * s > capacity), 0, capacity)
    while docs:
        matches, docs, gaps = distributed_sweep(spark, docs, merge_runs(gaps), ranges)
        placed += matches
        gaps += [(gap - size, s, n) for size, _, n, gap, s in matches if gap > size]
        docs, gaps = merge_runs(docs), merge_runs(gaps)
        if docs and not any(g[0] >= docs[-1][0] for g in gaps):
            need = -(-sum(s * n for s, _, n in docs) // capacity)
            new, docs, opened, seq = open_sequences(docs, need, seq, capacity)
            placed, gaps = placed + new, gaps + opened
    return placed


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    A document is its ids and then ``end``; a NULL or empty text is only
    ``end``.  Documents over ``capacity`` tokens are cut into pieces of
    ``capacity`` tokens, the first of which may be shorter.  Sequences are
    filled from offset 0 without holes and hold ``capacity`` tokens at most.
    NULL or repeated ids keep their rows; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = durable(texts(docs, id_col, text_col).mapInArrow(_pieces(tokenizer_path, capacity, end), PIECE))
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_part.select("part", "length", before.alias("before"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.createDataFrame(plan(spark, counts, capacity),
                                   "length bigint, rank bigint, n bigint, gap bigint, seq bigint")
    p = F.broadcast(places.withColumnsRenamed({"length": "size", "n": "many"}))  # rounds x capacity rows at most
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("r", F.col("k") + F.col("before"))
    return (ranked.join(p, (F.col("length") == F.col("size")) & (F.col("r") >= F.col("rank")) & (F.col("r") < F.col("rank") + F.col("many")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("r") - F.col("rank")).alias("sequence_id"),
                    (F.lit(capacity) - F.col("gap")).alias("offset")))
