"""Token counts through a compiled transducer, chunked by a parallel prefix scan.

A text of up to ``CHUNK`` characters is read in one go.  A longer one is cut
into chunks that separate tasks read at the same time: each gives its state
map, from every state it may be entered in to the state it ends in and the
tokens it emits.  Maps of neighbouring chunks compose to the map of both;
``FAN`` neighbours at a time are composed until one map per text is left, and
its value at the initial state is the count.  No task holds a whole long text
or more than ``FAN`` maps.

The entry states of a chunk come from the characters in front of it: a space
there fixes the state, else every state reached from a start inside that
context is a candidate.  Should the true state be none of them, the text's map
comes out empty and the text is read once from its beginning instead.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import durable, shuffle_parts, texts
from rinse.llm.piece_transducer import PieceTransducer

CHUNK = 32_768
CONTEXT = 64
FAN = 32


@lru_cache(maxsize=1)
def transducer(path: str) -> PieceTransducer:
    """One per Python worker."""
    return PieceTransducer(path)


def _counts(path: str):
    def run(batches):
        machine = transducer(path)
        for b in batches:
            counts = [machine.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_bytes"),
                                              pa.array(counts, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])
    return run


def _maps(path: str):
    """The state map of each chunk: entry states, end states and emitted tokens."""
    def run(batches):
        machine = transducer(path)
        for b in batches:
            out = []
            for first, context, text in zip(*(b.column(c).to_pylist() for c in ("first", "context", "text"))):
                starts = [machine.initial] if first else machine.entries(context)
                out.append([(repr(s.key), repr(end.key), n) for s in starts for end, n in [machine.read(s, text)]])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("idx"), *(pa.array([[m[k] for m in x] for x in out], t) for k, t in
                                                     enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))))],
                ["row", "idx", "entry", "leave", "emitted"])
    return run


def compose(rows: pd.DataFrame) -> pd.DataFrame:
    """The map of up to ``FAN`` neighbouring chunks; entries that lead out of a domain go."""
    rows = rows.sort_values("idx")
    whole = None
    for entry, leave, n in zip(rows["entry"], rows["leave"], rows["emitted"]):
        step = dict(zip(entry, zip(leave, n)))
        whole = step if whole is None else {s: (step[e][0], k + step[e][1]) for s, (e, k) in whole.items() if e in step}
    return pd.DataFrame({"row": [rows["row"].iloc[0]], "idx": [rows["idx"].iloc[0] // FAN], "entry": [list(whole)],
                         "leave": [[e for e, _ in whole.values()]], "emitted": [[int(k) for _, k in whole.values()]]})


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every input row.

    Counts equal those of the sentencepiece model at ``tokenizer_path`` without
    begin or end tokens.  A NULL or empty text has 0 bytes and 0 tokens.  NULL
    or repeated ids keep their rows (long texts are numbered once and written
    with their numbers); other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    d = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text",
                                             F.octet_length("text").cast("bigint").alias("n_bytes"))
    count_schema = d.drop("text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema
    length = F.char_length("text")
    short = d.filter(length <= chunk).mapInArrow(_counts(tokenizer_path), count_schema)

    # written with their numbers: another run over docs might number the rows otherwise
    long = durable(d.filter(length > chunk))
    at = F.col("idx") * chunk
    chunks = (long.withColumn("idx", F.explode(F.expr(f"sequence(0, (char_length(text) - 1) div {chunk})")))
              .select("row", "idx", (F.col("idx") == 0).alias("first"),
                      F.substring("text", F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))).alias("context"),
                      F.substring("text", at + 1, F.lit(chunk)).alias("text"))
              .repartition(shuffle_parts(spark), "row", "idx"))
    map_schema = "row bigint, idx bigint, entry array<string>, leave array<string>, emitted array<bigint>"
    maps = durable(chunks.mapInArrow(_maps(tokenizer_path), map_schema))
    left = maps.agg(F.max("idx")).first()[0] or 0
    while left:
        maps = maps.groupBy("row", F.expr(f"idx div {FAN}").alias("group")).applyInPandas(
            lambda rows: compose(rows.drop(columns="group", errors="ignore")), map_schema)
        left //= FAN
    start = repr(1)  # the key of the initial state
    total = maps.select("row", F.element_at(F.map_from_arrays("entry", "emitted"), F.lit(start)).alias("emitted"))
    scanned = durable(long.drop("text").join(total, "row", "left"))
    done = scanned.filter("emitted IS NOT NULL").select("row", "doc_id", "n_bytes", (F.col("emitted") + 1).alias("n_tokens"))
    again = long.join(scanned.filter("emitted IS NULL").select("row"), "row", "left_semi") \
                .mapInArrow(_counts(tokenizer_path), count_schema)
    return (short.unionByName(done).unionByName(again)
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
