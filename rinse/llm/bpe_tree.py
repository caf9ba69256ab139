"""BPE encoding and decoding, long texts by tree concatenation.

A text of up to ``LEAF`` characters is encoded in one piece.  A longer one is
cut into leaves that are encoded in parallel; neighbours are then joined level
by level.  The cut may have split a word, a character sequence that normalises
together or a special token, so around each join a window of the text is
encoded again: if on either side ``RUN`` successive tokens of the window are
the same, at the same place, as those of the half, everything beyond them
stands, and only what lies between is replaced.  If not, the window grows, in
the end to both halves.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import durable, shuffle_parts, texts
from rinse.llm.encoder import ChunkEncoder, load

LEAF = 32_768
EDGE = 1024
FIRST_WINDOW = 64
RUN = 4


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    e = ChunkEncoder(path, keep_space=False, decoded=True)
    if e.tokenizer.decoder is not None:
        raise ValueError("decoding by chunks needs a tokenizer that joins its tokens by spaces")
    return e


def digests(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _short(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [digests(b"".join([i for i, _ in x]), b" ".join([d for _, d in x if d]))
                   for x in enc.texts(b.column("text").to_pylist())]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


class Node:
    """A stretch of text with its ids, and the ends of its first and last tokens."""

    def __init__(self, text: str, ids: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail  # tail: counted from the text's end

    @classmethod
    def encode(cls, tokenizer, text: str) -> "Node":
        e = tokenizer.encode(text, add_special_tokens=False)
        ends = np.array([b for _, b in e.offsets], np.int64)
        return cls(text, np.array(e.ids, "<u4"), ends[:EDGE], len(text) - ends[-EDGE:])


def same_run(a_ids, a_ends, b_ids, b_ends, last: bool) -> tuple[int, int] | None:
    """Start in a and in b of the first (last) run of ``RUN`` equal tokens at equal places."""
    at = {}
    for j in range(len(b_ids) - RUN + 1):
        at.setdefault(int(b_ends[j]), []).append(j)
    order = range(len(a_ids) - RUN + 1)
    for i in reversed(order) if last else order:
        for j in at.get(int(a_ends[i]), ()):
            if np.array_equal(a_ids[i:i + RUN], b_ids[j:j + RUN]) and np.array_equal(a_ends[i:i + RUN], b_ends[j:j + RUN]):
                return i, j
    return None


def join(tokenizer, left: Node, right: Node) -> Node:
    """The node of ``left.text + right.text``, exactly as if encoded at once."""
    at, text, w = len(left.text), left.text + right.text, FIRST_WINDOW
    while w < max(at, len(right.text)) and w <= EDGE:
        a, b = max(at - w, 0), min(at + w, len(text))
        e = tokenizer.encode(text[a:b], add_special_tokens=False)
        ids, ends = np.array(e.ids, "<u4"), a + np.array([x for _, x in e.offsets], np.int64)
        k = len(left.tail)
        kept, start = (0, 0) if a == 0 else (None, None)
        if a and (run := same_run(ids, ends, left.ids[len(left.ids) - k:], at - left.tail, last=False)):
            start, kept = run[0] + RUN, len(left.ids) - k + run[1] + RUN
        stop, rest = (len(ids), len(right.ids)) if b == len(text) else (None, None)
        if b < len(text) and (run := same_run(ids, ends, right.ids[:len(right.head)], at + right.head, last=True)):
            stop, rest = run
        if start is not None and stop is not None and start <= stop:
            all_ids = np.concatenate([left.ids[:kept], ids[start:stop], right.ids[rest:]])
            head = np.concatenate([left.head[:kept], ends[start:stop], at + right.head[rest:]])
            # ends are known for a first and a last stretch, as far as the halves knew them
            head = head[:EDGE] if len(left.head) >= min(kept, EDGE) else left.head[:kept]
            known = len(right.ids) - rest
            tail = (np.concatenate([len(text) - ends[start:stop], right.tail[len(right.tail) - known:]])
                    if len(right.tail) >= known else right.tail[-known:])[-EDGE:]
            return Node(text, all_ids, head, tail)
        w *= 4
    return Node.encode(tokenizer, text)


NODE = "row bigint, doc_id bigint, idx bigint, text string, ids binary, head binary, tail binary"


def _leaves(path: str):
    def run(batches):
        tokenizer = load(path)
        for b in batches:
            nodes = [Node.encode(tokenizer, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("idx"), b.column("text"),
                 *(pa.array([getattr(n, f).astype(t).tobytes() for n in nodes], pa.binary())
                   for f, t in (("ids", "<u4"), ("head", "<i8"), ("tail", "<i8")))],
                ["row", "doc_id", "idx", "text", "ids", "head", "tail"])
    return run


def _pairs(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        nodes = [Node(r.text, np.frombuffer(r.ids, "<u4"), np.frombuffer(r.head, "<i8"), np.frombuffer(r.tail, "<i8"))
                 for r in rows.itertuples()]
        n = nodes[0] if len(nodes) == 1 else join(load(path), *nodes)
        return pd.DataFrame({"row": [rows["row"].iloc[0]], "doc_id": rows["doc_id"].iloc[:1].astype("Int64").tolist(),
                             "idx": [rows["idx"].iloc[0] // 2], "text": [n.text], "ids": [n.ids.astype("<u4").tobytes()],
                             "head": [n.head.astype("<i8").tobytes()], "tail": [n.tail.astype("<i8").tobytes()]})
    return run


def _roots(path: str):
    def run(batches):
        tokenizer = load(path)
        for b in batches:
            out = [digests(i, tokenizer.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False).encode())
                   for i in b.column("ids").to_pylist()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every input row.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers,
    ``decoded_sha256`` over the decoded text in UTF-8, both in lower-case hex.
    A NULL or empty text has no tokens and the digests of nothing.  NULL or
    repeated ids keep their rows; other columns are ignored; an empty table
    gives an empty result.
    """
    d = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    out = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = d.filter(F.char_length("text") <= leaf).select("doc_id", "text").mapInArrow(_short(tokenizer_path), out)
    leaves = (d.filter(F.char_length("text") > leaf)
              .withColumn("idx", F.explode(F.expr(f"sequence(0L, (char_length(text) - 1) div {leaf})")))
              .withColumn("text", F.substring("text", (F.col("idx") * leaf + 1).cast("int"), F.lit(leaf)))
              .select("row", "doc_id", "idx", "text").repartition(shuffle_parts(docs.sparkSession), "row", "idx"))
    nodes = durable(leaves.mapInArrow(_leaves(tokenizer_path), NODE))
    left = nodes.agg(F.max("idx")).first()[0] or 0
    while left:
        nodes = nodes.withColumn("pair", F.expr("idx div 2")).groupBy("row", "pair").applyInPandas(_pairs(tokenizer_path), NODE)
        left //= 2
    return short.unionByName(nodes.select("doc_id", "ids").mapInArrow(_roots(tokenizer_path), out))
