"""Removed bytes against a table of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from rinse.llm import repeat_bytes as rb

DDL = "doc_id bigint, text string, pack string, bucket int"


def brute(rows, window=50):
    first: dict[bytes, int] = {}
    big = 1 << 63
    docs = sorted(((big if i is None else i, (t or "").encode()) for i, t in rows), key=lambda x: x[0])
    for i, b in docs:
        for p in range(len(b) - window + 1):
            first.setdefault(b[p:p + window], i)
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < i:
                gone[p:p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == big else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in rb.repeat_bytes(df, **more).collect()), key=repr)


@pytest.mark.parametrize("hot", [rb.HOT, 1])     # 1: every open string is cut into windows
def test_small_table(spark, hot):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs, hot=hot) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("window", [50, 33])
def test_odd_rows(spark, window):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab\x00é ") for _ in range(n))
    passage, short = word(90), word(49)
    rows = [(1, None), (2, ""), (3, passage), (4, "x" + passage + "y"), (5, passage[:60] + "Q" + passage[60:]), (None, passage), (None, passage + "z"),
            (7, " " * 300), (8, " " * 200 + "." + " " * 40), (9, short), (10, short + "!"), (3, passage + "twice the id"), (11, "é" * 60), (12, "ü" + "é" * 60),
            (13, "\x00" * 120), (14, "a\x00" * 80), (15, "b" + "a\x00" * 50), (-4, "before" + passage[20:])]
    rows += [(100 + k, word(30) + passage + word(20)) for k in range(40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DDL).repartition(6)
    assert got(df, window=window) == brute(rows, window)
    assert got(df, window=window, hot=2) == brute(rows, window)


def test_long_text(spark):
    """Longer than a pack's buffer, with a passage across the buffers' edge."""
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, rb.BUFFER + 5000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, long[rb.BUFFER - 70:rb.BUFFER + 200]), (3, "s" * 20 + long[:3000])]
    assert got(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DDL)) == brute(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], DDL)) == []


def test_window_out_of_range(spark):
    with pytest.raises(ValueError):
        rb.repeat_bytes(spark.createDataFrame([], DDL), window=20)


def test_transform_and_merge():
    """The merged transforms list the suffixes of all strings in order, and bounds show where their first symbols differ."""
    rng = random.Random(2)
    shards = [[bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(3, 12))) for _ in range(6)] for _ in range(3)]
    bwts, starts, suffixes = [], [], []
    for strings in shards:
        lens = np.array(list(map(len, strings)))
        bwt, s = rb.transform(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens) - lens, lens)
        rows = sorted((tuple(x + 1 for x in t[o:]) + (0,), k, o) for k, t in enumerate(strings) for o in range(len(t) + 1))
        assert [0 if o == 0 else strings[k][o - 1] for _, k, o in rows] == list(bwt) and [i for i, r in enumerate(rows) if r[2] == 0] == list(s)
        bwts.append(bwt)
        starts.append(s)
        suffixes += [r[0] for r in rows]
    for depth in (1, 3, 20):
        rows, bound, _, _ = rb.merge(bwts, starts, depth)
        heads = [suffixes[r][:depth] for r in rows]
        assert heads == sorted(heads)
        assert [b for b in bound] == [not k or x != heads[k - 1] for k, x in enumerate(heads)]
        whole = Counter(x[:depth] for x in suffixes)
        assert sorted(heads) == sorted(x[:depth] for x in suffixes if whole[x[:depth]] > 1 and 0 not in x[:depth])


def _pack_row(texts):
    body = b"".join(texts)
    whole = lambda x, kind: np.array(x, kind).tobytes()
    return {"pack": 5, "n_bytes": len(body), "ids": whole(range(len(texts)), np.int64), "known": whole([True] * len(texts), bool),
            "lens": whole(list(map(len, texts)), np.int64), "body": zstandard.ZstdCompressor().compress(body)}


def _open_pack(ranges):
    """A pack of documents that share passages with changes, with what its ranges of anchors find."""
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(9000))
    texts = [passage, bytes(b if k % 65 else 88 for k, b in enumerate(passage)), bytes(b if k % 71 else 89 for k, b in enumerate(passage))]
    row = _pack_row(texts)
    sent, = rb._anchors(50, ranges)(iter([pa.RecordBatch.from_pylist([row])]))
    groups = [rb._verdicts(rb.HOT, 16)(pa.Table.from_batches([sent.slice(k, 1)])) for k in range(sent.num_rows)]
    return row | {"verdicts": [{c: t[c][0].as_py() for c in ("range", "status", "least")} for t in groups]}


def test_many_buckets_take_few_sorts(monkeypatch):
    """The work of a pack does not grow with the buckets that its strings are dealt to; each bucket has the transform of its own strings."""
    row = _open_pack(7)
    calls, real = [], rb.transform
    monkeypatch.setattr(rb, "transform", lambda *a: calls.append(1) or real(*a))
    for buckets in (1, 5, 4000):
        calls.clear()
        out = [r for b in rb._shards(50, 7, buckets)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist() if r["bucket"] >= 0]
        sent = sum(len(r["lens"]) for r in out)
        assert sent > 300 and len(out) > min(buckets, 300) // 2
        assert len(calls) <= 1 + sent // 100
        pack = rb.Pack(row)
        for r in out:
            held = np.frombuffer(r["held"], bool)
            string, pos = np.frombuffer(r["string"], np.uint32), np.frombuffer(r["pos"], np.int64)
            first = np.array([pos[string == k][0] for k in np.flatnonzero(held)], np.int64)
            bwt, starts = real(pack.data, first, np.frombuffer(r["lens"], np.uint8).astype(np.int64))
            assert (bwt.tobytes(), starts.tobytes()) == (r["bwt"], r["starts"])


def test_binary_columns():
    """Rows cut from whole arrays are read as whole arrays, whatever the chunks."""
    values, bounds = np.arange(20, dtype=np.int64), np.array([0, 3, 3, 11, 20])
    column = rb._column(values, bounds)
    assert [x.as_py() for x in column] == [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    for cut in range(5):
        table = pa.table({"x": pa.chunked_array([column[:cut], column[cut:]])})
        got_values, got_bounds = rb._flat(table, "x", np.int64)
        assert got_values.tolist() == values.tolist() and got_bounds.tolist() == bounds.tolist()
    assert [x.tolist() for x in rb._flat(pa.table({"x": column[1:3]}), "x", np.int64)] == [list(range(3, 11)), [0, 0, 8]]
    assert rb._column(values[:0], np.zeros(1, int)).to_pylist() == []
