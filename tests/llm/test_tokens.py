"""Tokenizer operators against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from brute import rows_of
from tokenizers import Tokenizer

from rinse.llm import bpe_tree, packing, token_counts
from rinse.llm.encoder import ChunkEncoder
from rinse.llm.piece_transducer import PieceTransducer

WORD, BYTE, PIECE = map(P.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "b", "the", "in", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "É", "ß", "漢", "😀", "́", "1", "23", "!!", "...",
         "<|endoftext|>", "<s>", "\x1c", "　", "İ", "ا", "न", "्", "zzzz", "▁", "\xa0", "\x00", " \n"]


def random_texts(n, most, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)] + ["", " ", "  ", " a", "a ", "\n a", "a\n  b"]


def test_transducer_counts():
    model, machine = sentencepiece.SentencePieceProcessor(model_file=PIECE), PieceTransducer(PIECE, max_states=500)
    texts = random_texts(3000, 40, 1) + [a + " " * k + b for k in range(90) for a in ("", "x") for b in ("", "the", "é", "漢z", "😀")]
    assert [machine.count(t) for t in texts] == [len(x) for x in model.encode(texts)]


def test_chunk_encoder():
    for path, keep in ((WORD, False), (BYTE, True)):
        t, enc = Tokenizer.from_file(path), ChunkEncoder(path, keep, decoded=not keep)
        for text, x in zip(random_texts(2000, 40, 2), enc.texts(random_texts(2000, 40, 2))):
            ids = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(i for i, _ in x), "<u4").tolist() == ids
            if not keep:
                assert b" ".join(d for _, d in x if d).decode() == t.decode(ids, skip_special_tokens=False)


def test_packing_ids_equal_the_tokenizers_library():
    t, enc = Tokenizer.from_file(BYTE), packing.encoding(BYTE)
    for text in random_texts(3000, 40, 3):
        assert enc.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]  # every character class, in several surroundings
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)}  {chr(c)}a" for c in points]
    assert [enc.encode(x, allowed_special="all") for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("parts", [PARTS, ["a", "b", "c"], ["!", "'", "s", "t"], ["e", "́", " "], ["漢", "字", "ab"]])
def test_tree_concatenation(parts):
    t, rnd = Tokenizer.from_file(WORD), random.Random(len(parts))
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(30, 1500)))
        leaf = rnd.choice([17, 100, 333])
        nodes = [bpe_tree.Node.encode(t, text[i:i + leaf]) for i in range(0, len(text), leaf)]
        while len(nodes) > 1:
            nodes = [bpe_tree.join(t, *nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        assert nodes[0].ids.tolist() == t.encode(text, add_special_tokens=False).ids


def long_rows():
    rnd = random.Random(4)
    return [(None, None), (1, ""), (2, " "), (3, "ab" * 3000), (4, "x y" * 1000), (4, "x y" * 1000), (6, "漢字" * 700), (7, " " * 900), (8, "=" * 2000),
            (5, "".join(rnd.choice("abc!é ") for _ in range(9000))), (9, "".join(rnd.choice("abcdefgh") for _ in range(4000)))]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, row int, n_tokens string, idx int")


def test_bpe_round_trip(spark):
    t = Tokenizer.from_file(WORD)
    want = []
    for i, text in long_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = rows_of(bpe_tree.bpe_round_trip(clashing(spark, long_rows()), WORD, leaf=700), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [50, 1000])
def test_token_counts(spark, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in long_rows()]
    got = rows_of(token_counts.token_counts(clashing(spark, long_rows()), PIECE, limit=100, chunk=chunk), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(want, key=repr)


def test_a_chunk_entered_in_an_unforeseen_state_is_read_from_the_start(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CONTEXT", 1)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(1, "international" * 40), (2, "abcabd" * 90)]
    got = rows_of(token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), PIECE, chunk=7), "doc_id", "n_tokens")
    assert got == [(i, len(model.encode(t))) for i, t in rows]


def test_rows_read_again_are_the_same_when_the_input_is_split_otherwise(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "CONTEXT", 1)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(i, "international" * (30 + i)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "1")
    spark.conf.set(keys[1], "1")  # all files in one task
    try:
        counted = token_counts.token_counts(spark.read.parquet(f"{tmp_path}/docs"), PIECE, chunk=7)
        spark.conf.set(keys[2], "2000")  # now in several
        got = rows_of(counted, "doc_id", "n_tokens")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted(((i, len(model.encode(t))) for i, t in rows), key=repr)


def check_packing(rows, got, capacity=1024):
    t, pieces, sequences = Tokenizer.from_file(BYTE), {}, {}
    for doc, piece, start, length, crc, seq, offset in got:
        pieces.setdefault(doc, []).append((piece, start, length, crc))
        sequences.setdefault(seq, []).append((offset, length))
    want = {}
    for i, text in rows:
        ids, parts = t.encode(text or "", add_special_tokens=False).ids + [2], []
        for k, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            parts.append((k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
        want[i] = want.get(i, []) + parts
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(x[3] for x in got) // capacity)


COLS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def test_packing(spark, documents):
    got = rows_of(packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), BYTE), *COLS)
    used, least = check_packing(documents, got)
    assert used <= 1.02 * least + 2
    check_packing(long_rows(), rows_of(packing.pack(clashing(spark, long_rows()), BYTE), *COLS))
    assert packing.pack(clashing(spark, long_rows()).limit(0), BYTE).count() == 0


def test_sweep_takes_the_smallest_gap_and_ranges_do_not_change_it(spark):
    docs, gaps = [(9, 0, 2), (5, 0, 3), (1, 0, 4)], [(20, 0, 1), (9, 1, 1), (6, 2, 2), (5, 4, 1)]
    matches, left, rest = packing.sweep(docs, gaps)
    assert matches == [(9, 0, 1, 9, 1), (9, 1, 1, 20, 0), (5, 0, 1, 5, 4), (5, 1, 2, 6, 2)] and left == [(1, 0, 4)] and not rest
    for ranges in (1, 2, 8):
        m, d, g = packing.distributed_sweep(spark, docs, gaps, ranges)
        assert (sorted(m), d, g) == (sorted(matches), left, rest)


def test_plan_fills_nearly_all_sequences(spark):
    rnd = random.Random(9)
    counts: dict[int, int] = {}
    for _ in range(20_000):
        s = rnd.choice([rnd.randint(1, 1024), rnd.randint(1, 60)])
        counts[s] = counts.get(s, 0) + 1
    places = packing.plan(spark, counts)
    assert sum(n for _, _, n, _, _ in places) == 20_000
    assert max(s + n for _, _, n, _, s in places) <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 1


@pytest.mark.parametrize("unit", [" ", "\n", "a", "^", " \t"])
def test_packing_ids_of_very_long_runs(unit):
    text = "hello " + unit * (2_000_000 // len(unit)) + "world"
    assert packing.ids_of(BYTE, text) == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
