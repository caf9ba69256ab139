"""Repeated byte strings found by merging Burrows-Wheeler transforms of shards.

A byte goes if a ``window``-byte string over it also starts in a document with
a smaller id.  The work is done per *pack*, a written row of some documents:

1. Anchors.  Of each window's ``GRAM``-byte grams the one with the smallest hash
   is its anchor, so equal windows have equal anchors.  Consecutive windows of
   one anchor form one short string (at most ``window + width - 1`` bytes).  Per
   pack, each distinct (anchor, string hash) is sent once with its smallest id.
2. Ranges of anchors compare them.  An anchor of one document is done.  An
   anchor with one string is settled by its smallest id: all its windows are
   equal everywhere.  Where different strings share an anchor, their windows
   may be equal in part: those strings are *open*.
3. Open strings.  Each pack, the shard, builds the Burrows-Wheeler transform of
   its open strings per bucket of anchors and sends the transform, not the
   strings.  Each bucket merges the transforms of its shards by refining their
   interleave: pass h moves every row along its last-to-first link and orders
   the rows by one more symbol, so after h passes they are in order of their
   first h symbols, and the boundaries that have not appeared by then mark
   common prefixes of h or more.  After ``window`` passes the intervals without
   a boundary are the repeated windows; no suffix is sorted again.
   Only rows with ``window`` bytes of their string before them start: no others
   can end a window, and these never meet a terminator.
4. The smallest id of each interval goes back to the shards, which mark bytes.

Packs, ranges and buckets have bounded sizes, and their number follows the
input; a pack sends a row to each range and bucket, so the rows are many and
short in large inputs.  They are therefore cut from whole arrays (``_column``)
and read as whole arrays (``_flat``): Python does no work for each of them, and
one sort makes the transforms for many buckets.  A string or anchor that many
documents share is one entry per pack.  An anchor with more than ``HOT``
different strings (the edge of a passage that many documents quote) is cut into
single windows, dealt by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import durable, texts

WINDOW = 50
GRAM = 20
PACK = 8 << 20           # bytes of text in a pack; a longer text is a pack of its own
BUFFER = 1 << 16         # bytes hashed at a time
RANGE = 16 << 20         # bytes of text whose anchors one range compares
BUCKET = 16_000          # open strings that one bucket merges
HOT = 20_000             # different strings of an anchor from which they are cut into windows
SORTED = 1_000           # open strings of several buckets whose transforms are sorted at once
SLICE = 1 << 16          # strings whose windows are compared at a time
NO_ID = np.iinfo(np.int64).max
NONE, SETTLED, HELD, OPEN, CUT = range(5)   # HELD: open, and this pack sends the string

_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from each place on (fewer at the end)."""
    power, done, out = _BYTE[data], 1, None   # hashes of 1, 2, 4 ... bytes
    covered, rest = 0, size

    def joined(a: np.ndarray, b: np.ndarray, shift: int, length: int) -> np.ndarray:
        far = np.zeros_like(a)
        far[:len(a) - shift] = b[shift:]
        return a * np.uint64(pow(_M, length, 1 << 64)) + far

    while rest:
        if rest & 1:
            out = power if out is None else joined(out, power, covered, done)
            covered += done
        rest >>= 1
        if rest:
            power, done = joined(power, power, done, done), 2 * done
    return _mixed(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` values from each place on."""
    size = 1
    while 2 * size <= width:
        h = np.concatenate([np.minimum(h[:-size], h[size:]), h[-size:]])
        size *= 2
    step = width - size
    return np.concatenate([np.minimum(h[:-step], h[step:]), h[-step:]]) if step else h


class Pack:
    """The documents of one pack: ids, whether each has an id, and their bytes end to end."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.ends = np.cumsum(self.lens)
        self.distinct, self.rank = np.unique(self.ids, return_inverse=True)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.lens.sum()))), np.uint8)

    def strings(self, window: int) -> dict[str, np.ndarray]:
        """The anchored strings in order of place: doc (index), pos, count (windows), anchor and key (hash)."""
        width = window - GRAM + 1
        found: list[tuple] = []
        lo, n, begins = 0, len(self.data), self.ends - self.lens
        while lo + window <= n:
            hi = min(n, lo + BUFFER + window - 1)
            piece = self.data[lo:hi]
            whole = window_hashes(piece, window)
            least = _least(window_hashes(piece, GRAM), width)
            last = hi - window + 1
            new = np.ones(last - lo, bool)
            new[1:] = least[1:last - lo] != least[:last - lo - 1]
            a, b = np.searchsorted(begins, [lo, last])
            new[begins[a:b] - lo] = True
            start = np.flatnonzero(new)
            # a string ends where the next begins, or with the windows of its document
            doc = np.searchsorted(self.ends, lo + start, "right")
            end = np.minimum(np.append(start[1:], last - lo), self.ends[doc] - window + 1 - lo)
            some = end > start
            start, count, doc = start[some], (end - start)[some], doc[some]
            parts = -(-count // width)
            if (parts > 1).any():      # equal anchors in a row, as in runs of one byte
                k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                start, doc = np.repeat(start, parts) + k * width, np.repeat(doc, parts)
                count = np.minimum(np.repeat(count, parts) - k * width, width)
            if len(start):
                key = _mixed(whole[start] * np.uint64(3) + whole[start + count - 1] * np.uint64(5) + count.astype(np.uint64))
                found.append((doc, lo + start, count, _mixed(least[start] * np.uint64(_M)), key))   # smallest hashes are small: spread them
            lo = last
        names = ("doc", "pos", "count", "anchor", "key")
        if not found:
            return dict(zip(names, [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2))
        return dict(zip(names, map(np.concatenate, zip(*found))))

    def entries(self, s: dict, ranges: int) -> tuple:
        """Distinct (range, anchor, key) of the pack, in order: their range, anchor, key, rank of the smallest and of the largest id, and the entry of each string."""
        rng = ((s["anchor"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        code = (rng << np.uint64(32)) | (s["anchor"] & np.uint64(0xFFFFFFFF))
        order = np.lexsort((s["key"], code))
        code, key, doc = code[order], s["key"][order], self.rank[s["doc"][order]]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (key[1:] != key[:-1])]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(doc, first) if len(first) else doc
        high = np.maximum.reduceat(doc, first) if len(first) else doc
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        return code[first], key[first], low, high, entry


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``PACK`` bytes of documents."""
    ids, known, bodies, size, number = [], [], [], 0, 0
    base = TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))
        return pa.RecordBatch.from_pylist([{
            "pack": base + number, "n_bytes": size, "ids": np.array(ids, np.int64).tobytes(), "known": np.array(known, bool).tobytes(),
            "lens": np.array(list(map(len, bodies)), np.int64).tobytes(), "body": body}], schema=PACK_ARROW)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text.as_buffer().to_pybytes()
            if bodies and size + len(body) > PACK:
                yield row()
                ids, known, bodies, size, number = [], [], [], 0, number + 1
            ids.append(NO_ID if i is None else i)
            known.append(i is not None)
            bodies.append(body)
            size += len(body)
    if bodies:
        yield row()


PACK_ARROW = pa.schema([("pack", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "lens", "body"))])
PACK_SCHEMA = "pack bigint, n_bytes bigint, ids binary, known binary, lens binary, body binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _anchors(window: int, ranges: int):
    schema = pa.schema([("range", pa.int32()), ("pack", pa.int64()), *((c, pa.binary()) for c in ("code", "key", "low", "ids"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            code, key, low, high, _ = pack.entries(pack.strings(window), ranges)
            of = (code >> np.uint64(32)).astype(np.int64)
            bounds = _bounds(of)
            row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # the ids of each row once; entries point to them
            pairs, at = np.unique(row_of * len(pack.distinct) + low, return_inverse=True)
            starts = np.searchsorted(pairs, np.arange(len(bounds)) * len(pack.distinct))
            at = 2 * (at - starts[row_of]) + (high > low)   # the low bit: several documents of the pack hold it
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays([pa.array(of[bounds[:-1]], pa.int32()), pa.array(np.full(n, row["pack"]), pa.int64()), _column(code.astype(np.uint32), bounds),
                                              _column(key, bounds), _column(at.astype(np.uint32), bounds), _column(pack.distinct[pairs % max(1, len(pack.distinct))], starts)], schema=schema)
    return run


def _bounds(groups: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(groups):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])


def _column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose rows are ``values[bounds[k]:bounds[k + 1]]``."""
    values, bounds = np.ascontiguousarray(values), np.asarray(bounds, np.int64) * values.itemsize
    if bounds[-1] >= 1 << 31:
        raise ValueError(f"{bounds[-1]} bytes for one binary column")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values)])


def _flat(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a binary column end to end, and the row bounds."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for chunk in table.column(name).chunks:
        wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        at = np.frombuffer(chunk.buffers()[1], wide)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64) if len(chunk) else np.zeros(1, np.int64)
        if at[-1] > at[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0]:at[-1]])
        sizes.append(np.diff(at))
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return whole.view(kind), np.cumsum(np.concatenate(sizes)) // np.dtype(kind).itemsize


def _verdicts(hot: int, cut_into: int):
    """For each range: the status of every entry sent, and the smallest id of the settled ones."""
    def run(table: pa.Table) -> pa.Table:
        (code, bounds), (key, _), (refs, _), (ids, starts) = (_flat(table, c, k) for c, k in (("code", np.uint32), ("key", np.uint64), ("low", np.uint32), ("ids", np.int64)))
        low = ids[(refs >> 1) + np.repeat(starts[:-1], np.diff(bounds))]
        several = refs & 1
        order = np.lexsort((key, code))
        code, key, low, several = code[order], key[order], low[order], several[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
        string = new | np.concatenate([[True], key[1:] != key[:-1]])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(low, first)
        shared = (np.maximum.reduceat(low, first) > least) | (np.maximum.reduceat(several, first) > 0)
        strings = np.add.reduceat(string.astype(np.int64), first)
        status = np.where(~shared, NONE, np.where(strings == 1, SETTLED, np.where(strings > hot, CUT, OPEN))).astype(np.uint8)[group]
        out, best = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
        out[order], best[order] = np.where((status == OPEN) & string, HELD, status), least[group]
        before = lambda x: np.concatenate([[0], np.cumsum(x)])[bounds]
        work = before((out == HELD) + (out == CUT) * np.int64(cut_into))
        return pa.table({"pack": table.column("pack"), "range": table.column("range"), "n_open": np.diff(work),
                         "status": _column(out, bounds), "least": _column(best[out == SETTLED], before(out == SETTLED))})
    return run


_HEADS = np.array([0, *((1 << 64) - (1 << 8 * k) for k in range(7, -1, -1))], np.uint64)   # masks of the first 0, 1, 2 ... 8 bytes of a word


def transform(data: np.ndarray, pos: np.ndarray, lens: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the strings ``data[pos:pos + lens]`` and its rows that hold a terminator.

    Terminators are smaller than every byte and ordered like their strings.  With ``part``, ascending numbers of the
    strings below 2^24, the transforms of the parts stand end to end.
    """
    if not len(lens):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint32)
    sizes = lens + 1
    ends = np.cumsum(sizes) - 1
    begins, row, string = ends - lens, np.arange(ends[-1] + 1), np.repeat(np.arange(len(lens)), sizes)
    rest = ends[string] - row
    text = np.zeros(len(row) + 8, np.uint8)     # the strings, a terminator behind each
    text[:len(row)] = data[np.minimum(row + (pos - begins)[string], len(data) - 1)]
    text[ends] = 0
    eight = np.ndarray(len(row) + 1, ">u8", text, strides=(1,))

    def word(rows: np.ndarray, offset: int) -> np.ndarray:
        """Eight bytes from there on, zeros behind the string's end, as one number."""
        return eight[np.minimum(rows + offset, len(row))].astype(np.uint64) & _HEADS[np.clip(rest[rows] - offset, 0, 8)]

    # by part and the first five bytes; what still ties by the next eight, and so on; in the end the shorter first, then by string
    first = word(row, 0) >> np.uint64(24)
    if part is not None:
        first |= part.astype(np.uint64)[string] << np.uint64(40)
    order = np.argsort(first)
    new = np.ones(len(row), bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    tied = np.arange(len(row))
    for offset in (*range(5, int(lens.max()) + 1, 8), None):
        keep = ~new | ~np.append(new[1:], True)
        tied, new = tied[keep], new[keep]
        if not len(tied):
            break
        rows = order[tied]
        keys = (string[rows], rest[rows]) if offset is None else (word(rows, offset),)
        by = np.lexsort((*keys, np.cumsum(new)))
        order[tied] = rows[by]
        if offset is not None:
            new[1:] |= keys[0][by[1:]] != keys[0][by[:-1]]
    starts = np.zeros(len(row), bool)
    starts[begins] = True
    starts = starts[order]
    return np.where(starts, 0, text[order - 1]).astype(np.uint8), np.flatnonzero(starts).astype(np.uint32)


SHARD_ARROW = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), *((c, pa.binary()) for c in ("settled", "name", "held", "lens", "bwt", "starts", "low", "high", "string", "doc", "pos"))])
SHARD_SCHEMA = "bucket bigint, pack bigint, settled binary, name binary, held binary, lens binary, bwt binary, starts binary, low binary, high binary, string binary, doc binary, pos binary"


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of up to ``SORTED`` in all, or of one."""
    a, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > a and total + size > SORTED:
            yield a, k
            a, total = k, 0
        total += size
    if len(sizes):
        yield a, len(sizes)


def _shards(window: int, ranges: int, buckets: int):
    """Per pack: the spans that settled strings remove (bucket -1), and per bucket the transform of its open strings with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            s = pack.strings(window)
            code, key, low, high, entry = pack.entries(s, ranges)
            answers = sorted(row["verdicts"], key=lambda v: v["range"])
            status = np.frombuffer(b"".join(v["status"] for v in answers), np.uint8)
            least = np.zeros(len(code), np.int64)
            least[status == SETTLED] = np.frombuffer(b"".join(v["least"] for v in answers), np.int64)
            state = status[entry]
            gone = (state == SETTLED) & (least[entry] < pack.ids[s["doc"]])
            spans = np.stack([s["pos"][gone], s["pos"][gone] + s["count"][gone] + window - 1], 1)
            yield pa.RecordBatch.from_pylist([{"bucket": -1, "pack": row["pack"], "settled": merged(spans, pack.ends).astype(np.int64).tobytes()}], schema=SHARD_ARROW)

            is_open = np.flatnonzero((state == OPEN) | (state == HELD))
            cut = np.flatnonzero(state == CUT)
            inner = np.arange(s["count"][cut].sum()) - np.repeat(np.cumsum(s["count"][cut]) - s["count"][cut], s["count"][cut])
            pos = np.concatenate([s["pos"][is_open], np.repeat(s["pos"][cut], s["count"][cut]) + inner])
            doc = np.concatenate([s["doc"][is_open], np.repeat(s["doc"][cut], s["count"][cut])])
            lens = np.concatenate([s["count"][is_open] + window - 1, np.full(len(inner), window)])
            own = np.zeros(len(inner), np.uint64)
            for i in range(window if len(inner) else 0):
                own = own * np.uint64(_M) + _BYTE[pack.data[pos[len(is_open):] + i]]
            own = _mixed(own)
            spread = _mixed(code[entry[is_open]] + np.uint64(1))
            bucket = (np.concatenate([spread, own]) % np.uint64(buckets)).astype(np.int64)
            name = np.concatenate([_mixed(spread * np.uint64(3) + s["key"][is_open]), own])
            held = np.concatenate([state[is_open] == HELD, np.ones(len(own), bool)])
            order = np.lexsort((name, bucket))
            bucket, name, held, pos, doc, lens = (x[order] for x in (bucket, name, held, pos, doc, lens))
            # distinct strings (names), those this pack sends, and where the buckets begin in each
            bounds = _bounds(bucket)
            number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            names = np.searchsorted(first, bounds)
            sent = first[held[first]]
            sends = np.searchsorted(sent, bounds)
            ids = pack.ids[doc]
            for a, b in _chunks(np.diff(sends)):
                occurrences, strings, sending = (slice(x[a], x[b]) for x in (bounds, names, sends))
                go, begins = sent[sending], first[strings]
                bwt, starts = transform(pack.data, pos[go], lens[go], number[go] - a)
                rows = np.concatenate([[0], np.cumsum(lens[go] + 1)])[sends[a:b + 1] - sends[a]]
                low, high = (f.reduceat(ids[occurrences], begins - bounds[a]) for f in (np.minimum, np.maximum))
                at = {"name": (name[begins], names), "held": (held[begins], names), "low": (low, names), "high": (high, names), "lens": (lens[go].astype(np.uint8), sends),
                      "string": ((of - names[number])[occurrences].astype(np.uint32), bounds), "doc": (doc[occurrences].astype(np.uint32), bounds), "pos": (pos[occurrences].astype(np.int64), bounds)}
                columns = {c: _column(x, edges[a:b + 1] - edges[a]) for c, (x, edges) in at.items()}
                columns["bwt"] = _column(bwt, rows)
                columns["starts"] = _column((starts - rows[number[go] - a]).astype(np.uint32), sends[a:b + 1] - sends[a])
                columns |= {"bucket": pa.array(bucket[bounds[a:b]], pa.int64()), "pack": pa.array(np.full(b - a, row["pack"]), pa.int64()), "settled": pa.nulls(b - a, pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in SHARD_ARROW.names], schema=SHARD_ARROW)
    return run


def merge(bwts: list[np.ndarray], starts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, bound, string, place)`` of the merged transforms.

    ``rows`` lists, in order, those of the shards' rows (numbered end to end) whose first ``depth`` symbols others share;
    ``bound`` marks the first row of each interval of equal symbols.  A row alone in its block stays alone, and so does
    the row it leads to, so blocks that have come down to one row leave the refinement; so do, from the start, rows with
    fewer than ``depth`` bytes of their string before them.  ``string`` and ``place`` tell where each of all rows stands.
    """
    sizes = np.array([len(x) for x in bwts])
    base = np.cumsum(sizes) - sizes
    symbol = np.concatenate(bwts)
    n_starts = np.array([len(x) for x in starts])
    terminator, bare = np.zeros(len(symbol), bool), np.zeros(len(symbol), bool)
    terminator[np.concatenate(starts).astype(np.int64) + np.repeat(base, n_starts)] = True
    bare[np.arange(n_starts.sum()) + np.repeat(base - (np.cumsum(n_starts) - n_starts), n_starts)] = True
    # within a shard, rows in order of their symbols lead to its rows in order
    others = np.flatnonzero(~terminator)
    others = others[np.argsort(symbol[others], kind="stable")]
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
    others = others[np.argsort(shard[others], kind="stable")]
    link = np.empty(len(symbol), np.int64)
    link[others] = np.flatnonzero(~bare)
    # walk each string from its end
    string, place = np.empty(len(symbol), np.int32), np.empty(len(symbol), np.int16)
    at, who, length = np.flatnonzero(bare), np.arange(n_starts.sum()), np.zeros(n_starts.sum(), np.int16)
    step = 0
    while len(who):
        string[at], place[at] = who, step
        done = terminator[at]
        length[who[done]] = step
        at, who = link[at[~done]], who[~done]
        step += 1
    place = length[string] - place
    rows = np.flatnonzero(place >= depth)
    bound = np.zeros(len(rows), bool)
    for _ in range(depth):
        sym = symbol[rows]
        by = np.argsort(sym, kind="stable")
        sym, block = sym[by], np.cumsum(bound, dtype=np.int32)[by]
        bound = np.ones(len(rows), bool)
        bound[1:] = (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])
        shared = ~bound
        shared[:-1] |= ~bound[1:]
        rows, bound = link[rows[by[shared]]], bound[shared]
    return rows, bound, string, place


ANSWER_SCHEMA = "pack bigint, bucket bigint, at binary, first binary, last binary, least binary"


def _merged_bucket(window: int):
    """For each shard of a bucket: string, first and last window and smallest id of every stretch that a document of the shard must lose."""
    def run(table: pa.Table) -> pa.Table:
        name, edges = _flat(table, "name", np.uint64)
        held, low, high = (_flat(table, c, k)[0] for c, k in (("held", bool), ("low", np.int64), ("high", np.int64)))
        length = _flat(table, "lens", np.uint8)[0].astype(np.int64)
        bwts, starts = ([x[a:b] for a, b in zip(at, at[1:])] for x, at in (_flat(table, "bwt", np.uint8), _flat(table, "starts", np.uint32)))
        rows, bound, string, place = merge(bwts, starts, window)
        # what packs say of the same string: its smallest id, and which of the merged strings it is
        known, which = np.unique(name, return_inverse=True)
        least_of = np.full(len(known), NO_ID)
        np.minimum.at(least_of, which, low)
        merged_as = np.empty(len(known), np.int64)
        merged_as[which[held]] = np.arange(len(length))
        own = least_of[which[held]]
        width = int(length.max()) - window + 1
        least = np.full((len(length), width), NO_ID)
        for k in range(width):
            least[length >= window + k, k] = own[length >= window + k]
        if len(rows):
            string, place = string[rows], place[rows]
            first = np.flatnonzero(bound)
            smallest = np.minimum.reduceat(own[string], first)[np.cumsum(bound) - 1]
            least[string, place] = smallest
        stretches = []
        for a in range(0, len(name), SLICE):
            table_of = least[merged_as[which[a:a + SLICE]]]
            lose = table_of < high[a:a + SLICE, None]
            same = np.zeros_like(lose)
            same[:, 1:] = lose[:, 1:] & lose[:, :-1] & (table_of[:, 1:] == table_of[:, :-1])
            who, begin = np.nonzero(lose & ~same)
            last = np.zeros_like(same)
            last[:, :-1] = same[:, 1:]
            stretches.append((a + who, begin, np.nonzero(lose & ~last)[1], table_of[who, begin]))
        who, begin, stop, value = map(np.concatenate, zip(*stretches))
        cut = np.searchsorted(who, edges)
        local = who - np.repeat(edges[:-1], np.diff(cut))
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "at": _column(local.astype(np.uint32), cut),
                         "first": _column(begin.astype(np.uint8), cut), "last": _column(stop.astype(np.uint8), cut), "least": _column(value, cut)})
    return run


def merged(spans: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Half-open ``spans`` as disjoint, maximal ones in order; spans of different documents (which stop at ``ends``) stay apart."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    doc = np.searchsorted(ends, spans[:, 0], "right")
    new = np.concatenate([[True], (spans[1:, 0] > reach[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _results(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in row["settled"]]
            if answers := row["answers"]:
                joined = lambda c, kind: np.frombuffer(b"".join([a[c] for a in answers]), kind)
                string, doc, pos = joined("string", np.uint32).astype(np.int64), joined("doc", np.uint32), joined("pos", np.int64)
                at, least = joined("at", np.uint32).astype(np.int64), joined("least", np.int64)
                begin, stop = (joined(c, np.uint8).astype(np.int64) for c in ("first", "last"))
                bucket = np.arange(len(answers)) << 32      # strings are numbered bucket by bucket
                string += np.repeat(bucket, [len(a["string"]) // 4 for a in answers])
                at += np.repeat(bucket, [len(a["at"]) // 4 for a in answers])
                lo, hi = np.searchsorted(at, string, "left"), np.searchsorted(at, string, "right")
                who = np.repeat(np.arange(len(string)), hi - lo)
                k = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[who]
                gone = least[k] < pack.ids[doc[who]]
                who, k = who[gone], k[gone]
                spans.append(np.stack([pos[who] + begin[k], pos[who] + stop[k] + window], 1))
            spans = merged(np.concatenate(spans), pack.ends) if spans else np.zeros((0, 2), np.int64)
            doc = np.searchsorted(pack.ends, spans[:, 0], "right")
            n_spans = np.bincount(doc, minlength=len(pack.ids))
            n_removed = np.bincount(doc, spans[:, 1] - spans[:, 0], len(pack.ids)).astype(np.int64)
            data, bounds, at, digests = memoryview(pack.data), pack.ends - pack.lens, 0, []
            for k, (begin, end) in enumerate(zip(bounds, pack.ends)):
                state = hashlib.sha256()
                for _ in range(n_spans[k]):
                    state.update(data[begin:spans[at, 0]])
                    begin = spans[at, 1]
                    at += 1
                state.update(data[begin:end])
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(pack.ids, pa.int64(), mask=~pack.known), pa.array(pack.lens), pa.array(n_removed),
                                              pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], schema=RESULT)
    return run


def repeat_bytes(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; ``window`` has more than ``GRAM`` and at most 100 bytes.

    A NULL text is empty; texts shorter than ``window`` and empty ones keep all.  Ids are integers.  A NULL id counts as
    greater than every other; rows that repeat an id are documents of their own which do not remove bytes from each other.
    A text of any length is read whole.  Other columns are ignored.  An empty table gives an empty result.
    """
    if not GRAM < window <= 100:
        raise ValueError(f"window {window} is not between {GRAM + 1} and 100")
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    packs = durable(rows.mapInArrow(_packed, PACK_SCHEMA), "packs")
    n_bytes = packs.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = 1 + n_bytes // RANGE

    sent = packs.mapInArrow(_anchors(window, ranges), "range int, pack bigint, code binary, key binary, low binary, ids binary")
    verdicts = sent.groupBy("range").applyInArrow(_verdicts(hot, (window - GRAM) // 2 + 1), "pack bigint, range int, status binary, least binary, n_open bigint")
    answers = durable(verdicts, "verdicts")
    n_open = answers.agg(F.sum("n_open")).first()[0] or 0
    buckets = 1 + n_open // BUCKET

    per_pack = answers.groupBy("pack").agg(F.collect_list(F.struct("range", "status", "least")).alias("verdicts"))
    shards = durable(packs.join(per_pack, "pack").mapInArrow(_shards(window, ranges, buckets), SHARD_SCHEMA), "shards")
    opened = shards.filter("bucket >= 0")
    found = opened.select("bucket", "pack", "name", "held", "lens", "bwt", "starts", "low", "high").groupBy("bucket").applyInArrow(_merged_bucket(window), ANSWER_SCHEMA)
    places = opened.select("pack", "bucket", "string", "doc", "pos").join(found, ["pack", "bucket"])
    spans = places.groupBy("pack").agg(F.collect_list(F.struct("string", "doc", "pos", "at", "first", "last", "least")).alias("answers"))
    settled = shards.filter("bucket < 0").groupBy("pack").agg(F.collect_list("settled").alias("settled"))
    none = F.array().cast("array<struct<string: binary, doc: binary, pos: binary, at: binary, first: binary, last: binary, least: binary>>")
    return (packs.join(settled, "pack", "left").join(spans, "pack", "left")
            .select("ids", "known", "lens", "body", F.coalesce("settled", F.array().cast("array<binary>")).alias("settled"), F.coalesce("answers", none).alias("answers"))
            .mapInArrow(_results(window), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
