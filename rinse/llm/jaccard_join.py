"""N-gram Jaccard join by vertical partitioning, and the groups its links form.

The global n-gram order is cut into fragments, so that no task ever needs a
whole set, and whatever is counted is counted per fragment and then summed:

1. Texts with equal sets form a class; from here on a class stands for them.
   Sets are equal when two 64-bit hashes of them are: a first hash that sets
   with different second ones share names no class, the second does there.
2. Every set is cut into fragments (ranges of hashed n-grams).  A fragment's
   task sees which of its n-grams occur in more than one class and gives each
   class its number of shared ones.  Summed over fragments, a class that shares
   less than the threshold's part of its set cannot be linked and is out.
3. Among the survivors, n-grams are ordered by rising frequency (again found
   per fragment).  Linked classes share one of the first n-grams of that order
   (the prefix filter), within the bounds that sizes and places allow.
4. For candidate pairs, the overlap is counted in each fragment separately and
   summed per pair, which decides the link exactly.

Step 4 does not list all pairs of a large group of near copies.  Links matter
only for the groups they connect, so first each class is tried against the
representatives of n-grams it shares and groups are formed, up to
``STAR_ROUNDS`` times while that joins groups; then every remaining candidate pair whose classes are still in
different groups is tried.  That leaves out no link between two groups.  Most
candidates are settled before their sets are fetched: a set's parity sketch
has one bit per hash value, the parity of its n-grams there, so two sketches
differ in no more bits than the sets differ in n-grams.

Narrow rows travel packed (many n-grams of one fragment in one row), and
n-gram rows exist for the survivors' prefixes only.  There are more fragments
the more input there is, in the end one for nearly every n-gram of a set, so
what a packed row says of each set must be short: sets are known by numbers
that follow each other within a row, and these are sent as steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import durable, maybe_in, texts, without_copies
from rinse.llm.shingles import set_key, set_keys, shingle_set

WIDTH = 4
PERCENT = 85
STAR_ROUNDS = 5
STAR_LISTS = 4
FRAGMENTS_PER_TASK = 1
PAIR_FRAGMENTS = 2
SKETCH_WORDS = 16
KEY_BITS = 64
MOST_TWINS = 100_000
SLICE = 256


def _sets(width: int, bits: int):
    """Each text's other columns, ``n_shingles`` and the two hashes ``cls`` and ``cls2``."""
    def run(batches):
        for b in batches:
            names = [c for c in b.schema.names if c != "text"]
            sizes, keys = [], []
            for t in some_at_a_time(b.column("text")):
                s = shingle_set(t, width)
                sizes.append(len(s))
                keys.append(set_keys(s, bits) if len(s) else (None, None))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sizes, pa.int64()),
                 *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], [*names, "n_shingles", "cls", "cls2"])
    return run


def some_at_a_time(column: pa.Array):
    """The values of ``column``, of which few are Python objects at once."""
    for i in range(0, len(column), SLICE):
        yield from column.slice(i, SLICE).to_pylist()


def set_classes(d: DataFrame, columns: str, width: int, bits: int) -> tuple[DataFrame, frozenset[int]]:
    """The rows of ``d (columns, text)`` with ``n_shingles`` and ``cls`` for their text, and the first hashes that name no class.

    At 2e10 different sets about ten first hashes are expected to be shared; more than ``MOST_TWINS`` raise."""
    rows = durable(d.mapInArrow(_sets(width, bits), f"{columns}, n_shingles bigint, cls bigint, cls2 bigint"))
    shared = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("cls2").alias("lo"), F.max("cls2").alias("hi")).filter("lo <> hi")
    twins = frozenset(r["cls"] for r in shared.select("cls").limit(MOST_TWINS + 1).collect())
    if len(twins) > MOST_TWINS:
        raise ValueError("too many different sets share a first hash")
    if twins:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(list(twins)), F.col("cls2")).otherwise(F.col("cls")))
    return rows.drop("cls2"), twins


WIDTHS = (np.uint8, np.uint16, np.uint32)


def tight(x: np.ndarray) -> bytes:
    """The 64-bit numbers ``x`` in one, two or four bytes each, whichever is shortest; larger ones follow whole."""
    x = np.asarray(x, np.int64).view(np.uint64)
    k = int(np.argmin([len(x) * t().itemsize + 8 * np.count_nonzero(x >= np.iinfo(t).max) for t in WIDTHS]))
    most = np.uint64(np.iinfo(WIDTHS[k]).max)
    return np.uint32(4 * len(x) + k).tobytes() + np.minimum(x, most).astype(WIDTHS[k]).tobytes() + x[x >= most].tobytes()


def loose(b) -> np.ndarray:
    """What ``tight`` made ``b`` of."""
    n, k = divmod(int(np.frombuffer(b, np.uint32, 1)[0]), len(WIDTHS) + 1)
    short = np.frombuffer(b, WIDTHS[k], n, 4)
    x, large = short.astype(np.uint64), short == np.iinfo(WIDTHS[k]).max
    if large.any():
        x[large] = np.frombuffer(b, np.uint64, offset=4 + short.nbytes)
    return x.view(np.int64)


def tight_steps(x: np.ndarray) -> bytes:
    """``x`` as its first number and the steps from each to the next (modulo 2 ** 64)."""
    return np.asarray(x[:1], np.int64).tobytes() + tight(np.diff(x))


def loose_steps(b) -> np.ndarray:
    """What ``tight_steps`` made ``b`` of."""
    return np.cumsum(np.concatenate([np.frombuffer(b, np.uint64, 1), loose(memoryview(b)[8:]).view(np.uint64)])).view(np.int64)


def packed(keys, sizes, sets, fragments: int, wide: bool):
    """One row per fragment: the classes in it, their sizes, counts and n-grams.

    Narrow rows keep 32 bits of each n-gram's hash beside the fragment, which
    may only make it look more frequent than it is.
    """
    if not len(keys):
        return []
    h = np.concatenate(sets)
    frag = h >> np.uint64(32)
    frag *= np.uint64(fragments)
    frag >>= np.uint64(32)
    frag = frag.astype(np.min_scalar_type(fragments))
    order = np.argsort(frag, kind="stable")  # within a fragment by owner, as they come
    frag, h = frag[order], (h if wide else h.astype(np.uint32))[order]
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(s) for s in sets])[order]
    keys, sizes = np.asarray(keys, np.int64), np.asarray(sizes, np.int64)
    out = []
    for f, a, b in zip(*runs(frag)):
        own, start, stop = runs(owner[a:b])
        out.append((int(f), tight_steps(keys[own]), tight(sizes[own]), tight(stop - start), h[a:b].tobytes()))
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal values."""
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[start], start, np.append(start[1:], len(x))


PACKED = "f int, cls binary, n binary, cnt binary, grams binary"
RANKED = "b int, cls binary, n binary, cnt binary, df binary, grams binary"
COUNTED = "b int, cls binary, cnt binary, named binary"
GROUP_SHINGLES = 1_000_000
NUMBER_BITS = 20


def _grouped(sets, pack):
    """``pack(classes, sizes, n-grams)`` of batches of ``sets (class, size, n-grams)``, little more than ``GROUP_SHINGLES`` n-grams in each."""
    keys, sizes, held, total = [], [], [], 0
    for key, n, s in sets:
        keys.append(key)
        sizes.append(n)
        held.append(s)
        total += len(s)
        if total > GROUP_SHINGLES or len(keys) >> NUMBER_BITS:
            yield _batch(pack(keys, sizes, held))
            keys, sizes, held, total = [], [], [], 0
    yield _batch(pack(keys, sizes, held))


def _bucket(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which the counts of numbered sets meet, one for a whole batch."""
    return (numbers >> NUMBER_BITS) % buckets


def numbered(keys, sizes, sets, fragments: int):
    """``packed`` narrow rows by numbers in place of classes, and a row that names them, for the fragment -1 - bucket.

    A batch's numbers start at a hash of its classes: were a lost task to pack
    others when it is run again, no number would stand for two classes."""
    if not keys:
        return []
    names = np.array(keys, np.int64)
    base = xxhash.xxh3_64_intdigest(names.tobytes(), len(names)) >> NUMBER_BITS << NUMBER_BITS
    numbers = (np.uint64(base) + np.arange(len(names), dtype=np.uint64)).view(np.int64)
    return [(-1 - int(_bucket(numbers[0], fragments)), tight_steps(numbers), names.tobytes(), b"", b""),
            *packed(numbers, sizes, sets, fragments, False)]


def _pack(width: int, fragments: int, twins: frozenset[int] = frozenset(), bits: int = KEY_BITS):
    """N-grams of the texts, packed; of texts with equal sets each task packs one."""
    def sets(batches):
        seen: set[int] = set()
        for b in batches:
            for t in some_at_a_time(b.column("text")):
                s = shingle_set(t, width)
                if len(s) and (key := set_key(s, twins, bits)) not in seen:
                    seen.add(key)
                    yield key, 0, s
    return lambda batches: _grouped(sets(batches), lambda *batch: numbered(*batch, fragments))


def _batch(rows, schema: str = PACKED):
    names = [c.split()[0] for c in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names)


def arrays(table: pa.Table, column: str, dtype=np.int64) -> list[np.ndarray]:
    """The arrays in a binary column, not copied."""
    return [np.frombuffer(v.as_buffer(), dtype) for v in table.column(column)]


def decoded(table: pa.Table, column: str, how=loose) -> list[np.ndarray]:
    """The arrays in a column written by ``tight``, or by ``tight_steps`` for ``how=loose_steps``."""
    return [how(v.as_buffer()) for v in table.column(column)]


def unpack(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners (class, size), owner of each n-gram, n-grams; a class seen twice counts once."""
    counts = decoded(table, "cnt")
    cls, cnt, n = np.concatenate(decoded(table, "cls", loose_steps)), np.concatenate(counts), np.concatenate(decoded(table, "n"))
    uniq, first = np.unique(cls, return_index=True)
    kept = np.zeros(len(cls), np.int64)
    kept[first] = cnt[first]
    place, total = np.searchsorted(uniq, cls).astype(np.uint32), int(kept.sum())
    if (cnt != cnt[first][place]).any():
        raise ValueError("different sets have the same number")
    owner, grams = np.repeat(place, kept), np.empty(total, dtype)
    row, at = 0, 0
    for c, g in zip(counts, arrays(table, "grams", dtype)):
        k = kept[row:row + len(c)]
        if (m := int(k.sum())) < len(g):
            g = g[np.repeat(k > 0, c)]
        grams[at:at + m] = g
        row, at = row + len(c), at + m
    return uniq, n[first], owner, grams


def _frequent(grams: np.ndarray) -> np.ndarray:
    """How many owners have each n-gram (each has it once)."""
    order = np.argsort(grams)
    _, start, stop = runs(grams[order])
    count = np.empty(len(grams), np.int32)
    count[order] = np.repeat((stop - start).astype(np.int32), stop - start)
    return count


def _shared(buckets: int):
    """Per fragment: how many shared n-grams each class has, packed by class bucket."""
    def run(table: pa.Table) -> pa.Table:
        cls, _, owner, grams = unpack(table, np.uint32)
        # n-gram and owner side by side in 64 bits, sorted in place: a fragment may be most of a worker's memory
        both = np.empty((len(grams), 2), "<u4")
        both[:, 0], both[:, 1] = owner, grams
        del owner, grams
        both.view("<u8")[:, 0].sort()
        same = both[1:, 1] == both[:-1, 1]
        shared = np.zeros(len(both), bool)
        shared[1:] = same
        shared[:-1] |= same
        count = np.bincount(both[shared, 0], minlength=len(cls))
        cls, count = cls[count > 0], count[count > 0]
        b = _bucket(cls, buckets)
        order = np.argsort(b, kind="stable")
        rows = [(int(v), cls[order][i:j].tobytes(), count[order][i:j].astype(np.int64).tobytes()) for v, i, j in zip(*runs(b[order]))]
        return pa.Table.from_batches([_batch(rows, "b int, cls binary, cnt binary")])
    return run


def _counts(buckets: int):
    """Of one fragment: what ``_shared`` counts, in few bytes; of a fragment below 0 the names of numbers, for the bucket they belong to."""
    def run(table: pa.Table) -> pa.Table:
        f = table.column("f")[0].as_py()
        if f < 0:
            rows = [(-1 - f, no, b"", names) for no, names in zip(table.column("cls").to_pylist(), table.column("n").to_pylist())]
        else:
            out = _shared(buckets)(table)
            rows = [(b, tight_steps(cls), tight(cnt), b"") for b, cls, cnt in zip(out.column("b").to_pylist(), arrays(out, "cls"), arrays(out, "cnt"))]
        return pa.Table.from_batches([_batch(rows, COUNTED)])
    return run


def _summed(table: pa.Table) -> pa.Table:
    """Per bucket: the shared n-grams of each class, by the names of the numbers counted."""
    parts = list(zip(decoded(table, "cls", loose_steps), table.column("cnt").to_pylist(), arrays(table, "named")))
    none = np.zeros(0, np.int64)
    no, names = (np.concatenate([none, *x]) for x in ([n for n, _, k in parts if len(k)], [k for _, _, k in parts if len(k)]))
    cls, cnt = (np.concatenate([none, *x]) for x in ([n for n, c, _ in parts if c], [loose(c) for _, c, _ in parts if c]))
    no, first = np.unique(no, return_index=True)
    if not np.isin(cls, no).all():
        raise ValueError("counts of sets without a name")
    uniq, inverse = np.unique(names[first][np.searchsorted(no, cls)], return_inverse=True)
    return pa.table([pa.array(uniq), pa.array(np.bincount(inverse, cnt, len(uniq)).astype(np.int64))], names=["cls", "shared"])


def _segments(width: int, twins: frozenset[int], bits: int):
    """A survivor's set cut into the fragments of the pair count, in full width, and its sketch."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                out = []
                for t in b.column("text").slice(i, SLICE).to_pylist():
                    s = shingle_set(t, width)
                    parity = (np.bincount((s % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
                    cuts = np.searchsorted(s, np.array([(i << 64) // PAIR_FRAGMENTS for i in range(1, PAIR_FRAGMENTS)], np.uint64))
                    out.append((set_key(s, twins, bits), len(s), [part.tobytes() for part in np.split(s, cuts)],
                                np.packbits(parity).view(np.int64).tolist()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                                  pa.array(cols[2], pa.list_(pa.binary())), pa.array(cols[3], pa.list_(pa.int64()))],
                                                 ["name", "n", "segs", "sketch"])
    return run


def _pack_segments(fragments: int):
    """The segments ``seg`` of classes ``cls``, packed."""
    def sets(batches):
        for b in batches:
            yield from zip(b.column("cls").to_pylist(), b.column("n").to_pylist(), arrays(b, "seg", np.uint64))
    return lambda batches: _grouped(sets(batches), lambda *batch: packed(*batch, fragments, True))


def _frequencies(buckets: int):
    """Per fragment: shared n-grams with their frequency, packed by class bucket."""
    def run(table: pa.Table) -> pa.Table:
        cls, n, owner, grams = unpack(table, np.uint64)
        df = _frequent(grams)
        owner, grams, df = owner[df > 1], grams[df > 1], df[df > 1]
        b = (cls % buckets)[owner]
        order = np.lexsort((owner, b))
        rows = []
        for v, i, j in zip(*runs(b[order])):
            of = order[i:j]
            own, start, stop = runs(owner[of])
            rows.append((int(v), tight_steps(cls[own]), tight(n[own]), tight(stop - start), tight(df[of]), grams[of].tobytes()))
        return pa.Table.from_batches([_batch(rows, RANKED)])
    return run


def _prefixes(percent: int):
    """Postings of each class's prefix: n-grams by rising frequency, unshared ones first."""
    def postings(cls, n, df, grams):
        order = np.lexsort((grams, df, cls))
        cls, n, grams = cls[order], n[order], grams[order]
        _, start, stop = runs(cls)
        length = np.repeat(stop - start, stop - start)
        pos = np.arange(len(cls)) - np.repeat(start, stop - start) + (n - length)
        keep = pos <= n - -(-n * percent // 100)
        grams, cls, n, pos = grams[keep], cls[keep], n[keep], pos[keep]
        _, start, stop = runs(cls)
        ahead, behind = np.arange(len(cls)) - np.repeat(start, stop - start), np.repeat(stop, stop - start) - np.arange(len(cls))
        return pa.table([pa.array(grams.view(np.int64)), pa.array(cls), pa.array(n), pa.array(pos),
                         pa.array((ahead < STAR_LISTS) | (behind <= STAR_LISTS))], names=["gram", "cls", "n", "pos", "edge"])

    def run(table: pa.Table) -> pa.Table:
        cls, n, cnt = np.concatenate(decoded(table, "cls", loose_steps)), np.concatenate(decoded(table, "n")), np.concatenate(decoded(table, "cnt"))
        df = np.concatenate([x.astype(np.int32) for x in decoded(table, "df")])
        grams = np.concatenate(arrays(table, "grams", np.uint64))
        uniq, place = np.unique(cls, return_inverse=True)
        # whole classes, so many at a time that they have about GROUP_SHINGLES n-grams
        part = (np.cumsum(np.bincount(place, cnt)) // GROUP_SHINGLES).astype(np.int64)[place]
        out = []
        for p in range(int(part.max(initial=0)) + 1):
            here, of = part == p, np.repeat(part == p, cnt)
            out.append(postings(np.repeat(cls[here], cnt[here]), np.repeat(n[here], cnt[here]), df[of], grams[of]))
        return pa.concat_tables(out)
    return run


def _overlaps(batches):
    for b in batches:
        part = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(arrays(b, "x", np.uint64), arrays(b, "y", np.uint64))]
        names = [c for c in b.schema.names if c not in ("x", "y")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(part, pa.int64())], [*names, "part"])


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs (a, b, al, bl)``, classes and their labels: partial overlaps per fragment, summed per pair.

    Few classes are in a late round's pairs, so a bitmap keeps the others' segments out of the joins."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    s = maybe_in(segments.select("cls", "n", "f", "seg"), "cls", named, 2 * pairs.count(), "maybe").filter("maybe").drop("maybe")
    left = pairs.join(s.withColumnsRenamed({"cls": "a", "n": "na", "seg": "x"}), "a")
    both = left.join(s.withColumnsRenamed({"cls": "b", "n": "nb", "seg": "y"}), ["b", "f"])
    parts = both.select("a", "b", "al", "bl", (F.col("na") + F.col("nb")).alias("size"), "x", "y") \
                .mapInArrow(_overlaps, "a bigint, b bigint, al bigint, bl bigint, size bigint, part bigint")
    # 100 * overlap >= percent * (size - overlap)
    return (parts.groupBy("a", "b", "al", "bl", "size").agg(F.sum("part").alias("overlap"))
            .filter((100 + percent) * F.col("overlap") >= percent * F.col("size")).select("a", "b", "al", "bl"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes in ``edges (a, b)``: the smallest node each one is connected with (labels spread, then jump)."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = (both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        now = durable(step.join(jump, "new").select("node", "label", F.least("new", "far").alias("new")))
        changed = now.filter("label <> new").limit(1).count()
        labels = now.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _can_link(percent: int):
    """Length and place filters on the members x and y of one n-gram's list; none drops a link."""
    both = F.col("xn") + F.col("yn")
    most = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))
    return ((F.col("xlabel") != F.col("ylabel")) & (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
            & ((100 + percent) * most >= percent * both))


def _alike(percent: int):
    """The sketch filter on two classes x and y; it drops no link."""
    differ = sum((F.bit_count(F.col("xsketch")[i].bitwiseXOR(F.col("ysketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("xn") + F.col("yn"))


MEMBER = ("cls", "n", "pos", "label")


def _side(p: DataFrame, name: str, *more: str) -> DataFrame:
    return p.select("gram", *[F.col(c).alias(name + c) for c in (*MEMBER, *more)])


def members(postings: DataFrame, labels: DataFrame, r: int) -> DataFrame:
    """The members of lists that hold several groups, each with its list's representative ``y``.

    Groups only grow, so a list that is in one group now stays out of all later rounds."""
    p = postings.join(labels, F.col("cls") == F.col("node")).drop("node")
    split = p.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                  F.min(F.struct(F.xxhash64("cls", F.lit(r)).alias("k"), *MEMBER)).alias("rep")).filter("lo <> hi")
    # written, so that a long list meets it over a plain exchange, which adaptive execution can split
    split = durable(split.select("gram", *[F.col(f"rep.{c}").alias("y" + c) for c in MEMBER]))
    return durable(p.join(split, "gram"))


def star_pairs(p: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Each of the ``members`` with at most two representatives of its lists it could be linked with."""
    tried = (p.withColumnsRenamed({c: "x" + c for c in MEMBER}).filter(_can_link(percent))
             .select("xcls", "xn", "xlabel", "ycls", "yn", "ylabel").distinct())
    for name in "xy":  # of each pair once, not of each list
        tried = tried.join(sketches.withColumnsRenamed({"cls": f"{name}cls", "sketch": f"{name}sketch"}), f"{name}cls")
    key = F.struct(F.xxhash64("xcls", "ycls").alias("k"), "ycls", "ylabel")
    best = tried.filter(_alike(percent)).groupBy("xcls", "xlabel").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return best.select("xcls", "xlabel", F.explode(F.array("lo", "hi")).alias("y")).select("xcls", "xlabel", "y.ycls", "y.ylabel")


def other_pairs(p: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``members`` that could still join two groups: those outside their list's main group, with all others."""
    p = durable(p.select("gram", *MEMBER).join(sketches, "cls"))
    main = durable(p.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("gram")
                   .agg(F.max(F.struct("m", "label")).alias("top")).select("gram", F.col("top.label").alias("main")))
    x = _side(p.join(main, "gram").filter("label <> main"), "x", "sketch")
    # sketches are compared in the join: a long list has many pairs
    return x.join(_side(p, "y", "sketch"), "gram").filter(_can_link(percent) & _alike(percent)).select("xcls", "xlabel", "ycls", "ylabel")


def connect(postings: DataFrame, segments: DataFrame, sketches: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """``node, label`` for the classes in ``postings``: groups formed by all links."""
    labels = durable(postings.select(F.col("cls").alias("node")).distinct().withColumn("label", F.col("node")))
    r, last = 0, False
    while not last:
        last = r >= star_rounds
        some = r == 0 and not last  # the first round tries a few lists of each class
        p = members(postings.filter("edge") if some else postings, labels, r)
        if not some:
            postings = p.select("gram", "cls", "n", "pos")
        pairs = other_pairs(p, sketches, percent) if last else star_pairs(p, sketches, percent)
        up = lambda x, y: F.when(F.col("xcls") < F.col("ycls"), F.col(x)).otherwise(F.col(y))
        pairs = durable(pairs.select(up("xcls", "ycls").alias("a"), up("ycls", "xcls").alias("b"), up("xlabel", "ylabel").alias("al"),
                                     up("ylabel", "xlabel").alias("bl")).distinct())
        r += 1
        if pairs.isEmpty():
            star_rounds = 0  # stars join nothing more
            continue
        edges = durable(verified(pairs, segments, percent).select(F.col("al").alias("a"), F.col("bl").alias("b")).distinct())
        if edges.isEmpty():
            star_rounds = 0
            continue
        merged = components(edges)
        labels = durable(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
                         .select("node", F.coalesce("root", "label").alias("label")))
    return labels


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
                 star_rounds: int = STAR_ROUNDS, key_bits: int = KEY_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every input row.

    Two texts are linked when 100 x intersection >= ``percent`` x union of
    their sets; ``component_id`` is the smallest id that links reach.  A NULL or
    empty text, or one without words, has no shingles and stays by itself.  A
    row with a NULL id takes no part and gets a NULL component.  Rows that
    repeat an id keep their rows.  Other columns are ignored; an empty table
    gives an empty result.  Ids are cast to bigint.  ``key_bits`` shortens the
    first hash of a set, which changes no result.
    """
    d = texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets, twins = set_classes(d, "doc_id bigint", width, key_bits)
    named = labelled(d.filter("doc_id IS NOT NULL"), sets.filter("doc_id IS NOT NULL"), width, percent, star_rounds, twins, key_bits)
    lowest = named.groupBy("label").agg(F.min("first").alias("component"))
    of_class = named.join(lowest, "label").select("cls", "component")
    return (sets.join(of_class, "cls", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def labelled(d: DataFrame, sets: DataFrame, width: int, percent: int, star_rounds: int, twins: frozenset[int], bits: int = KEY_BITS) -> DataFrame:
    """``cls, first, n, rows, label`` of the classes of ``d (doc_id, text)`` with their ``sets``: smallest id, set size, rows, group formed by all links.

    Rows with a NULL id take part like all others; a class of such rows only has a NULL ``first``."""
    classes = durable(sets.filter("cls IS NOT NULL").groupBy("cls")
                      .agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")))

    # a multiple, so that each of these fragments lies within one fragment of the pair count
    fragments = PAIR_FRAGMENTS * max(1, -(-FRAGMENTS_PER_TASK * d.rdd.getNumPartitions() // PAIR_FRAGMENTS))
    # a copy of a set that gets through to another task only makes the set's n-grams look shared
    firsts = maybe_in(d, "doc_id", classes.select(F.col("first").alias("doc_id")), classes.count(), "maybe").filter("maybe")
    shared = (firsts.select("text").mapInArrow(_pack(width, fragments, twins, bits), PACKED)
              .groupBy("f").applyInArrow(_counts(fragments), COUNTED)
              .groupBy("b").applyInArrow(_summed, "cls bigint, shared bigint")
              .groupBy("cls").agg(F.sum("shared").alias("shared")))
    survivors = durable(classes.join(shared, "cls").filter(100 * F.col("shared") >= percent * F.col("n")).select("first"))

    # only ids travel to the texts; from here on a number stands for the class it names
    numbers = durable(d.join(survivors, d["doc_id"].eqNullSafe(survivors["first"]), "left_semi").select("text")
                      .mapInArrow(_segments(width, twins, bits), "name bigint, n bigint, segs array<binary>, sketch array<bigint>")
                      .dropDuplicates(["name"]).withColumn("cls", F.monotonically_increasing_id()))
    segments = numbers.select("cls", "n", F.posexplode("segs").alias("f", "seg"))
    postings = durable(segments.mapInArrow(_pack_segments(fragments), PACKED)
                       .groupBy("f").applyInArrow(_frequencies(fragments), RANKED)
                       .groupBy("b").applyInArrow(_prefixes(percent), "gram bigint, cls bigint, n bigint, pos bigint, edge boolean"))

    groups = connect(postings, segments, numbers.select("cls", "sketch"), percent, star_rounds)
    for c in ("node", "label"):
        groups = groups.join(numbers.select(F.col("cls").alias(c), F.col("name").alias(f"{c}_name")), c).drop(c)
    return (classes.join(groups, F.col("cls") == F.col("node_name"), "left")
            .select("cls", "first", "n", "rows", F.coalesce("label_name", "cls").alias("label")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest id, for each group of linked texts.

    Rows are told apart by id and text: a row that shares only its id with a
    dropped one stays.  Rows with a NULL id take part here; they sort after
    every other.  Of rows that repeat the smallest id within a group one stays,
    and of a group without ids one.  Texts without words are linked with none
    and stay.
    """
    digest = lambda text: F.sha2(text, 256)
    d = texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets, twins = set_classes(d.withColumn("digest", digest(F.col("text"))), "doc_id bigint, digest string", WIDTH, KEY_BITS)
    named = durable(labelled(d, sets, WIDTH, PERCENT, STAR_ROUNDS, twins).select("cls", "label", "rows"))
    # most rows are alone in their group: only the others' digests move
    several = durable(named.groupBy("label").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("label"))
    shared = durable(named.join(several, "label", "left_semi").select("cls", "label"))
    rows = maybe_in(sets, "cls", shared, shared.count(), "maybe").filter("maybe").join(shared, "cls").select("label", "doc_id", "digest")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    groups = rows.groupBy("label").agg(F.min(order).alias("best"))
    return without_copies(docs, rows.join(groups, "label").select("doc_id", "digest", (order == F.col("best")).alias("kept")), id_col, text_col, digest)
