"""Prefix trie of conversations by the Euler-tour technique.

1. Turns are numbered in their conversation and each gets a 128-bit key of the
   prefix that ends with it: the exclusive or of hashes salted with the place.
   Numbers and keys are running values over contiguous slices of all turns in
   order, so a conversation of any length is spread over tasks.  Texts never
   move; a turn is its hashes and its length.
2. Rows of one prefix are one node.  A node is known by its smallest member
   and its depth, as a conversation has one prefix per depth.
3. Each node has an enter and an exit arc.  An enter arc goes on to the first
   child, or to its own exit; an exit arc to the next sibling, or to the
   parent's exit.  That linked list is ranked: blocks of arc numbers shorten
   their own runs to one link each, and pointer jumping ranks what is left.
   Nodes are numbered along their smallest members, so most links stay inside
   a block.
4. With positions known, leaves and savings of a subtree are differences of
   prefix sums between a node's two arcs.

No group of rows meets in one task: counts are pre-aggregated, a node with many
children appears once on each side of the joins, except for naming the parent,
which joins written tables whose skewed parts adaptive execution splits.  The
digest of the conversations that end at a node is streamed over blocks of ids,
because SHA-256 is sequential: one task reads a node's ids in order, in bounded
memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinse.llm.common import durable, shuffle_parts

HEAD_TURNS = 6        # a rebuilt conversation takes fewer turns than this from its base
BASE_EVERY = 100
ARC_BLOCK = 1 << 14   # arcs that one group of the local contraction holds
ID_BLOCK = 1 << 12    # ids in one row of the digest's input
BEFORE = Window.unboundedPreceding


def _sliced(df: DataFrame, *order, name: str) -> DataFrame:
    """``df`` written in contiguous slices of ``order``, numbered by ``slice``."""
    parts = shuffle_parts(df.sparkSession)
    return durable(df.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()), name)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, ord, n_own, slice, h1, h2, chars``: turns numbered from 1 in each conversation.

    Order: turn (NULL first), role, then the hashes of the text; a NULL role or text is empty.  Rows without conv_id belong nowhere.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit("1"), role, text).alias("h1"), F.xxhash64(F.lit("2"), role, text).alias("h2"),
        F.char_length(text).cast("bigint").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    rows = _sliced(rows, "conv_id", *order, name="turns")
    totals = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(BEFORE, -1)
    whole = Window.partitionBy("conv_id")
    offsets = totals.select("conv_id", "slice", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("off"), F.sum("here").over(whole).alias("n_own"))
    local = Window.partitionBy("conv_id", "slice").orderBy(*order)
    return rows.withColumn("i", F.row_number().over(local)).join(offsets, ["conv_id", "slice"]).select(
        "conv_id", (F.col("off") + F.col("i")).alias("ord"), "n_own", "slice", "h1", "h2", "chars")


def rebuild(turns: DataFrame, head_turns: int = HEAD_TURNS, base_every: int = BASE_EVERY) -> tuple[DataFrame, DataFrame]:
    """``(convs, rows)`` of the rebuilt conversations.

    ``convs``: ``conv_id, length, r1, r2`` with the key of the whole conversation.
    ``rows``: ``conv_id, depth, k1, k2, p1, p2, chars``: the key of each prefix and that of the prefix before.
    """
    salted = lambda place: [F.xxhash64(place.cast("bigint"), "h1").alias("x1"), F.xxhash64(place.cast("bigint"), "h2").alias("x2")]
    xor = lambda c, w: F.coalesce(F.expr(f"bit_xor({c})").over(w), F.lit(0).cast("bigint"))

    # the first turns of the bases with the keys of their prefixes: fewer than head_turns rows each
    w = Window.partitionBy("base").orderBy("ord").rowsBetween(BEFORE, 0)
    heads = (turns.filter((F.col("conv_id") % base_every == 0) & (F.col("ord") < head_turns))
             .select(F.col("conv_id").alias("base"), "ord", "chars", "n_own", *salted(F.col("ord")))
             .select("base", "ord", "chars", "n_own", "x1", "x2", xor("x1", w).alias("k1"), xor("x2", w).alias("k2")))
    heads = durable(heads, "heads")
    sizes = heads.groupBy("base").agg(F.max("n_own").alias("n_base"))
    convs = (turns.groupBy("conv_id").agg(F.max("n_own").alias("n_own"))
             .withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % head_turns, "base": F.col("conv_id") - F.col("conv_id") % base_every})
             .join(sizes, "base", "left")
             .withColumn("from_base", F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint")))))
    ends = heads.select("base", F.col("ord").alias("from_base"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    convs = durable(convs.join(ends, ["base", "from_base"], "left").select(
        "conv_id", "base", "h", "from_base", (F.col("from_base") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"),
        F.coalesce("b1", F.lit(0).cast("bigint")).alias("b1"), F.coalesce("b2", F.lit(0).cast("bigint")).alias("b2")), "convs")

    from_base = (convs.select("conv_id", "base", "from_base").join(heads, "base").filter("ord <= from_base")
                 .select("conv_id", F.col("ord").alias("depth"), "k1", "k2", F.expr("k1 ^ x1 AS p1"), F.expr("k2 ^ x2 AS p2"), "chars"))

    # a conversation's own turns: running keys within a slice, then those of its earlier slices and of its base
    place = F.col("ord") - F.col("h") + F.col("from_base")
    own = (turns.join(convs.select("conv_id", "h", "from_base", "b1", "b2"), "conv_id").filter("ord > h")
           .select("conv_id", "slice", "b1", "b2", "chars", place.alias("depth"), *salted(place)))
    local = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(BEFORE, 0)
    own = durable(own.withColumns({"k1": xor("x1", local), "k2": xor("x2", local)}), "own")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(BEFORE, -1)
    totals = own.groupBy("conv_id", "slice").agg(F.expr("bit_xor(x1)").alias("t1"), F.expr("bit_xor(x2)").alias("t2"))
    carried = totals.select("conv_id", "slice", xor("t1", earlier).alias("o1"), xor("t2", earlier).alias("o2"))
    own = own.join(carried, ["conv_id", "slice"]).selectExpr(
        "conv_id", "depth", "k1 ^ o1 ^ b1 AS k1", "k2 ^ o2 ^ b2 AS k2", "k1 ^ o1 ^ b1 ^ x1 AS p1", "k2 ^ o2 ^ b2 ^ x2 AS p2", "chars")
    return convs, from_base.unionByName(own)


def _sha_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined ids; rows come sorted by node and block, so one hash state is open at a time."""
    open_key, state = None, None

    def closed(keys: list, digests: list) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=["depth", "k1", "k2", "sha"])

    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2"))), batch.column("ids").to_pylist()):
            if key != open_key:
                if state is not None:
                    keys.append(open_key)
                    digests.append(state.hexdigest())
                open_key, state = key, hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield closed(keys, digests)
    if state is not None:
        yield closed([open_key], [state.hexdigest()])


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, sha`` of the conversations ``conv_id`` that end at each key."""
    # ids of one block sort like numbers, and blocks do: decimal ids never meet as a whole group
    blocks = (ends.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    return (blocks.repartition(shuffle_parts(ends.sparkSession), "depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "block")
            .select("depth", "k1", "k2", "ids").mapInArrow(_sha_of_blocks, "depth bigint, k1 bigint, k2 bigint, sha string"))


def _runs_of_block(table: pa.Table) -> pa.Table:
    """The arcs of one block with the head of the run each is in, their place there, the run's length and where it goes on."""
    arc, succ = table.column("arc").to_numpy(), table.column("succ").to_numpy()
    order = np.argsort(arc)
    arc, succ = arc[order], succ[order]
    n = len(arc)
    at = np.searchsorted(arc, succ)
    inside = (at < n) & (arc[np.minimum(at, n - 1)] == succ)
    back = np.arange(n)                     # the arc before, inside the block; itself at the head of a run
    back[at[inside]] = np.flatnonzero(inside)
    place = (back != np.arange(n)).astype(np.int64)
    while True:
        further = back[back]
        if np.array_equal(further, back):
            break
        place += place[back]
        back = further
    length = np.bincount(back, minlength=n)
    onward = np.full(n, -1)
    onward[back[~inside]] = succ[~inside]   # the last arc of a run leaves the block
    return pa.table({"arc": arc, "head": arc[back], "place": place, "length": length[back], "onward": onward[back]})


def positions(arcs: DataFrame) -> DataFrame:
    """``arc, pos``: the place of each arc in the list ``arc, succ`` (-1 ends it), from 0."""
    runs = durable(arcs.groupBy(F.floor(F.col("arc") / ARC_BLOCK)).applyInArrow(
        _runs_of_block, "arc bigint, head bigint, place bigint, length bigint, onward bigint"), "runs")
    # rank of a run: arcs from its head to the end of the list
    jumps = durable(runs.filter("arc = head").select("head", "length", F.col("onward").alias("next")), "jumps")
    while not jumps.filter("next >= 0").isEmpty():
        ahead = jumps.select(F.col("head").alias("next"), F.col("length").alias("more"), F.col("next").alias("beyond"))
        jumps = durable(jumps.join(ahead, "next", "left").select(
            "head", (F.col("length") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("length"), F.coalesce("beyond", F.lit(-1).cast("bigint")).alias("next")), "jumps")
    total = jumps.agg(F.max("length")).first()[0] or 0
    return runs.select("arc", "head", "place").join(jumps.select("head", F.col("length").alias("rest")), "head").select(
        "arc", (F.lit(total) - F.col("rest") + F.col("place")).alias("pos"))


def _tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(numbered, arcs)``: nodes with a dense number ``no`` and their first child; the arcs 2 no (enter) and 2 no + 1 (exit) with their successors.

    ``nodes`` has ``conv_id, depth, parent_conv_id`` and more columns.
    """
    rows = _sliced(nodes, "conv_id", "depth", name="nodes")
    counts = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("here"))
    offsets = counts.select("slice", F.coalesce(F.sum("here").over(Window.orderBy("slice").rowsBetween(BEFORE, -1)), F.lit(0)).alias("off"))
    local = Window.partitionBy("slice").orderBy("conv_id", "depth")
    numbered = durable(rows.withColumn("i", F.row_number().over(local)).join(offsets, "slice").withColumn("no", F.col("off") + F.col("i") - 1).drop("i", "off", "slice"), "numbered")

    # siblings in order of their smallest member, over slices: the row after the last of a slice heads a later one
    children = _sliced(numbered.filter("depth > 0").select("parent_conv_id", "depth", "conv_id", "no"), "parent_conv_id", "depth", "conv_id", name="children")
    here = Window.partitionBy("slice").orderBy("parent_conv_id", "depth", "conv_id")
    firsts = children.groupBy("slice").agg(F.min(F.struct("parent_conv_id", "depth", "conv_id", "no")).alias("first"))
    onward = firsts.select("slice", F.lead("first").over(Window.orderBy("slice")).alias("first"))
    after = F.struct("parent_conv_id", "depth", "conv_id", "no")
    nexts = (children.withColumn("after", F.lead(after).over(here)).join(onward, "slice", "left").withColumn("after", F.coalesce("after", "first"))
             .filter("after.parent_conv_id = parent_conv_id AND after.depth = depth").select("no", F.col("after.no").alias("next_no")))

    families = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.count(F.lit(1)).alias("n_children"))
    numbered = durable(numbered.join(families, ["conv_id", "depth"], "left"), "families")
    parents = numbered.filter("last_no IS NOT NULL").select(F.col("last_no").alias("no"), F.col("no").alias("parent_no"))
    linked = numbered.select("no", "first_no").join(nexts, "no", "left").join(parents, "no", "left")
    arcs = linked.select(F.explode(F.array(
        F.struct((2 * F.col("no")).alias("arc"), F.coalesce(2 * F.col("first_no"), 2 * F.col("no") + 1).alias("succ")),
        F.struct((2 * F.col("no") + 1).alias("arc"), F.coalesce(2 * F.col("next_no"), 2 * F.col("parent_no") + 1, F.lit(-1).cast("bigint")).alias("succ")))).alias("a")).select("a.*")
    return numbered, arcs


def prefix_trie(conversations: DataFrame, head_turns: int = HEAD_TURNS, base_every: int = BASE_EVERY) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: NULL), ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree, ``ends_sha256`` of the conversations that end there.

    NULL roles and texts are empty; NULL turns come first; rows that tie on turn are ordered by role and then by hashes of the
    text; repeated rows are turns of their own.  Rows without conv_id are left out.  Texts of any length count whole.  Other
    columns are ignored.  An empty table has no node, not even a root.
    """
    spark = conversations.sparkSession
    convs, rows = rebuild(durable(turns_of(conversations), "numbered-turns"), head_turns, base_every)
    rows = durable(rows, "prefixes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("chars"))
    nodes = durable(rows.groupBy("depth", "k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars")).unionByName(root), "keys")

    last = rows.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", "k1", "k2")
    turnless = convs.filter("length = 0").select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "k1", "k2")])
    sha = ends_digest(last.unionByName(turnless))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = (nodes.join(parent, ["depth", "p1", "p2"], "left").join(sha, ["depth", "k1", "k2"], "left")
             .select("conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
                     F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))

    numbered, arcs = _tour(named)
    where = positions(arcs)
    value = numbered.select((2 * F.col("no")).alias("arc"), F.expr("cast(n_children IS NULL AS bigint)").alias("leaf"), "saved")
    width = max(1, -(-2 * numbered.count() // shuffle_parts(spark)))
    placed = durable(where.join(value, "arc", "left").select(
        "arc", "pos", F.floor(F.col("pos") / width).alias("slice"), F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf"),
        F.coalesce("saved", F.lit(0).cast("bigint")).alias("saved")), "placed")
    local = Window.partitionBy("slice").orderBy("pos").rowsBetween(BEFORE, 0)
    earlier = Window.orderBy("slice").rowsBetween(BEFORE, -1)
    totals = placed.groupBy("slice").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    offsets = totals.select("slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in ("leaf", "saved")])
    sums = (placed.withColumns({f"{c}_sum": F.sum(c).over(local) for c in ("leaf", "saved")}).join(offsets, "slice"))
    # exit minus enter, plus the node's own value
    of = lambda c: F.sum(F.when(F.col("arc") % 2 == 1, F.col(f"{c}_sum") + F.col(f"{c}_off")).otherwise(F.col(c) - F.col(f"{c}_sum") - F.col(f"{c}_off")))
    subtree = sums.groupBy(F.floor(F.col("arc") / 2).alias("no")).agg(of("leaf").alias("n_leaves"), of("saved").alias("saved_tokens"))
    return numbered.join(subtree, "no").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        "n_leaves", "saved_tokens", "ends_sha256")
