"""The conversation trie against a trie built in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rinse.llm import prefix_trie

DDL = "conv_id bigint, turn bigint, role string, text string, depth string, slice int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = []
    if own:
        nodes.append({"parent": None, "kids": {}, "members": [], "ends": [], "text": "", "depth": 0})
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        v = 0
        nodes[0]["members"].append(c)
        for turn in own.get(c - c % 100, [])[:h] + own[c][h:]:
            if turn not in nodes[v]["kids"]:
                nodes.append({"parent": v, "kids": {}, "members": [], "ends": [], "text": turn[1], "depth": nodes[v]["depth"] + 1})
                nodes[v]["kids"][turn] = len(nodes) - 1
            v = nodes[v]["kids"][turn]
            nodes[v]["members"].append(c)
        nodes[v]["ends"].append(c)
    for v in nodes:
        v["leaves"], v["saved"] = int(not v["kids"]), (len(v["members"]) - 1) * len(v["text"])
    for v in reversed(nodes[1:]):
        nodes[v["parent"]]["leaves"] += v["leaves"]
        nodes[v["parent"]]["saved"] += v["saved"]
    return sorted(((min(v["members"]), v["depth"], None if v["parent"] is None else min(nodes[v["parent"]]["members"]), len(v["members"]),
                    len(v["kids"]), v["leaves"], v["saved"], hashlib.sha256(",".join(map(str, v["ends"])).encode()).hexdigest()) for v in nodes), key=repr)


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).select(*COLUMNS).collect()), key=repr)


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(df) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    """Few texts, so that prefixes meet across bases; NULLs, missing bases, turnless, very long and equal conversations."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(430), 160):
        rows += [(c, rng.choice([None, *range(4)]) if k == 0 else k + 4, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "hi", "", None, "öffnen"])) for k in range(rng.choice((1, 2, 3, 9)))]
    rows += [(900, k, "user", f"t{k % 3}") for k in range(700)] + [(901, k, "user", f"t{k % 3}") for k in range(700)] + [(None, 1, "user", "hi")]
    rows += [(c, None, None, "x" * 4000) for c in (10_003, 10_004, 10_005)]     # their base is not there
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(5)
    assert got(df) == brute(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], DDL)) == []


def test_turns_that_tie_are_ordered_by_role(spark):
    rows = [(5, 1, "b", "x"), (5, 1, "a", "y"), (5, 1, "a", "y"), (7, 1, "b", "x")]
    out = got(spark.createDataFrame([(*r, "x", 1) for r in rows], DDL))
    assert out == brute(rows)


def test_block_runs():
    """Every run of a block is a chain of links inside it."""
    arc, succ = np.array([4, 5, 6, 7]), np.array([6, 4, 99, -1])
    out = prefix_trie._runs_of_block(pa.table({"arc": arc, "succ": succ})).to_pylist()
    assert [(r["arc"], r["head"], r["place"], r["length"], r["onward"]) for r in out] == [(4, 5, 1, 3, 99), (5, 5, 0, 3, 99), (6, 5, 2, 3, 99), (7, 7, 0, 1, -1)]


def test_list_ranking_of_a_shuffled_list(spark):
    order = list(range(40_000))
    random.Random(3).shuffle(order)
    pairs = list(zip(order, [*order[1:], -1]))
    out = prefix_trie.positions(spark.createDataFrame(pairs, "arc bigint, succ bigint")).collect()
    assert sorted((r["pos"], r["arc"]) for r in out) == list(enumerate(order))
