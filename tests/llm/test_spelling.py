"""Spelling groups against all pairs by edit distance."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from rinse.llm import spelling

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, word string, n string"


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(rows, min_length=7, min_count=2, ratio=10, every=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    n = {w: k for w, k in count.items() if len(w) >= min_length and k >= min_count}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), k, len(close[w]), n[form[w]] if w in form else None) for w, k in n.items())


def got(df, **more):
    return sorted(tuple(r) for r in spelling.spelling_groups(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def key(rows):
    return sorted(rows, key=repr)


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert key(got(docs)) == key(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_odd_rows(spark):
    chain = "".join(f"{w} " * n for w, n in (("mnopqrst", 900), ("mnopqrsx", 60), ("mnopqyxx", 2), ("mnopqrxx", 5), ("mnopqsxx", 5)))     # forms of forms
    rows = [(1, None), (2, ""), (20, chain), (None, "Straßenbahn STRASSENBAHN straÃenbahn"), (None, "ÀÁÂÃÄÅÆ ÀÁÂÃÄÅÆ àáâãäåæ"), (5, "a" * 3000 + " " + "a" * 2999),
            (5, "a" * 3000 + " " + "a" * 2999), (6, "gfedcba gfedcba abcdefg abcdefg"), (7, "bcdefgh xabcdefgh bcdefgh xabcdefgh")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DDL)
    want = brute(rows)
    assert key(got(df)) == key(want)
    assert max(len(r[0]) for r in want) >= 2999 and any(r[1] and r[2] != r[1] for r in want)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], DDL)) == []


def test_every_near_pair_meets_once(spark):
    """Random words over few letters: many anagrams, repeated letters and shared ends."""
    import random
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((7, 8, 9)))) for _ in range(900)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    pairs = sorted((r["a"], r["b"]) for r in spelling.near_pairs(df).collect())
    assert pairs == [(a, b) for k, a in enumerate(words) for b in words[k + 1:] if near(a, b)]


def test_guards_cover_every_split():
    for m in range(3, 12):
        g = spelling.guards(m)
        assert all(any(p >= a and s >= b for a, b in g) for p in range(m) for s in range(m) if p + s >= m - 1)
