"""Operators on documents against brute force, on the small table and on odd rows."""

from __future__ import annotations

import collections
import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import rows_of

from rinse.llm import exact_dedup, jaccard_join, license_scan, quality_rules

SMALL = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["table", "odd"])
def docs(request, spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet") if request.param == "table" else request.getfixturevalue("odd")


def test_exact_dedup(docs):
    want = brute.exact_groups(pairs(docs))
    got = rows_of(exact_dedup.exact_dedup(docs, digest_all=True), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(((i, *v) for i, v in want.items()), key=repr)
    lazy = rows_of(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert lazy == [x[:4] for x in got]


def test_exact_dedup_decides_on_whole_text(spark):
    head = "p" * 400
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a"), (None, head + "a")], "doc_id bigint, text string")
    got = rows_of(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 1, 3, True), (2, 2, 1, True), (3, 1, 3, False), (None, 1, 3, False)], key=repr)


def test_quality_counts(docs):
    got = rows_of(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in pairs(docs):
        c = brute.quality_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=repr)


def test_quality_model_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    good = [got[i]["kept"] for i, q in labels if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.2
    assert not any(r["kept"] for r in got.values() if r["base_failed"])


def votes_of(spark, n):
    """Random votes of a good and a bad class; every rule right more often than wrong."""
    rnd = random.Random(3)
    rows = [tuple(rnd.choices([g, -g, 0], [5, 1, 2])[0] for _ in quality_rules.RULES) for g in (rnd.choice([1, 1, -1]) for _ in range(n))]
    return rows, spark.createDataFrame(rows, ", ".join(f"v_{r} int" for r in quality_rules.RULES))


def test_rule_model_equals_em_over_rows(spark):
    rows, df = votes_of(spark, 500)
    model = quality_rules.fit_rules(df)
    v = np.array(rows)
    p = ((v == 1).sum(1) + 1) / ((v == 1).sum(1) + 3 * (v == -1).sum(1) + 2)
    for _ in range(400):  # far beyond the tolerance
        g, b = p.sum(), (1 - p).sum()
        prior = (g + 1) / (g + b + 2)
        logs = {x: (np.log(((v == x) * p[:, None]).sum(0) + 1) - np.log(g + 3), np.log(((v == x) * (1 - p)[:, None]).sum(0) + 1) - np.log(b + 3))
                for x in (1, -1, 0)}
        odds = np.log(prior / (1 - prior)) + sum(((v == x) * (good - bad)).sum(1) for x, (good, bad) in logs.items())
        p = 1 / (1 + np.exp(-odds))
    got = [r["p"] for r in df.select("*", model.posterior().alias("p")).collect()]
    assert abs(model.prior - prior) < 1e-3 and np.abs(np.array(got) - p).max() < 1e-2


def test_rule_model_raises_when_it_does_not_settle(spark):
    with pytest.raises(RuntimeError, match="not settled"):
        quality_rules.fit_rules(votes_of(spark, 500)[1], most_iterations=2)


def test_keep_good_returns_the_input_columns(odd):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.quality_rules(odd).filter("kept").collect()}


def test_license_base_places(docs):
    got = rows_of(license_scan.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute.license_base(t, license_scan.BASE)) for i, t in pairs(docs)), key=repr)


def test_license_labels(spark):
    mit = license_scan.NOTICES[0][1].split()
    texts = {1: " ".join(mit), 2: " ".join(mit[:9] + ["new", "words"] + mit[9:]), 3: " ".join(mit[:9]), 4: "Licensed under CC BY-NC 4.0",
             5: "the GNU General Public License; gnu general, public license", 6: None, 7: " ".join(mit[:12] + mit[14:])}
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["mit", "mit", "", "cc-by,cc-by-nc", "gpl", "", "mit"]
    assert got[1]["score"] == 1.0 and 0.7 <= got[2]["score"] < 1.0 and got[3]["score"] == 0.0
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"]) == (2, 1, 5)


def test_license_scan_keeps_every_row(spark):
    df = spark.createDataFrame([(None, "mit license"), (None, "mit license"), (3, "x"), (3, "x")], "doc_id bigint, text string")
    assert rows_of(license_scan.license_scan(df), "doc_id", "n_base") == sorted([(None, 1), (None, 1), (3, 0), (3, 0)], key=repr)


@pytest.mark.parametrize("key_bits", [5, 64])  # at 5 bits nearly every first hash is shared by different sets
def test_jaccard_join(docs, key_bits):
    want = brute.jaccard_components(pairs(docs))
    assert rows_of(jaccard_join.jaccard_join(docs, key_bits=key_bits), "doc_id", "n_shingles", "component_id") == sorted(((i, *v) for i, v in want.items()), key=repr)


@pytest.mark.parametrize("star_rounds", [0, 2])
def test_jaccard_join_on_one_large_group(spark, star_rounds):
    """A chain-like group whose members are linked to some only, beside texts that share a passage."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(110)]
    rows = []
    for i in range(220):
        t = list(base)
        if i % 3 == 2:
            t = [rnd.choice(words) for _ in range(rnd.randint(20, 150))] + base[:30]
        else:
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute.jaccard_components(rows)
    assert rows_of(jaccard_join.jaccard_join(df, star_rounds=star_rounds), "doc_id", "n_shingles", "component_id") == sorted(((i, *v) for i, v in want.items()), key=repr)


def test_jaccard_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (1, t), (5, None)], "doc_id bigint, text string")
    got = rows_of(jaccard_join.jaccard_join(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(None, 5, None), (2, 5, 1), (2, 5, 1), (1, 5, 1), (5, 0, 5)], key=repr)


def test_copies_are_packed_once_a_task(monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 3)
    batches = [pa.RecordBatch.from_pydict({"text": ["a b c d e", "x", "", "A  b c d e", "x"]})] * 4
    out = pa.Table.from_batches(jaccard_join._pack(4, 2)(iter(batches)))
    # two shingles of the first text, one of the second
    assert sum(len(x) // 4 for x in out.column("grams").to_pylist()) == 3


def _peak(f, *args):
    """What ``f`` returns and the most bytes it held beside its input."""
    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _lists(table):
    """class -> its values, of rows packed by class bucket."""
    out = collections.defaultdict(int)
    for c, k in zip(table.column("cls").to_pylist(), table.column("cnt").to_pylist()):
        for x, v in zip(np.frombuffer(c, np.int64).tolist(), np.frombuffer(k, np.int64).tolist()):
            out[x] += v
    return dict(out)


def test_fragments_are_counted_in_little_memory():
    """Per n-gram of a fragment the counting holds little more than the n-gram beside its owner; a class that comes twice counts once."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**19, 600).astype(np.uint64)) for _ in range(600)]
    keys = [int(k) for k in rng.integers(-2**62, 2**62, len(sets))]
    rows = [r for a in range(0, 600, 100) for r in jaccard_join.packed(keys[a:a + 100], [0] * 100, sets[a:a + 100], 1, False)]
    rows += jaccard_join.packed(keys[:7], [0] * 7, sets[:7], 1, False)
    table = pa.Table.from_batches([jaccard_join._batch(rows)])
    out, peak = _peak(jaccard_join._shared(5), table)
    often = collections.Counter(x for s in sets for x in s.tolist())
    want = {k: sum(often[x] > 1 for x in s.tolist()) for k, s in zip(keys, sets)}
    assert _lists(out) == {k: v for k, v in want.items() if v}
    assert peak < 30 * sum(map(len, sets))


def test_prefixes_of_many_classes(monkeypatch):
    """Classes taken a few at a time have the postings of a plain count, with less memory at once."""
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 500)
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**64, 20, np.uint64), rng.integers(0, 400, 80, np.uint64) << np.uint64(55)])) for _ in range(60)]
    keys = [int(k) for k in rng.integers(-2**62, 2**62, len(sets))]
    sizes = [len(s) for s in sets]
    segments = pa.RecordBatch.from_pydict({"cls": keys, "n": sizes, "seg": [s.tobytes() for s in sets]})
    batches = list(jaccard_join._pack_segments(4)(iter([segments])))
    assert len(batches) > 5
    packs = pa.Table.from_batches(batches)
    of = lambda t, c, v: t.filter(pa.array([x == v for x in t.column(c).to_pylist()]))
    ranked = pa.concat_tables([jaccard_join._frequencies(3)(of(packs, "f", f)) for f in range(4)])
    got = [r for b in range(3) for r in jaccard_join._prefixes(85)(of(ranked, "b", b)).to_pylist()]
    often = collections.Counter(x for s in sets for x in s.tolist())
    want = []
    for k, n, s in zip(keys, sizes, sets):
        first = sorted((x for x in s.tolist() if often[x] > 1), key=lambda x: (often[x], x))
        of_k = [(int(np.uint64(x).view(np.int64)), k, n, i + n - len(first)) for i, x in enumerate(first) if i + n - len(first) <= n - -(-n * 85 // 100)]
        want += [(*r, i < 4 or i >= len(of_k) - 4) for i, r in enumerate(of_k)]
    assert sorted(tuple(r.values()) for r in got) == sorted(want)


def test_texts_are_turned_into_objects_a_few_at_a_time():
    texts = pa.array([f"{i} " + "x" * 4_000 for i in range(2_000)])
    n, peak = _peak(lambda: sum(1 for _ in jaccard_join.some_at_a_time(texts)))
    assert n == 2_000 and peak < 3_000_000


def test_only_segments_of_a_rounds_pairs_are_joined(spark, monkeypatch):
    """A thousand classes, one pair: the joins get the segments of two classes (and few that share their bits)."""
    seg = lambda v: np.arange(v, v + 20, dtype=np.uint64).tobytes()
    segments = spark.createDataFrame([(i, 40, f, bytearray(seg(0 if i < 2 else 50 * i)), None) for i in range(1000) for f in range(2)],
                                     "cls bigint, n bigint, f int, seg binary, sketch array<bigint>")
    pairs = spark.createDataFrame([(0, 1, 10, 11)], "a bigint, b bigint, al bigint, bl bigint")
    kept = []
    real = jaccard_join.maybe_in
    monkeypatch.setattr(jaccard_join, "maybe_in", lambda *a: kept.append(real(*a)) or kept[-1])
    assert [tuple(r) for r in jaccard_join.verified(pairs, segments, 85).collect()] == [(0, 1, 10, 11)]
    assert 4 <= kept[0].filter("maybe").count() < 40


def test_numbers_survive_the_short_form():
    rng = np.random.default_rng(5)
    whole = np.iinfo(np.int64)
    for x in ([], [0], [254, 255, 256], [65_535, 0, 2**32 - 1, 2**32], [whole.min, -1, whole.max, 0], rng.integers(whole.min, whole.max, 300),
              np.arange(900) + (7 << 33), np.concatenate([np.arange(300), np.arange(300) + (1 << 33)])):
        x = np.array(x, np.int64)
        assert np.array_equal(jaccard_join.loose(jaccard_join.tight(x)), x)
        if len(x):
            assert np.array_equal(jaccard_join.loose_steps(jaccard_join.tight_steps(x)), x)
    assert len(jaccard_join.tight_steps(np.arange(900) + (7 << 33))) < 950


def _bytes(batches):
    return sum(len(v) for b in batches for c in b.schema.names if c not in ("f", "b") for v in b.column(c).to_pylist())


def test_packed_rows_grow_with_the_ngrams_not_with_the_fragments():
    """The more input, the more fragments; in the end a row has an n-gram of each set, which once took 24 bytes besides."""
    rnd = random.Random(6)
    texts = pa.RecordBatch.from_pydict({"text": [" ".join(str(rnd.random()) for _ in range(203)) for _ in range(300)]})
    few, many = (_bytes(jaccard_join._pack(4, f)(iter([texts]))) / 60_000 for f in (4, 600))
    assert few < 5 and many < 7
    segments = pa.RecordBatch.from_pydict({"cls": [(3 << 33) + i for i in range(300)], "n": [200] * 300, "seg": [rnd.randbytes(1600) for _ in range(300)]})
    packs = [pa.Table.from_batches(jaccard_join._pack_segments(f)(iter([segments]))) for f in (4, 600)]
    few, many = (_bytes(p.to_batches()) / 60_000 for p in packs)
    assert few < 9 and many < 12


def _shared_of(sets, tasks, fragments):
    """Shared n-grams of each class, by the packing of ``tasks``, each the places of its sets; and the packed rows."""
    packs = pa.concat_tables(
        pa.Table.from_batches(jaccard_join._grouped(((k, 0, sets[k]) for k in t), lambda *b: jaccard_join.numbered(*b, fragments))) for t in tasks)
    groups = lambda t, c: [t.filter(pa.array([x == v for x in t.column(c).to_pylist()])) for v in sorted(set(t.column(c).to_pylist()))]
    counted = pa.concat_tables(jaccard_join._counts(fragments)(g) for g in groups(packs, "f"))
    out = collections.Counter()
    for g in groups(counted, "b"):
        for r in jaccard_join._summed(g).to_pylist():
            out[r["cls"]] += r["shared"]
    return dict(out), packs, counted


def test_numbered_sets_are_counted_by_class(monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 700)
    rng = np.random.default_rng(8)
    sets = {int(k): np.unique(rng.integers(0, 900, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for k in rng.integers(-2**62, 2**62, 90)}
    keys = list(sets)
    often = collections.Counter(x for s in sets.values() for x in s.tolist())
    want = {k: sum(often[x] > 1 for x in s.tolist()) for k, s in sets.items()}
    got, packs, counted = _shared_of(sets, [keys[:40], keys[40:]], 5)
    assert got == want
    # the same rows once more count once, a class that is packed twice in other company counts no less
    assert _shared_of(sets, [keys[:40], keys[40:], keys[:40]], 5)[0] == want
    again = _shared_of(sets, [keys, keys[50:60]], 5)[0]
    assert all(again[k] >= v for k, v in want.items())
    # names that are missing, or one number for different sets, are errors
    with pytest.raises(ValueError, match="without a name"):
        jaccard_join._summed(counted.filter(pa.array([not x for x in counted.column("named").to_pylist()])))
    rows = [r for k in (7, 8) for r in jaccard_join.packed([1], [0], [np.arange(k, dtype=np.uint64)], 1, False)]
    with pytest.raises(ValueError, match="same number"):
        jaccard_join._shared(1)(pa.Table.from_batches([jaccard_join._batch(rows)]))


def test_later_rounds_read_only_lists_that_were_in_several_groups(spark, monkeypatch):
    """Two hundred pairs of near copies, of which one shares a passage with another: nearly all lists are settled in the first rounds."""
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        words = [f"{i}-{rnd.randrange(10**6)}" for _ in range(60)]
        passage = "all those who came early went home before the rain began".split() if i in (3, 4) else []
        rows += [(2 * i, " ".join(words + passage)), (2 * i + 1, " ".join(words + passage + ["tail"]))]
    read = []
    real = jaccard_join.members
    monkeypatch.setattr(jaccard_join, "members", lambda postings, labels, r: read.append(postings.count()) or real(postings, labels, r))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = rows_of(jaccard_join.jaccard_join(df), "doc_id", "component_id")
    assert got == sorted(((i, i - i % 2) for i in range(400)), key=repr)
    assert len(read) > 2 and read[1] > 1_000 and max(read[2:]) < 200


def test_only_digests_of_rows_in_groups_move(spark, monkeypatch):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(500)]
    rows += [(600, rows[7][1] + " tail"), (601, rows[8][1])]
    seen = []
    real = jaccard_join.maybe_in
    monkeypatch.setattr(jaccard_join, "maybe_in", lambda d, *a: seen.append(("digest" in d.columns, real(d, *a))) or seen[-1][1])
    out = jaccard_join.keep_one_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(500)]
    flagged = [d for digest, d in seen if digest]
    assert len(flagged) == 1 and 4 <= flagged[0].filter("maybe").count() < 60


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(20, 40)]
    star = [(3, i) for i in range(50, 60)] + [(2, 55)]
    got = rows_of(jaccard_join.components(spark.createDataFrame(path + star, "a bigint, b bigint")), "node", "label")
    assert got == sorted([(i, 20) for i in range(20, 41)] + [(i, 2) for i in [2, 3, *range(50, 60)]], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    for f in (exact_dedup.exact_dedup, quality_rules.quality_rules, license_scan.license_scan, jaccard_join.jaccard_join):
        assert f(none).count() == 0
