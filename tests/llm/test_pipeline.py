"""The pipeline against its stages' brute-force versions."""

from __future__ import annotations

import brute
import public_tokenizers as P
import pytest
from brute import rows_of
from pyspark.sql import functions as F
from test_tokens import COLS, check_packing

import corpus_pipeline
from rinse.llm import common, exact_dedup, jaccard_join, quality_rules

SMALL = "/root/testdata/sf0.001"


def test_run(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(documents)
    good = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    for i in good:  # the base rules hold whatever the model says
        words, *_, repeated = brute.quality_counts(texts[i])
        assert words >= 50 and 100 * repeated <= 50 * words
    firsts = [(i, texts[i]) for i, g in brute.exact_groups([(i, texts[i]) for i in good]).items() if g[2]]
    left = [(i, texts[i]) for i, (_, c) in brute.jaccard_components(firsts).items() if c == i]
    used, least = check_packing(left, rows_of(corpus_pipeline.run(spark, SMALL), *COLS))
    assert used <= 1.05 * least + 2


def test_stages_keep_the_columns(spark, odd):
    extra = odd.withColumnRenamed("n_words", "gone_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SMALL).columns == extra.columns, name
    assert P.path("byte_bpe_50k.json")
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SMALL).count() == 0


A, B, C = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
NEAR_A = A + " tail"


def kept(stage, spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, gone_id string").repartition(3)
    out = stage(df)
    assert out.columns == df.columns
    return rows_of(out, "doc_id", "text")


def test_dedup_stages_decide_by_row_not_by_id(spark):
    rows = [(3, A), (7, A), (7, B), (5, C), (5, C), (5, C), (None, C), (None, B), (None, "only here"), (None, "only here")]
    want = sorted([(3, A), (7, B), (5, C), (None, "only here")], key=repr)
    assert kept(exact_dedup.keep_first, spark, rows) == want
    assert kept(jaccard_join.keep_one_each, spark, rows) == want


def test_near_copies_with_null_and_repeated_ids(spark):
    rows = [(4, NEAR_A), (4, A), (4, A), (9, A), (9, C), (None, NEAR_A), (None, B + " x"), (None, B), (2, ""), (None, "")]
    got = kept(jaccard_join.keep_one_each, spark, rows)
    assert [r for r in got if not r[1] or r[1] == C] == sorted([(2, ""), (9, C), (None, "")], key=repr)
    rest = [r for r in got if r[1] and r[1] != C]
    assert len(rest) == 2 and rest[0][0] == 4 and rest[0][1] in (A, NEAR_A) and rest[1][0] is None and rest[1][1] in (B, B + " x")


def test_stages_take_any_column_names(spark, odd):
    names = ["a.b", "digest", "row", "kept", "_b", "_map", "maybe", "t", "n"]
    wide = odd.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns, name
        plain = stage(spark, odd.select("doc_id", "text"), SMALL)
        assert rows_of(out, "doc_id", "text") == rows_of(plain, "doc_id", "text"), name
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect()), name


@pytest.mark.parametrize("most_maps", [1, 4096])
def test_the_bitmap_misses_no_key(spark, monkeypatch, most_maps):
    monkeypatch.setattr(common, "MOST_MAPS", most_maps)
    rows = spark.range(40_000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("x"))
    keys = rows.filter("x % 7 = 0 OR x IS NULL").distinct()
    n = keys.count()
    got = common.maybe_in(rows, "x", keys, n, "flag")
    assert got.columns == ["x", "flag"] and got.count() == 40_000
    assert got.filter("(x IS NULL OR x % 7 = 0) AND NOT flag").count() == 0
    passed = got.filter("x % 7 > 0 AND flag").count()
    assert passed < 2_500 if most_maps > 1 else passed < 10_000
