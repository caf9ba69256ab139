"""The corpus operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinse.llm import (
    bpe_tree, exact_dedup, html_text, jaccard_join, license_scan, packing, prefix_trie, quality_rules, repeat_bytes, spelling,
    token_counts, url_filter, warc)
from rinse.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file (the same on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(url_filter.captures_of(pages), url_filter.entries_of(pages))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_repeat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_bytes.repeat_bytes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_text, op2_bpe_round_trip, op3_warc_round_trip, op4_url_filter, op5_jaccard_join, op6_token_counts,
        op7_license_scan, op8_exact_dedup, op9_packing, op10_quality_rules, op11_spelling_groups,
        op12_prefix_trie, op13_repeat_bytes)}

ORACLE: dict[str, str] = {"op4_url_filter": url_filter.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
