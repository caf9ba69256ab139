"""License statements by diagonal voting (DataFrame functions only).

Every text becomes rolling word pairs with their positions.  The hashes of the
pairs are joined with the hashes of the template pairs; a hit at text position
p and template position q votes for the diagonal p - q, where the template
would start.  Votes are added up per diagonal, diagonals that lie within
``SLACK`` words of each other are merged (a word was inserted or left out),
and a merged span is verified: it must hold the first and the last pair of its
template and cover enough of the rest.

Base phrases are templates too: one counts where a single diagonal holds all
of its pairs, which is exactly where its words stand consecutively.

The templates are parameters of a fixed size, so their pairs are broadcast.
Texts are read once; only hits and one marker row per document are shuffled,
by row, once.  Words are runs of ``[0-9a-z]`` and characters beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinse.llm.common import lower_ascii, shuffle_parts, texts

SLACK = 2
MIN_COVER = 0.7
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening statements of public licenses, in their own words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_pairs(spark: SparkSession, base: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """One row per template position: its two words, their hash, label and size."""
    rows = [(t, q, a, b, len(words) - 1, label, phrase in base and t < len(base))
            for t, (label, phrase) in enumerate([*((v, k) for k, v in base.items()), *notices])
            for words in [phrase.split()] for q, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, q int, ta string, tb string, pairs int, label string, base boolean") \
                .withColumn("tgram", F.xxhash64("ta", "tb"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
                 notices: list[tuple[str, str]] | None = None, min_cover: float = MIN_COVER,
                 slack: int = SLACK) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``n_base`` counts all places of base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest of their starts (NULL without
    any), label lists are distinct, sorted and comma-joined (empty without
    any), ``score`` is the best share of a template that was found.  A NULL or
    empty text has no words and no hits.  Rows are told apart by a row number
    of their own, so NULL and repeated ids keep one result per row.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    templates = template_pairs(spark, BASE if base is None else base, NOTICES if notices is None else notices)

    words = _words(texts(docs, id_col, text_col))
    pairs = words.select("row", "doc_id", "n_words", F.posexplode_outer(
        F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    ).alias("pos", "z")).select("row", "doc_id", "n_words", "pos", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
    hits = (pairs.withColumn("gram", F.xxhash64("a", "b"))
            .join(F.broadcast(templates),
                  (F.col("gram") == F.col("tgram")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left")
            .filter(F.col("template").isNotNull() | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
            .select("row", "doc_id", "n_words", "template", "label", "base", "pairs", "q",
                    (F.col("pos") - F.col("q")).alias("start"))
            .repartition(shuffle_parts(spark), "row"))

    per_doc, per_template = ["row", "doc_id", "n_words"], ["template", "label", "base", "pairs"]
    diagonals = hits.groupBy(*per_doc, *per_template, "start").agg(F.collect_set("q").alias("qs"))
    order = Window.partitionBy("row", "template").orderBy("start")
    gap = F.col("start") - F.lag("start").over(order)
    # base phrases and documents without hits keep each diagonal apart
    merged = diagonals.withColumn("new", F.when(gap.isNull() | F.col("base") | (gap > slack), 1).otherwise(0)) \
                      .withColumn("span", F.sum("new").over(order))
    spans = (merged.groupBy(*per_doc, *per_template, "span")
             .agg(F.min("start").alias("start"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
             .withColumn("cover", F.size("qs") / F.col("pairs")))
    is_base = F.col("base") & (F.size("qs") == F.col("pairs"))
    ends = F.array_contains("qs", 0) & F.array_contains("qs", F.col("pairs") - 1)
    found = is_base | (~F.col("base") & ends & (F.col("cover") >= min_cover))

    def joined(cond):
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    return spans.groupBy(*per_doc).agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("bigint").alias("last_word"),
        joined(is_base).alias("base_labels"), joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score")).drop("row")


def _words(d: DataFrame) -> DataFrame:
    """Row number, id and the words of each text."""
    words = F.filter(F.split(lower_ascii(F.col("text")), BREAKS), lambda w: w != "")
    w = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    return w.select("row", "doc_id", "words", F.size("words").cast("bigint").alias("n_words"))

