"""Spelling variants by PartEnum signatures (DataFrame functions only).

Two words are near if one inserted, deleted or replaced letter turns one into
the other.  A word's letters, taken as a multiset, are a binary vector with one
dimension for each (letter, occurrence); near words differ in one dimension
(insert, delete) or in two (replace).  The dimensions are dealt to ``PARTS``
parts by a hash, so near words agree on all parts but two at most.  A word's
signatures are its projections on every choice of ``PARTS - 2`` parts, and near
words share one of them without fail.

The letters alone do not tell anagrams apart, so each signature is also bound
to a guard: near words of at least ``m`` letters agree on ``m - 1`` letters at
the two ends together, hence on one of a few (prefix, suffix) lengths.

Words that share a signature meet in an equi-join and are verified there by
their edit distance.  A pair that shares several counts at the first of them,
so no pair has to be made distinct afterwards.  Only the vocabulary is joined,
never the texts: occurrences are summed per task before they are shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import durable, lower_ascii, texts

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
TYPO_EVERY = 31
PARTS = 3
DIFFER = 2       # dimensions in which near words may differ
RATIO = 10
PART_BITS = 21   # three part hashes fit one bigint
DOUBLINGS = 5    # a link multiplies n by RATIO, so no chain of bigint counts has more than 2**5 links


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = TYPO_EVERY,
                letters: str = LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: maximal runs of ``letters`` in lower case (A-Z only) with their number of occurrences.

    With ``typo_every``, a run whose CRC-32 together with its document's id is
    divisible by it loses one letter, which plants misspellings.
    """
    runs = texts(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{letters}{{{min_length},}}"), F.lit(0))).alias("raw"))
    word = runs.select("id", lower_ascii(F.col("raw")).alias("w"))
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "w").cast("binary"))
        at = F.expr("cast(h % char_length(w) AS int)")
        word = word.withColumn("h", h).withColumn("at", at).select(
            F.when(F.col("h") % typo_every == 0, F.concat(F.expr("substring(w, 1, at)"), F.expr("substring(w, at + 2)"))).otherwise(F.col("w")).alias("w"))
    return (word.filter(F.char_length("w") >= min_length).groupBy(F.col("w").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def guards(min_length: int) -> list[tuple[int, int]]:
    """(prefix, suffix) lengths, one of which any two near words agree on.

    Their common prefix and suffix have ``t = min_length - 1`` letters together
    at least, so for cuts t > c1 > c2 > ... the prefix has c1 letters, or c2 and
    the suffix t - c1 + 1, and so on.
    """
    t = min_length - 1
    cuts = [t + 1, *sorted({t - 1, t // 2, 1} & set(range(1, t + 1)), reverse=True), 0]
    return [(lo, t - hi + 1) for hi, lo in zip(cuts, cuts[1:])]


def _part_hashes(word: Column) -> Column:
    """The part hashes of the letter multiset, packed into one bigint."""
    chars = F.array_sort(F.split(word, ""))
    dims = F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))

    def part(p: int) -> Column:
        own = F.filter(dims, lambda dim: F.pmod(F.xxhash64(dim), F.lit(PARTS)) == p)
        return F.shiftleft(F.xxhash64(F.array_join(own, ",")).bitwiseAND((1 << PART_BITS) - 1), p * PART_BITS)

    return reduce(Column.bitwiseOR, map(part, range(PARTS)))


def _slots(min_length: int) -> list[tuple[int, int, int]]:
    """(prefix length, suffix length, bits of the kept parts) of every signature."""
    mask = (1 << PART_BITS) - 1
    kept = [sum(mask << (p * PART_BITS) for p in k) for k in combinations(range(PARTS), PARTS - DIFFER)]
    return [(a, b, k) for a, b in guards(min_length) for k in kept]


def near_pairs(vocabulary: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``a, b, n_a, n_b``, a < b: every pair of near words, once.  ``vocabulary`` is ``word, n``, distinct words of ``min_length`` letters or more."""
    slots = _slots(min_length)
    parts = vocabulary.withColumn("parts", _part_hashes(F.col("word")))
    signature = [F.xxhash64(F.lit(i), F.expr(f"left(word, {a})"), F.expr(f"right(word, {b})"), F.col("parts").bitwiseAND(k))
                 for i, (a, b, k) in enumerate(slots)]
    # the slot stands in the low bits, so that the join key carries it
    low = (1 << (len(slots) - 1).bit_length()) - 1
    signed = parts.select("word", "n", "parts", F.explode(F.array(*[
        s.bitwiseAND(~low).bitwiseOR(F.lit(i).cast("bigint")) for i, s in enumerate(signature)])).alias("key"))
    first = " ".join(f"WHEN left(l.word, {a}) = left(r.word, {a}) AND right(l.word, {b}) = right(r.word, {b}) "
                     f"AND ((l.parts ^ r.parts) & {k}L) = 0 THEN {i}L" for i, (a, b, k) in enumerate(slots))
    return (signed.alias("l").join(signed.alias("r"), F.expr(
                "l.key = r.key AND l.word < r.word AND abs(char_length(l.word) - char_length(r.word)) <= 1 "
                f"AND levenshtein(l.word, r.word, 1) = 1 AND (l.key & {low}L) = CASE {first} END"))
            .selectExpr("l.word AS a", "r.word AS b", "l.n AS n_a", "r.n AS n_b"))


def roots_of(links: DataFrame) -> DataFrame:
    """``word, root``: follow ``word, up`` to the end of each chain, by pointer doubling."""
    links = durable(links.select("word", F.col("up").alias("root")), "links")
    for _ in range(DOUBLINGS):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return links


def spelling_groups(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                    typo_every: int | None = TYPO_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``min_length`` letters that occurs ``min_count`` times.

    ``form`` is the near word of largest ``n`` (ties: the smallest word), if it
    occurs ``ratio`` times as often; ``root`` is where the forms end.

    A NULL or empty text has no words; a NULL id counts as an empty one in the
    planting of misspellings; repeated rows count each.  Words of any length are
    whole, and a long text is read whole.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    words = durable(word_counts(docs, min_length, min_count, typo_every, id_col=id_col, text_col=text_col), "words")
    pairs = near_pairs(words, min_length)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("top"))
    judged = durable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("top.minus") >= ratio * F.col("n"), F.struct(F.col("top.other").alias("form"), (-F.col("top.minus")).alias("form_n"))).alias("to")), "near")
    roots = roots_of(judged.filter("to IS NOT NULL").select("word", F.col("to.form").alias("up")))
    return judged.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("to.form_n").alias("form_n"))
