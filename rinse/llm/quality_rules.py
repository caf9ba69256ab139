"""Quality filtering by weak supervision (DataFrame functions only).

Each rule looks at one statistic of a text and votes good, votes bad or
abstains.  No rule is trusted outright: expectation-maximisation over all
documents estimates how often each rule votes each way on good and on bad
documents, and a document stays when its posterior probability of being good
reaches one half.

The scan reduces every text to a row of counts.  EM never sees documents: the
rows are first aggregated to distinct vote patterns (at most 3^rules rows, a
bound set by the number of rules, not by the data), and each iteration is one
aggregate over that table that brings one row of parameters to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.common import SPACE_CHARS, SPACE_CLASS, bind, durable

GOOD, BAD, ABSTAIN = 1, -1, 0

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that for with on as by was der die das und ist nicht mit von zu den im "
              "le la les de et des un une du que est pour dans el los del y en por con las una").split()

#: rule name -> (statistic, votes good when, votes bad when); anything else abstains.
RULES: dict[str, tuple[str, str, str]] = {
    "length": ("n_words", "x >= 100", "x < 20"),
    "word_length": ("word_chars / nullif(n_words, 0)", "x BETWEEN 3 AND 9", "x < 2.2 OR x > 14"),
    "symbols": ("n_symbols / nullif(n_words, 0)", "x < 0.05", "x > 0.2"),
    "shouting": ("n_upper / nullif(word_chars, 0)", "x < 0.15", "x > 0.4"),
    "exclaiming": ("n_exclaim / nullif(n_words, 0)", "x < 0.05", "x > 0.3"),
    "repeated_lines": ("n_dup_lines / nullif(n_lines, 0)", "x < 0.1", "x > 0.4"),
    "repeated_words": ("n_repeat_words / nullif(n_words, 0)", "x < 0.2", "x > 0.5"),
    "function_words": ("n_stop", "x >= 3", "x = 0 AND n_words >= 30"),
    "distinct_words": ("n_distinct / nullif(n_words, 0)", "x > 0.3", "x < 0.12 AND n_words < 3000"),
}

MOST_ITERATIONS = 2_000  # beyond it EM is said to have failed
TOLERANCE = 1e-5


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row of counts per document; words are runs of anything but white space.

    With ``carry`` the input row comes along as the struct ``input``.

    ``n_repeat_words`` counts the words inside three-word windows that occur at
    least twice in the text: windows are sorted with their positions, equal
    neighbours mark the repeated positions, and each repeated position covers
    three words less what the next one covers too.
    """
    space = SPACE_CHARS
    neighbours = ("filter(s, (x, i) -> (i > 0 AND x.a = s[i - 1].a AND x.b = s[i - 1].b AND x.c = s[i - 1].c) OR "
                  "(i < size(s) - 1 AND x.a = s[i + 1].a AND x.b = s[i + 1].b AND x.c = s[i + 1].c))")
    covered = ("CASE WHEN size(p) = 0 THEN 0 ELSE 3 + aggregate(sequence(1, size(p)), 0, "
               "(n, i) -> n + CASE WHEN i = size(p) THEN 0 ELSE least(3, p[i] - p[i - 1]) END) END")
    windows = ("sort_array(transform(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), "
               "slice(w, 3, size(w) - 2)), (z, i) -> named_struct('a', z['0'], 'b', z['1'], 'c', z['2'], 'p', i)))")
    repeat = ("CASE WHEN size(w) < 4 THEN 0 ELSE "
              + bind(windows, "s", bind(f"sort_array(transform({neighbours}, y -> y.p))", "p", covered)) + " END")
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    word_counts = bind("words", "w", f"named_struct('n_words', CASE WHEN w[0] = '' THEN 0 ELSE size(w) END, "
                       f"'n_repeat_words', {repeat}, 'n_distinct', size(array_distinct(w)), "
                       f"'n_stop', size(array_intersect(w, array({stops}))))")
    line_counts = bind("lines", "l", "named_struct('n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)))")

    def without(chars: str) -> Column:
        return F.char_length(F.translate(F.col("text"), chars, ""))

    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *whole)
    kept = ["doc_id", *(["input"] if carry else [])]
    n = F.char_length("text")
    d = d.select(
        *kept, n.alias("n_chars"), without(space).cast("bigint").alias("word_chars"),
        (n - without("#*$%&|<>")).cast("bigint").alias("n_symbols"),
        (n - without("!")).alias("n_exclaim"), (n - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        F.expr(word_counts.replace("words", f"split(btrim(text, '{_sql(space)}'), '{_sql(SPACE_CLASS)}')", 1)).alias("w"),
        F.expr(line_counts.replace("lines", "filter(split(text, '\\n'), x -> "
                                   f"translate(x, '{_sql(space)}', '') <> '')", 1)).alias("l"))
    return d.select(*kept, F.col("w.n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
                    F.col("l.n_dup_lines").cast("bigint").alias("n_dup_lines"),
                    F.col("w.n_repeat_words").cast("bigint").alias("n_repeat_words"),
                    F.col("l.n_lines").alias("n_lines"), "n_exclaim", "n_upper",
                    F.col("w.n_distinct").alias("n_distinct"), F.col("w.n_stop").alias("n_stop"))


def _sql(s: str) -> str:
    """The characters of ``s`` inside a SQL string literal."""
    return (s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
             .replace("\x0b", "\\u000B").replace("\x0c", "\\u000C"))


def vote(rule: str) -> Column:
    """The vote of one rule; a statistic that is undefined (no words) abstains."""
    x, good, bad = RULES[rule]
    stat = f"({x})"
    sql = " ".join(f"WHEN {cond.replace('x ', stat + ' ')} THEN {v}" for cond, v in ((bad, BAD), (good, GOOD)))
    return F.expr(f"CASE {sql} ELSE {ABSTAIN} END")


class RuleModel:
    """Prior and, per rule and class, the log probability of each vote."""

    def __init__(self, prior: float, logs: dict[str, dict[int, tuple[float, float]]]):
        self.prior, self.logs = prior, logs

    def posterior(self) -> Column:
        """P(good | votes) as a column over the vote columns ``v_<rule>``."""
        odds = F.lit(math.log(self.prior) - math.log1p(-self.prior))
        for r, table in self.logs.items():
            ratio = F.lit(0.0)
            for v, (good, bad) in table.items():
                ratio = F.when(F.col(f"v_{r}") == v, F.lit(good - bad)).otherwise(ratio)
            odds = odds + ratio
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def accuracy(self, rule: str) -> float:
        """Probability that a vote of ``rule`` (not an abstention) is right."""
        t = {v: (math.exp(g), math.exp(b)) for v, (g, b) in self.logs[rule].items()}
        right = self.prior * t[GOOD][0] + (1 - self.prior) * t[BAD][1]
        wrong = self.prior * t[BAD][0] + (1 - self.prior) * t[GOOD][1]
        return right / (right + wrong)


def fit_rules(votes: DataFrame, most_iterations: int = MOST_ITERATIONS, tolerance: float = TOLERANCE) -> RuleModel:
    """EM over all rows of ``votes`` to its tolerance, started from the share of good votes; raises if it never gets there."""
    names = list(RULES)
    cols = [f"v_{r}" for r in names]
    patterns = durable(votes.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))
    good = sum((F.when(F.col(c) == GOOD, 1.0).otherwise(0.0) for c in cols), F.lit(0.0))
    bad = sum((F.when(F.col(c) == BAD, 1.0).otherwise(0.0) for c in cols), F.lit(0.0))
    p = (good + 1) / (good + 3 * bad + 2)  # one bad vote weighs like three good ones at the start
    model, before = None, None
    for _ in range(most_iterations):
        sums = [F.sum(F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b")]
        for r, c in zip(names, cols):
            for v in (GOOD, BAD, ABSTAIN):
                hit = F.when(F.col(c) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("p")).alias(f"{r}{v}g"), F.sum(hit * (1 - F.col("p"))).alias(f"{r}{v}b")]
        row = patterns.withColumn("p", p).agg(*sums).first()
        g, b = row["g"] or 0.0, row["b"] or 0.0  # empty input: the smoothed uniform model
        model = RuleModel((g + 1) / (g + b + 2), {
            r: {v: (math.log(((row[f"{r}{v}g"] or 0.0) + 1) / (g + 3)), math.log(((row[f"{r}{v}b"] or 0.0) + 1) / (b + 3)))
                for v in (GOOD, BAD, ABSTAIN)} for r in names})
        now = [model.prior, *(math.exp(x) for t in model.logs.values() for pair in t.values() for x in pair)]
        if before and max(abs(x - y) for x, y in zip(now, before)) < tolerance:
            return model
        before, p = now, model.posterior()
    raise RuntimeError(f"expectation-maximisation has not settled after {most_iterations} iterations")


def judged(counts: DataFrame, threshold: float) -> DataFrame:
    """``counts`` with ``base_failed``, ``kept`` and ``quality_prob``, by a model fitted on all its rows."""
    voted = counts.select("*", *[vote(r).alias(f"v_{r}") for r in RULES])
    model = fit_rules(voted)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.withColumn("quality_prob", model.posterior()).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of every input row.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality_prob``.  ``base_failed`` holds
    for fewer than 50 words or more than half of the words in repeated
    three-word windows; such a row is never kept.  NULL text counts as empty
    (no words, every statistic abstains but length, base failed).  NULL or
    repeated ids keep their rows.  Other columns are ignored.
    """
    return judged(durable(text_counts(docs, id_col, text_col)), threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    The rows are written once with their counts; the model reads the counts
    only, and no text is shuffled.
    """
    counts = durable(text_counts(docs, id_col, text_col, carry=True), "quality")
    return judged(counts, threshold).filter("kept").select("input.*")
