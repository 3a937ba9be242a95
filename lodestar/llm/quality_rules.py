"""Operator 1. Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects documents whose ratio is above a cutoff. The cutoffs of all rules are
tightened together along a path fixed beforehand, from lax to strict. A step of the path is
certified for a stratum if the share of good documents that its rules reject there *taken
together* (the false rejection risk) is shown to be at most ``risk`` by an exact binomial
test: with k of n good labelled documents rejected by any rule, the p-value is
P(Binomial(n, risk) <= k), and the step passes if p <= ``level`` divided by the number of
strata (Bonferroni). Within a stratum the steps are tested in their order up to the first
that fails, so that their number costs nothing. With probability 1 - ``level`` the certified
rules keep the bound in every stratum. The path is fixed beforehand, so all labelled
documents serve as the holdout.

A stratum without a certified step rejects nothing by these rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, materialize, others, same_rows, words_of

#: The base contract: fewer words, or a larger percentage of words in repeated windows, fails.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: By rule: numerator and denominator counts, and the cutoffs on trial from lax to strict, in thousandths.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols_per_word": ("n_symbols", "n_words", (2000, 1000, 500, 300, 200, 150, 100, 70, 50)),
    "capitals_per_char": ("n_capitals", "word_chars", (900, 700, 500, 400, 300, 250, 200, 150)),
    "word_length": ("word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000)),
    "dup_lines_per_word": ("n_dup_lines", "n_words", (500, 300, 200, 100, 70, 50, 30, 20)),
    "repeat_share": ("n_repeat_words", "n_words", (500, 450, 400, 350, 300, 250, 200, 150)),
}
#: Steps of the path; step i takes the cutoff i of every rule, or its last one.
STEPS = max(len(cutoffs) for _, _, cutoffs in RULES.values())
RISK, LEVEL = 0.025, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]
#: Certified steps are broadcast up to so many strata.
MOST_STRATA = 10_000

_symbols = re.compile(r"[#*$%&|<>]+").findall
_capitals = re.compile(r"[A-Z]+").findall


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one whole text."""
    words = words_of(text)
    seen: set[str] = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
            elif line and words_of(line):
                seen.add(line)
    repeat_words = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        found, covered = Counter(windows), 0  # covered: words before this position count already
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeat_words += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), sum(map(len, words)), sum(map(len, _symbols(text))), dup_lines, repeat_words, sum(map(len, _capitals(text)))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """COUNTS of every document beside its other columns (without the text); a null text has no words."""

    def make():
        def step(cols):
            ((_, texts),) = cols.items()
            found = [text_counts(t or "") for t in texts]
            return {c: [x[i] for x in found] for i, c in enumerate(COUNTS)}

        return step

    keep = others(docs, text, *COUNTS)
    return map_rows(docs.select(*map(col, keep), col(text)), make, ", ".join(f"{c} bigint" for c in COUNTS), keep)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def cutoff_at(rule: str, step: int) -> int:
    return RULES[rule][2][min(step, len(RULES[rule][2]) - 1)]


def over(rule: str, cutoff: Column | int) -> Column:
    """Whether the rule's ratio is above the cutoff, in whole numbers; never for an empty document."""
    above, below, _ = RULES[rule]
    return F.coalesce(1000 * F.col(above) > F.col(below) * F.lit(cutoff), F.lit(False))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), from its terms' logarithms."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, terms)))


def certified_steps(counts: DataFrame, labels: DataFrame, stratum: str, doc_id: str = "doc_id", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, step): the strictest certified step of each stratum that has one.

    ``counts``: ``doc_id``, ``stratum`` and COUNTS; ``labels``: doc_id and quality (1 is good; other
    values and null aren't; a doc_id labelled twice counts once, good if any label says so).
    Only good documents that pass the base contract count; rows that share a labelled id all
    count. A null stratum is a stratum; empty labels certify nothing.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    held = counts.filter(~base_failed()).join(good, col(doc_id) == F.col("good_id"), "left_semi")
    any_rule = [reduce(Column.__or__, [over(r, cutoff_at(r, i)) for r in RULES]) for i in range(STEPS)]
    sums = held.groupBy(col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(c) for c in any_rule]).alias("k"))
    sums = materialize(sums, "quality-trials")
    m = max(1, sums.count())

    def make():
        def step(cols):
            best = []
            for n, ks in zip(cols["n"], cols["k"], strict=True):
                strictest = None
                for i, k in enumerate(ks):
                    # a share of at least the risk can't be shown to be below it
                    if k >= n * risk or binomial_tail(k, n, risk) > level / m:
                        break
                    strictest = i
                best.append(strictest)
            return {"step": best}

        return step

    return map_rows(sums, make, "step int", ["stratum"]).filter("step IS NOT NULL")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", doc_id: str = "doc_id", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Add COUNTS, base_failed, failed_rule and kept to the columns of ``docs`` without its text.

    kept is false if the base contract fails or if a rule certified for the document's stratum
    rejects it; failed_rule names the first such rule. Null or empty texts have no words and
    fail the base contract; null ids have no label. Repeated rows are judged alike; empty labels
    certify nothing; an empty table gives no rows. Columns of ``docs`` with a result's name are
    replaced; others may have any names.
    """
    made = [*COUNTS, "base_failed", "failed_rule", "kept"]
    counts = materialize(base_counts(docs.select(*map(col, others(docs, *made))), text), "quality-counts")
    in_stratum, at = fresh(counts, "stratum", "step")
    certified = materialize(certified_steps(counts, labels, stratum, doc_id, risk, level).toDF(in_stratum, at), "quality-steps")
    if certified.count() <= MOST_STRATA:
        certified = F.broadcast(certified)
    judged = counts.join(certified, col(stratum).eqNullSafe(col(in_stratum)), "left")
    first = F.coalesce(*[F.when(over(r, F.get(F.array(*[F.lit(cutoff_at(r, i)) for i in range(STEPS)]), col(at))), F.lit(r)) for r in RULES])
    judged = judged.withColumns({"base_failed": base_failed(), "failed_rule": first}).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
    return judged.drop(in_stratum, at)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the rules reject; columns as in ``docs``.

    Documents are told apart by 128 bits of id, stratum and text; rows that share them are judged
    alike. Nulls, repeats, empty texts and tables as in ``apply_quality_rules``.
    """
    (key,) = fresh(docs, "quality_key")
    named = docs.withColumn(key, same_rows(docs, doc_id, stratum, text))
    verdicts = apply_quality_rules(named.select(key, *map(col, dict.fromkeys((doc_id, stratum, text)))), labels, stratum, text, doc_id, **options)
    return named.join(verdicts.filter("kept").select(key).distinct(), key, "left_semi").select(*map(col, docs.columns))
