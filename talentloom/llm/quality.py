"""Quality rules: a threshold table compiled into one Spark projection.

Everything runs as built-in expressions inside the scan stage: no shuffle, no
Python. Per-text arrays live only for the row at hand, so memory is bounded by
the longest text.

Edge cases: a null text has no words and no lines (all counts 0, rejected as
too short); an empty text likewise. Repeated rows are judged each on its own.
Columns of the input whose names clash with the metrics are not carried along;
pass the wanted ones in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPACE_CHARS, words

#: Very common short function words of the four languages.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "as", "was", "this", "are", "by", "from", "at",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "au", "avec", "pas",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "zu", "von", "mit", "ist", "im", "auf", "nicht", "als", "auch", "sich", "für",
    "el", "los", "las", "y", "del", "una", "por", "con", "para", "es", "se", "al", "lo", "como", "su", "no",
)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= numerator / denominator <= high``.

    ``numerator`` and ``denominator`` name metrics; a denominator of None means
    the bare metric. A zero denominator passes (nothing to judge).
    """

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def column(self) -> Column:
        value = F.col(self.numerator).cast("double")
        if self.denominator:
            value = value / F.when(F.col(self.denominator) != 0, F.col(self.denominator))
        checks = []
        if self.low is not None:
            checks.append(value >= F.lit(float(self.low)))
        if self.high is not None:
            checks.append(value <= F.lit(float(self.high)))
        ok = checks[0]
        for check in checks[1:]:
            ok = ok & check
        return F.coalesce(ok, F.lit(True))


#: Thresholds of the method's verdict, one line a rule.
RULES = (
    Rule("length", "n_words", None, 20, 200_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def quality_metrics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of every text, beside the columns in ``keep``.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines,
    n_repeat_words (words inside 8-word windows that occur twice or more),
    n_stop_words - all long.

    Windows are compared by the 64-bit XXH64 of their eight words, so two
    different windows of one text collide with probability below 1e-10.
    """
    body = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    body = body.select(
        *keep,
        words(F.col("_t")).alias("_w"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")).alias("_l"),
    )
    # Each array is its own column, used at least twice below, so that the
    # optimizer keeps it computed once and never inside a lambda.
    body = body.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("_w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
        ).alias("_h"),
    ).drop("_w", "_l")
    body = body.select(
        "*",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    ).drop("_h")
    same = lambda i, j: F.coalesce(F.get("_s", i)["h"] == F.get("_s", j)["h"], F.lit(False))
    body = body.select(
        "*",
        F.when(
            F.col("_s").isNotNull(),
            F.sort_array(
                F.filter(F.transform("_s", lambda s, k: F.when(same(k, k - 1) | same(k, k + 1), s["i"])), lambda i: i.isNotNull())
            ),
        ).alias("_p"),
    ).drop("_s")
    gap = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gap, F.lit(0), lambda a, x: a + x)
    return body.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_p")


def base_failed() -> Column:
    """Too short, or more than 30% of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(metrics: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed, one ``pass_<rule>`` a rule, and kept, in one projection."""
    verdict = ~base_failed()
    for rule in rules:
        verdict = verdict & rule.column()
    return metrics.select("*", base_failed().alias("base_failed"), verdict.alias("kept"), *[r.column().alias(f"pass_{r.name}") for r in rules])


def filter_quality(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All metrics and the verdict of every row of ``df``."""
    return apply_rules(quality_metrics(df, text, (key,)), rules)
