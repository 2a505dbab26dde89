"""Quality rules: a table of thresholds on text statistics, compiled into one projection.

A rule names a statistic and the range in which a text passes. All statistics are built-in expressions over
the words and lines of one row; nothing is shuffled and no user function runs.

Null texts count as empty. An empty text has every share 0 and fails on its number of words. Each input row
gives one output row, repeated rows and null ids included; further columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as with was on by this be at are from or an which you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par sur au "
    "el los las del se por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= statistic <= high``."""

    statistic: str
    low: float
    high: float


RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", 0.0, 0.1),
    Rule("stop_word_share", 0.02, 1.0),
    Rule("upper_share", 0.0, 0.4),
    Rule("shouts_per_word", 0.0, 0.1),
    Rule("dup_line_share", 0.0, 0.3),
    Rule("ellipsis_line_share", 0.0, 0.3),
    Rule("bullet_line_share", 0.0, 0.9),
)


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of ``window`` words that stand at two or more places of the text.

    Windows are sorted by hash, so that equal ones are neighbours: n log n for a text of n words.
    """

    def windows(w: Column) -> Column:
        def at(i: Column) -> Column:
            gram = F.xxhash64(*[F.get(w, i + j) for j in range(window)])
            return F.struct(gram.alias("gram"), i.alias("at"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - window), at))

    def covered(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            near = (F.get(ordered, i - 1)["gram"] == x["gram"]) | (F.get(ordered, i + 1)["gram"] == x["gram"])
            return F.when(near, F.sequence(x["at"], x["at"] + (window - 1)))

        found = F.filter(F.transform(ordered, twice), lambda x: x.isNotNull())
        return F.size(F.array_distinct(F.flatten(found)))

    count = C.let(words, lambda w: C.let(windows(w), covered))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(count).cast("bigint")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts and shares on which rules can be set."""
    base = docs.select(F.col(key), C.whole(text).alias("t"))
    base = base.select(key, "t", C.words(F.col("t")).alias("w"))
    base = base.select(key, "t", "w", F.filter(F.split("t", "\n"), lambda x: C.count_of(x, C.SPACES) < F.char_length(x)).alias("l"))
    t, w, lines = F.col("t"), F.col("w"), F.col("l")
    counted = base.select(
        key,
        F.size(w).cast("bigint").alias("n_words"),
        (F.char_length(t) - C.count_of(t, C.SPACES)).cast("bigint").alias("word_chars"),
        C.count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        C.count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        C.count_of(t, "!").alias("n_shouts"),
        F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis"),
        F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• "))).alias("n_bullets"),
    )
    return counted.select(
        "*",
        C.share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        C.share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        C.share(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_share"),
        C.share(F.col("n_upper"), F.col("word_chars")).alias("upper_share"),
        C.share(F.col("n_shouts"), F.col("n_words")).alias("shouts_per_word"),
        C.share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        C.share(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_share"),
        C.share(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_share"),
    )


def passes(rules: tuple[Rule, ...]) -> Column:
    """The table of rules as one condition; true for an empty table."""
    return reduce(lambda a, b: a & b, (F.col(r.statistic).between(r.low, r.high) for r in rules), F.lit(True))


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """The statistics whose rule the text fails, in the order of the table."""
    found = [F.when(~F.col(r.statistic).between(r.low, r.high), F.lit(r.statistic)) for r in rules]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least_words: int = 50,
    repeated_percent: int = 50,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Statistics of every text, ``base_failed`` (too short, or too many repeated words), ``failed`` rules and ``kept``."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    base = (n < least_words) | (100 * repeated > repeated_percent * n)
    return statistics(docs, key, text).select(
        "*", base.alias("base_failed"), failed_rules(rules).alias("failed"), (~base & passes(rules)).alias("kept")
    )
