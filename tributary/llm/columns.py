"""Column helpers that the operators share. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import ascii_lower
from tributary.functions.vectors import let

__all__ = ["SPACES", "ascii_lower", "count_of", "let", "most_frequent", "running_sums", "share", "whole", "words"]

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def whole(text: str | Column) -> Column:
    """The text; empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among ``characters``."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("bigint")


def share(part: Column, total: Column) -> Column:
    """``part / total``; 0 where there is nothing."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def running_sums(numbers: Column, stretch: int = 256) -> Column:
    """For an array of n numbers the n + 1 sums of its beginnings, from 0 to the total.

    Sums are taken within stretches and then over stretches, so that appending stays cheap for long arrays.
    """

    def sums(part: Column) -> Column:
        start = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(part, start, lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    def joined(parts: Column) -> Column:
        totals = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(
            totals,
            lambda before: F.flatten(
                F.concat(
                    F.array(F.array(F.lit(0).cast("bigint"))),
                    F.transform(
                        parts,
                        lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: x + F.get(before, i)),
                    ),
                )
            ),
        )

    def in_stretches(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / stretch).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: sums(F.slice(values, i * stretch + 1, F.lit(stretch))))
        return F.when(F.size(values) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(let(parts, joined))

    return let(numbers, in_stretches)


def most_frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The rows whose count is at least the smallest bound that no more than ``most`` rows reach.

    Bounds are numbers of eight leading bits. Rows are counted by them, so a few thousand numbers reach the driver and
    no task sees more than its own rows. Rows that tie at the cut all stay out.
    """
    count = F.col(n).cast("bigint")
    lost = F.greatest(F.length(F.bin(count)) - 8, F.lit(0))
    bound = F.call_function("shiftleft", F.call_function("shiftright", count, lost), lost)
    found = counted.groupBy(bound.alias("bound")).agg(F.count("*").alias("rows")).collect()
    least, rows = None, 0
    for b, more in sorted(found, reverse=True):
        rows += more
        if rows > most:
            break
        least = b
    return counted.where(F.lit(False) if least is None else count >= least)
