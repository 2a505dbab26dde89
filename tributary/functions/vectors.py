"""Vectors as columns. For scoring many vectors against many queries see ``operators.knn``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucket_counts(buckets: Column, dim: int) -> Column:
    """How often each of the numbers 0 to ``dim - 1`` stands in an array of them, in order.

    Every number is added once and the array sorted; the distance of its first place to the next
    number's is its count plus one.
    """
    ordered = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim))))

    def firsts(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim)), lambda b: F.array_position(s, b))

    def counts(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.get(at, b + 1) - F.get(at, b) - 1)

    return let(let(ordered, firsts), counts)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)``: 0 for the same direction, 1.0 when either is all zeros.

    Vectors of unequal length fail the job; a truncated comparison would hide a mixed-up model.
    """
    norms = _dot(a, a) * _dot(b, b)
    distance = F.when(norms == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    )
    return F.when(
        F.size(a) != F.size(b),
        F.raise_error(
            F.format_string("vector lengths differ: %d and %d", F.size(a), F.size(b))
        ).cast("double"),
    ).otherwise(distance)


def l2_normalise(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays zero."""
    norm = F.sqrt(_dot(v, v))
    return F.when(norm == 0, v).otherwise(
        F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
    )


def _printed(x: Column, places: int) -> Column:
    """``x`` with so many places as C prints it: a value half way between two goes to the even one.

    ``format_string`` alone would take it up. A float times 10 to the 12 at most is exact as a double, so ties are
    seen as such. Floats of 2 to the 23 and more are whole.
    """
    value = x.cast("double")
    rounded = F.rint(value * F.lit(10.0**places)) / F.lit(10.0**places)
    return F.format_string(f"%.{places}f", F.when(F.abs(value) < F.lit(2.0**23), rounded).otherwise(value))


def vector_to_json(v: Column, places: int = 6) -> Column:
    """``v``, an array of floats, as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: _printed(x, places)), ","), F.lit("]"))


def vector_from_json(text: Column) -> Column:
    return F.from_json(text, "array<float>")
