"""Tokens and token hashing."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only. ``lower`` would also fold other alphabets, whose letters separate tokens here."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters, folded to lower case; NULL text has no tokens."""
    return F.regexp_extract_all(
        ascii_lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)
    )


def token_bucket(token: Column, dim: int) -> Column:
    """A stable bucket in ``[0, dim)``: the first 32 bits of the token's MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")
