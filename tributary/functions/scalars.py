"""Small scalar rules shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Change codes and the operation each one names.
OP_CODES = {"insert": 1, "update": 0, "delete": -1}

# The patterns that class a log line, in the order they are tried.
ERROR_LINE = r"(?i)(ERROR|panic|push failed|put failed|connect failed|stream dropped|Error:|not reachable)"
OK_LINE = r"(?i)(\(pushed\)|up\b|reachable|Sources|retrieval)"
WARN_LINE = r"(?i)(reconnect|retry|WARN)"


def op_name(code: Column) -> Column:
    """Operation of a change code; NULL for an unknown code."""
    named = F.lit(None).cast("string")
    for name, value in OP_CODES.items():
        named = F.when(code == value, F.lit(name)).otherwise(named)
    return named


def year_of(date_text: Column) -> Column:
    """The leading four digits of a date kept as text, else NULL."""
    return F.when(date_text.rlike("^[0-9]{4}"), F.substring(date_text, 1, 4).cast("int"))


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def section_of(code: Column) -> Column:
    return F.substring(code, 1, 1)


def payload_of_line(line: Column, prefix: str = "data: ") -> Column:
    """What follows ``prefix`` in a line stripped at its end; NULL for other lines."""
    stripped = F.regexp_replace(line, r"\s+$", "")
    return F.when(stripped.startswith(prefix), F.substring(stripped, len(prefix) + 1, 1 << 30))


def line_class(line: Column) -> Column:
    """``err``, ``ok``, ``warn`` or ``''`` for a log line; the first pattern that matches wins."""
    return (
        F.when(line.rlike(ERROR_LINE), "err")
        .when(line.rlike(OK_LINE), "ok")
        .when(line.rlike(WARN_LINE), "warn")
        .otherwise("")
    )


def writeback_id(src: Column, seq: Column) -> Column:
    return F.concat_ws("-", src, seq.cast("string"))


def now_seconds() -> Column:
    """Epoch seconds, the same for all rows of one batch."""
    return F.unix_timestamp(F.current_timestamp())


def overhead_pct(off: Column, on: Column) -> Column:
    """How much slower ``on`` is than ``off``, in percent; 0 when there is no ``off`` rate."""
    return F.when(off > 0, (off - on) / off * 100.0).otherwise(F.lit(0.0))


def amplification(off: Column, on: Column) -> Column:
    return on / F.greatest(off, F.lit(1.0))


def ratio(slow: Column, fast: Column) -> Column:
    """``slow / fast``; 0 when ``fast`` is not above 0."""
    return F.when(fast > 0, slow / fast).otherwise(F.lit(0.0))
