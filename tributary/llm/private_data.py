"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone`` always stand as their patterns and checks say. ``iban``
(mod-97) and ``national`` (a phone number without country code) are added if their score reaches the bound; a
``national`` span needs a word such as "tel" beside it. Words in capitals behind an account number look like groups of
it, so an ``iban`` ends at the end of a group at which its checksum holds: where its country's length is reached, else
at the last. Every span has its score, which the words beside it raise for all kinds. Offsets are code points, the end
is exclusive.

Positions come from splitting a text at a pattern: the pieces between matches and the matches themselves have
known lengths, whose running sums are the offsets. Patterns start at the beginning of a run of their characters,
or where the last match ended, and take runs whole, so that long runs cost one pass.

Null texts count as empty and have no spans. Each input row gives one output row, repeated rows and null ids
included; further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
NEARBY = 48  # characters before and after a span in which words count

# Length of the account numbers of each country.
LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20"
)


def _number(hit: Column) -> Column:
    return F.translate(hit, "+-. ()", "")


def luhn(number: Column) -> Column:
    """Whether the last digit is the check digit of the others."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(number, F.char_length(number) - i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        value = F.position(F.substr(moved, i, F.lit(1)), F.lit(digits + ascii_uppercase)) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), add) == 1


def _card(hit: Column) -> Column:
    return C.let(_number(hit), lambda n: F.char_length(n).between(13, 19) & luhn(n))


def _ip(hit: Column) -> Column:
    def small(part: Column) -> Column:
        return C.let(F.ltrim(part, F.lit("0")), lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))

    return F.forall(F.split(hit, r"\."), small)


def _phone(hit: Column) -> Column:
    return F.char_length(_number(hit)).between(9, 15)


def _iban(hit: Column) -> Column:
    return C.let(F.translate(hit, " ", ""), lambda a: F.char_length(a).between(15, 34) & mod97(a))


def _account(hit: Column) -> Column:
    """The beginning of whole groups that is an account number, of its country's length or else the longest; null if none is."""

    def of_country(account: Column) -> Column:
        named = F.concat(F.left(account, F.lit(2)), F.char_length(F.translate(account, " ", "")).cast("string"))
        return F.array_contains(F.split(F.lit(LENGTHS), " "), named)

    def longest(groups: Column) -> Column:
        begun = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), " "))
        return C.let(F.filter(begun, _iban), lambda good: F.coalesce(F.get(F.filter(good, of_country), F.lit(0)), F.get(good, F.lit(0))))

    return C.let(F.split(hit, " "), longest)


def _always(hit: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A pattern, the text without which it cannot match, its check, and how its score is made.

    The score is ``alone`` for a checked span and ``more`` is added if one of ``beside`` stands nearby. ``cut`` gives the
    beginning of a match that is the span, where it is not the whole match.
    """

    name: str
    pattern: str
    needs: str
    check: Callable[[Column], Column]
    alone: float
    more: float
    beside: str
    cut: Callable[[Column], Column] | None = None


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", _always, 0.9, 0.1, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]", _ip, 0.8, 0.1, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]++)++", "[0-9]", _card, 0.8, 0.2, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 0.8, 0.2, "phone|tel|call|fax|mobile"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?+(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]", _always, 0.8, 0.2, "iban|bank|account", _account),
    Kind("national", r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", "[0-9]", _always, 0.3, 0.4, "phone|tel|call|fax|mobile"),
)


def _spans(text: Column, kind: Kind) -> Column:
    nothing = F.array().cast(SPAN)

    def located(hits: Column) -> Column:
        parts = F.split(text, kind.pattern, -1)

        def placed(parts: Column) -> Column:
            lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("bigint"))

            def spans(ends: Column) -> Column:
                def span(hit: Column, i: Column) -> Column:
                    def told(kept: Column, behind: Column) -> Column:
                        start = F.get(ends, i + 1) - F.char_length(hit)
                        near = F.concat(F.right(F.get(parts, i), F.lit(NEARBY)), F.lit(" "), F.left(behind, F.lit(NEARBY)))
                        beside = F.lower(near).rlike(rf"\b(?:{kind.beside})")
                        score = F.lit(kind.alone) + F.when(beside, F.lit(kind.more)).otherwise(F.lit(0.0))
                        return F.when(
                            kept.isNotNull() & kind.check(kept),
                            F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(kept)).alias("end"), score.alias("score")),
                        )

                    behind = F.get(parts, i + 1)
                    if kind.cut is None:
                        return told(hit, behind)
                    return C.let(kind.cut(hit), lambda kept: told(kept, F.concat(F.substr(hit, F.char_length(kept) + 1), behind)))

                return F.filter(F.transform(hits, span), lambda x: x.isNotNull())

            return C.let(C.running_sums(lengths), spans)

        return F.when(F.size(hits) > 0, C.let(parts, placed)).otherwise(nothing)

    possible = text.contains(kind.needs) if len(kind.needs) == 1 else text.rlike(kind.needs)
    found = C.let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), located)
    return F.when(possible, found).otherwise(nothing)


def find(docs: DataFrame, least: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, added)``: arrays of spans, by kind as listed and then by start; ``added`` from score ``least`` on."""
    texts = docs.select(F.col(key), C.whole(text).alias("t"))
    t = F.col("t")
    return texts.select(
        key,
        F.concat(*[_spans(t, k) for k in BASE]).alias("base"),
        F.filter(F.concat(*[_spans(t, k) for k in ADDED]), lambda s: s["score"] >= least).alias("added"),
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def score_list(spans: Column) -> Column:
    """The score of each span with two places, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def masked(docs: DataFrame, least: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its text, each span replaced by its kind in angle brackets; spans inside others are not replaced twice."""

    def cut(t: Column, spans: Column) -> Column:
        ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

        def step(done: Column, s: Column) -> Column:
            kept = F.substr(t, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
            more = F.struct(s["end"].alias("at"), F.concat(done["out"], kept, F.lit("<"), s["kind"], F.lit(">")).alias("out"))
            return F.when(s["start"] >= done["at"], more).otherwise(done)

        return F.aggregate(ordered, start, step, lambda done: F.concat(done["out"], F.substr(t, (done["at"] + 1).cast("int"))))

    texts = docs.select(F.col(key), C.whole(text).alias("t"))
    t = F.col("t")
    found = texts.select(
        key, "t", F.filter(F.concat(*[_spans(t, k) for k in BASE + ADDED]), lambda s: s["score"] >= least).alias("s")
    )
    return found.select(key, C.let(F.col("s"), lambda s: F.when(F.size(s) > 0, cut(t, s)).otherwise(t)).alias("text"))
