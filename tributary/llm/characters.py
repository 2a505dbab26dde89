"""Sets of characters for patterns that cut words, by Unicode's general categories.

Python's tables may be older than those of the vocabularies' library. What Unicode 16 added is listed here, so that
both agree whatever Python runs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters and numbers that came with Unicode 16.
NEWER = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
        (0x1E5F1, 0x1E5FA),
    ],
}
# White space besides the category of separators.
WHITE = "\t\n\x0b\x0c\r\x85"
ENDS = (0x80, 0x10000, sys.maxunicode + 1)  # sets of fewer characters are looked up faster


def is_white(character: str) -> bool:
    return character in WHITE or unicodedata.category(character)[0] == "Z"


@lru_cache(maxsize=None)
def members(kind: str, end: int) -> str:
    """The letters (``L``), numbers (``N``) or white space (``S``) below ``end``, as ranges for a set in a pattern."""
    newer = {p for first, last in NEWER.get(kind, ()) for p in range(first, last + 1)}
    found, start = [], None
    for point in range(end + 1):
        inside = point < end and (
            is_white(chr(point)) if kind == "S" else unicodedata.category(chr(point))[0] == kind or point in newer
        )
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(found)


def patterns(rule: str) -> list[str]:
    """``rule`` for texts below each of ``ENDS``, with the sets' members in the places of ``<L>``, ``<N>`` and ``<S>``."""
    return [re.sub("<([LNS])>", lambda m, end=end: members(m[1], end), rule) for end in ENDS]


def narrowest(text: str) -> int:
    """Which of the ``patterns`` is meant for the text."""
    if text.isascii():
        return 0
    return 1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2
