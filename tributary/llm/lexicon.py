"""A minimal acyclic transducer from words to lists of ids, as one file that workers map into memory.

Words are added in byte order; states with the same future are shared (suffixes stand once). Each arc carries how
many words come before those behind it among its siblings, so the sum along a path is the word's number, and the
number finds the word's ids. The file holds the states' arcs, then the ids; reading a word touches a few pages.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Sequence

import numpy as np

_HEAD = "<6I"


class Builder:
    """States of the words added so far. Words must come in byte order, each once."""

    def __init__(self) -> None:
        self._open: list[list] = [self._state()]  # along the last word: [final, [[label, target], ...]]
        self._last = b""
        self._known: dict[tuple, int] = {}
        self._closed: list[tuple[bool, tuple, int]] = []  # final, arcs, words behind the state

    @staticmethod
    def _state() -> list:
        return [False, []]

    def _close(self, depth: int) -> None:
        """Closes the states of the last word below ``depth``, sharing those that are known."""
        while len(self._open) - 1 > depth:
            final, arcs = self._open.pop()
            like = (final, tuple(map(tuple, arcs)))
            number = self._known.get(like)
            if number is None:
                number = self._known[like] = len(self._closed)
                self._closed.append((*like, final + sum(self._closed[t][2] for _, t in arcs)))
            self._open[-1][1][-1][1] = number

    def add(self, word: bytes) -> None:
        same = 0
        while same < min(len(word), len(self._last)) and word[same] == self._last[same]:
            same += 1
        self._close(same)
        for label in word[same:]:
            self._open[-1][1].append([label, -1])
            self._open.append(self._state())
        self._open[-1][0] = True
        self._last = word

    def packed(self, ids: Iterable[Sequence[int]]) -> bytes:
        """The file; ``ids`` in the order of the words."""
        self._close(0)
        final, arcs = self._open[0]
        states = [*self._closed, (final, tuple(map(tuple, arcs)), 0)]
        first, flags, labels, targets, before = [0], [], [], [], []
        for final, arcs, _ in states:
            passed = int(final)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                before.append(passed)
                passed += states[target][2]
            first.append(len(labels))
            flags.append(int(final))
        outputs = [np.asarray(x, dtype="<u4") for x in ids]
        ends = np.cumsum([0, *map(len, outputs)])
        parts = [
            np.asarray(first, "<u4"), np.asarray(targets, "<u4"), np.asarray(before, "<u4"), ends.astype("<u4"),
            np.concatenate([np.zeros(0, "<u4"), *outputs]), np.asarray(labels, "u1"), np.asarray(flags, "u1"),
        ]
        head = struct.pack(_HEAD, len(states), len(labels), len(outputs), int(ends[-1]), len(states) - 1, 0)
        return head + b"".join(p.tobytes() for p in parts)


def compiled(words: dict[str, Sequence[int]]) -> bytes:
    """The file for a table of words and their ids."""
    keyed = sorted((w.encode(), ids) for w, ids in words.items())
    builder = Builder()
    for word, _ in keyed:
        builder.add(word)
    return builder.packed(ids for _, ids in keyed)


class Lexicon:
    """A file of ``Builder`` mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, self._root, _ = struct.unpack_from(_HEAD, self._map)
        view, at = memoryview(self._map), struct.calcsize(_HEAD)

        def take(n: int, kind: str) -> memoryview:
            nonlocal at
            size = n * (4 if kind == "I" else 1)
            part, at = view[at : at + size].cast(kind), at + size
            return part

        self._first, self._targets, self._before = take(states + 1, "I"), take(arcs, "I"), take(arcs, "I")
        self._ends = take(words + 1, "I")
        self._ids = take(4 * ids, "B")
        self._labels_at = at  # labels are looked for in the map itself
        take(arcs, "B")
        self._flags = take(states, "B")
        self.states, self.words = states, words
        self._begun: dict[bytes, tuple[int, int] | None] = {}  # states after beginnings of three bytes, 2^24 at most

    def ids(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers; None for a word that is not in the file."""
        begin = word[:3]
        if begin not in self._begun:
            self._begun[begin] = self._after(begin, self._root, 0)
        reached = self._begun[begin]
        reached = reached and self._after(word[3:], *reached)
        if reached is None or not self._flags[reached[0]]:
            return None
        number = reached[1]
        return bytes(self._ids[4 * self._ends[number] : 4 * self._ends[number + 1]])

    def _after(self, word: bytes, state: int, number: int) -> tuple[int, int] | None:
        """The state that the bytes lead to and the number of words passed; None where no arc fits."""
        first, targets, before, find, at = self._first, self._targets, self._before, self._map.find, self._labels_at
        for label in word:
            arc = find(label.to_bytes(), at + first[state], at + first[state + 1])  # a state's arcs lie together
            if arc < 0:
                return None
            number += before[arc - at]
            state = targets[arc - at]
        return state, number
