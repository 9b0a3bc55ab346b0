"""Ratio of matching blocks of two texts: the longest common block, then by the same rule what lies before and behind it.

The longest block comes from a suffix automaton over the code points of one text, so a block costs time linear in its
two stretches however often characters repeat.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this size on, characters that are more than this share of a text (and one) start no block.
POPULAR_FROM, POPULAR_SHARE = 200, 100


class Substrings:
    """All substrings of a stretch of text that hold no character of ``barred``, with the first end of each."""

    def __init__(self, text: str, barred: set[str]):
        self.following: list[dict[str, int]] = [{}]
        self.shorter, self.size, self.end = [-1], [0], [-1]
        last = 0
        for place, c in enumerate(text):
            last = 0 if c in barred else self._with(last, c, place)

    def _state(self, following: dict[str, int], shorter: int, size: int, end: int) -> int:
        self.following.append(following)
        self.shorter.append(shorter)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def _split(self, state: int, c: str) -> int:
        """The state of exactly what ``state`` and ``c`` spell, taken out of a state that holds longer strings too."""
        target, size = self.following[state][c], self.size[state] + 1
        if self.size[target] == size:
            return target
        own = self._state(self.following[target].copy(), self.shorter[target], size, self.end[target])
        self.shorter[target] = own
        while state >= 0 and self.following[state].get(c) == target:
            self.following[state][c] = own
            state = self.shorter[state]
        return own

    def _with(self, last: int, c: str, place: int) -> int:
        if c in self.following[last]:
            return self._split(last, c)
        new, state = self._state({}, 0, self.size[last] + 1, place), last
        while state >= 0 and c not in self.following[state]:
            self.following[state][c] = new
            state = self.shorter[state]
        if state >= 0:
            self.shorter[new] = self._split(state, c)
        return new

    def longest_in(self, text: str) -> tuple[int, int, int]:
        """Begin in ``text``, begin here and size of the longest common block: the first in ``text``, then here; size 0 if there is none."""
        state, size, best = 0, 0, (0, 0, 0)
        for place, c in enumerate(text):
            while state and c not in self.following[state]:
                state = self.shorter[state]
                size = self.size[state]
            state = self.following[state].get(c, 0)
            size = size + 1 if state else 0
            if size > best[2]:
                best = place - size + 1, self.end[state] - size + 1, size
        return best


def popular(text: str) -> set[str]:
    """Characters that start no block: those of a long text that come very often."""
    if len(text) < POPULAR_FROM:
        return set()
    most = len(text) // POPULAR_SHARE + 1
    return {c for c, n in Counter(text).items() if n > most}


def matching_characters(a: str, b: str, popular_rule: bool = False) -> int:
    """Characters in the longest common block, and by the same rule in what lies before and behind it in both.

    With ``popular_rule`` the popular characters of ``b`` start no block but lengthen one on both sides.
    """
    barred = popular(b) if popular_rule else set()
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        x, y = a[alo:ahi], b[blo:bhi]
        if not x or not y or set(x).isdisjoint(y):
            continue
        i, j, n = Substrings(y, barred).longest_in(x)
        stop, end = i + n, j + n
        # without a block the beginnings may still agree in popular characters
        while i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        while stop < len(x) and end < len(y) and x[stop] == y[end]:
            stop, end = stop + 1, end + 1
        if stop > i:
            total += stop - i
            open_ += [(alo, alo + i, blo, blo + j), (alo + stop, ahi, blo + end, bhi)]
    return total


def most_matching(a: str, b: str) -> int:
    """What ``matching_characters`` can't exceed: the characters that both texts hold, wherever they stand."""
    return sum((Counter(a) & Counter(b)).values())


def ratio(a: str | None, b: str | None, popular_rule: bool = False, least: float = 0.0) -> float:
    """Twice the matching characters over all characters; 0 if a text is empty. Below ``least`` an upper bound may stand for it."""
    if not a or not b:
        return 0.0
    bound = 2.0 * most_matching(a, b) / (len(a) + len(b)) if least else 1.0
    return bound if bound < least else 2.0 * matching_characters(a, b, popular_rule) / (len(a) + len(b))


def sequence_ratio(a: str | Column, b: str | Column, popular_rule: bool = False, least: float = 0.0) -> Column:
    """``ratio`` of two columns, in Arrow batches; null texts count as empty."""

    @F.pandas_udf(T.DoubleType())
    def of(x, y):
        return x.fillna("").combine(y.fillna(""), lambda s, t: ratio(s, t, popular_rule, least))

    return of(a, b)
