"""Vocabulary entries at every place of many words at once, as NumPy arrays.

Words are taken in chunks of like length. For a chunk, ``Lattice.ids[s][w, e]`` is the id of the entry that covers the
``s`` + 1 characters of word ``w`` up to and including character ``e``, or -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BITS = 18
PAD = 0x110000  # no code point


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Vocabulary:
    """Finds strings among at most a few hundred thousand entries by a rolling hash; equal hashes are refused."""

    def __init__(self, entries: Sequence[str]):
        self.entries = list(entries)
        self.longest = max(map(len, self.entries))
        keys = np.array([self._key(e) for e in self.entries], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries share a hash value or are the same")
        slots = self._slot(keys)
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.found = np.full(1 << _BITS, -1, np.int32)
        self.crowded = np.zeros(1 << _BITS, bool)
        _, first = np.unique(slots, return_index=True)
        self.keys[slots[first]], self.found[slots[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded[slots[rest]] = True
        order = rest[np.argsort(keys[rest])]
        self.rest_keys, self.rest_found = np.append(keys[order], ~np.uint64(0)), np.append(order, -1).astype(np.int32)

    @staticmethod
    def _key(entry: str) -> int:
        key = 0
        for c in entry:
            key = (key * int(_BASE) + ord(c) + 1) % (1 << 64)
        return key

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        ids = np.where(self.keys[slots] == keys, self.found[slots], np.int32(-1))
        again = np.nonzero(self.crowded[slots] & (ids < 0))
        if len(again[0]):
            place = np.searchsorted(self.rest_keys, keys[again])
            place[place == len(self.rest_keys)] = 0
            ids[again] = np.where(self.rest_keys[place] == keys[again], self.rest_found[place], np.int32(-1))
        return ids


class Lattice:
    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray, words: list[str]):
        self.rows = rows  # places of these words in the list that was given
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.sizes.max())
        self.codes = np.full((len(words), self.width), PAD, np.uint32)
        self.codes[np.arange(self.width)[None, :] < self.sizes[:, None]] = code_points("".join(words))
        values, self.ids = self.codes.astype(np.uint64) + np.uint64(1), []
        keys = np.zeros_like(values)
        for size in range(1, min(vocabulary.longest, self.width) + 1):
            shifted = keys[:, :-1] * _BASE + values[:, 1:] if size > 1 else values
            if size > 1:
                keys = np.concatenate([keys[:, :1], shifted], axis=1)
            else:
                keys = shifted
            ids = np.full(keys.shape, -1, np.int32)
            ids[:, size - 1 :] = vocabulary.look_up(keys[:, size - 1 :])
            self.ids.append(ids)

    def utf8_sizes(self) -> np.ndarray:
        c = self.codes
        return (c < PAD).astype(np.int32) + ((c >= 0x80) & (c < PAD)) + ((c >= 0x800) & (c < PAD)) + ((c >= 0x10000) & (c < PAD))


def lattices(vocabulary: Vocabulary, words: Sequence[str], most: int = 2_000_000) -> Iterator[Lattice]:
    """Lattices of all words, none of them empty, with about ``most`` places times entry sizes each (a longer word: alone)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + 32)
        while end < len(order) and (end - at) * sizes[order[end]] * vocabulary.longest < most:
            end = min(len(order), end + max(32, (end - at) // 2))
        while end > at + 1 and (end - at) * sizes[order[end - 1]] * vocabulary.longest > 2 * most:
            end = at + max(1, (end - at) // 2)
        rows = order[at:end]
        yield Lattice(vocabulary, rows, [words[i] for i in rows])
        at = end
