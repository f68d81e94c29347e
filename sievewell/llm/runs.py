"""Hashes of the words of many texts at once, in numpy: no Python object is made for a word.

Texts are lower-cased and cut into runs of characters of one class. A run's hash is a polynomial in its code points
(modulo 2 ** 64) with its length, stirred; different runs share one with a chance of about 2 ** -57 a pair or less.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Code points that are hashed at once, and the longest run whose characters all have powers of their own.
SLICE, POWERS = 1 << 17, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(POWERS - 1, _BASE)]), dtype=np.uint64)
_tables: dict[str, np.ndarray] = {}


def _classes(kind: str) -> np.ndarray:
    """Class of each code point, 0 for what is between runs."""
    if kind not in _tables:
        chars = list(map(chr, range(0x110000)))
        letter = np.fromiter(map(str.isalpha, chars), bool, len(chars))
        if kind == "letters":
            _tables[kind] = letter.astype(np.uint8)
        elif kind == "letters and digits":
            _tables[kind] = np.fromiter(map(str.isalnum, chars), bool, len(chars)).astype(np.uint8)
        elif kind == "all but spaces":  # letters, digits, underscores and other signs are classes of their own
            space = np.fromiter(map(str.isspace, chars), bool, len(chars))
            digit = np.fromiter(map(str.isdecimal, chars), bool, len(chars))
            out = np.where(space, 0, np.where(letter, 1, np.where(digit, 2, 3))).astype(np.uint8)
            out[ord("_")], out[0] = 4, 0
            _tables[kind] = out
        else:
            raise ValueError(f"unknown kind {kind!r}")
    return _tables[kind]


def run_hashes(texts: list[bytes | str | None], kind: str, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of runs of each text, hashes): the hashes of all runs, in order, as unsigned 64-bit numbers.

    For each length in ``prefixes`` a further array: hashes of the runs' first so many characters, 0 for runs that are not longer.
    """
    table = _classes(kind)
    parts = [(t.decode("utf-8", "replace") if isinstance(t, bytes) else t or "").lower() if t else "" for t in texts]
    code = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = np.cumsum(np.array([0, *(len(p) + 1 for p in parts)], np.int64))[:-1]
    places: list[np.ndarray] = [np.zeros(0, np.int64)]
    hashes: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(1 + len(prefixes))]
    a = 0
    while a < len(code):
        size = SLICE
        while True:  # up to a change of class, so that no run is cut
            b = min(len(code), a + size)
            kinds = table[code[a:b]]
            change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            if b == len(code) or len(change):
                break
            size *= 2
        if b < len(code):
            b = a + int(change[-1])
            kinds, change = kinds[: b - a], change[:-1]
        start = np.concatenate([[0], change])
        length = np.diff(np.append(start, b - a))
        x = code[a:b].astype(np.uint64) + np.uint64(1)
        off = (np.arange(b - a) - np.repeat(start, length)) & (POWERS - 1)
        h = np.add.reduceat(x * _POW[off], start)
        word = kinds[start] > 0
        start, length, h = start[word], length[word], h[word]
        places.append(start + a)
        hashes[0].append(mix64(h + length.astype(np.uint64) * _POW[7]))
        for out, n in zip(hashes[1:], prefixes, strict=True):
            longer = np.flatnonzero(length > n)
            h = np.zeros(len(longer), np.uint64)
            for i in range(n):
                h += x[start[longer] + i] * _POW[i]
            part = np.zeros(len(length), np.uint64)
            part[longer] = mix64(h + np.uint64(n) * _POW[9]) | np.uint64(1)
            out.append(part)
        a = b
    at = np.concatenate(places)
    counts = np.diff(np.append(np.searchsorted(at, firsts), len(at))) if len(texts) else np.zeros(0, np.int64)
    return counts, [np.concatenate(h) for h in hashes]


class Lookup:
    """Places of hashes in a sorted array of distinct ones, by an open hash table."""

    def __init__(self, known: np.ndarray):
        self.bits = max(4, int(4 * len(known)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(known))
        slot = self._slots(known)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several that want a slot the last gets it
            self.keys[slot[free]] = known[left[free]]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """-1 for hashes that are not known."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), self._slots(h)
        while len(left):
            at = self.at[slot]
            hit = (at >= 0) & (self.keys[slot] == h[left])
            out[left[hit]] = at[hit]
            more = (at >= 0) & ~hit
            left, slot = left[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out
