"""Recompression of token sequences: rounds that name runs and pairs, so that equal substrings get equal symbols inside.

A round of runs names each maximal run of one symbol by the symbol and its length; a round of pairs splits all symbols into left and
right ones by a hash and names each left one that a right one follows together with it. A name is a hash of what it is made of, so it
is the same in all documents, tasks and runs, and no dictionary is shuffled. Whether two neighbours become one symbol depends on them
alone; so in equal windows of words the symbols agree but for those at the borders. Of a window, a pair round can at most lose a
right symbol at its beginning and a left one at its end, a round of runs the first and the last run: the rest is the window's core,
which its words alone decide. A window's key is half a window of words from where the core of a late round begins, the last one that
begins in the window's first half: equal windows have equal keys, one for each long symbol or so, and other texts rarely share one.

All is done on arrays of many documents at once; long documents are cut into pieces that overlap by a window less one word, which
changes no window's core.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

RUNS, PAIRS = "runs", "pairs"
#: Rounds until symbols have some ten words on average, and further ones for longer symbols.
ROUNDS = (RUNS, PAIRS, PAIRS, PAIRS, PAIRS, PAIRS, RUNS, PAIRS, PAIRS, PAIRS)
FURTHER = (PAIRS, RUNS, PAIRS, PAIRS, PAIRS)
#: Words of a piece of arrays.
MOST_WORDS = 1 << 17

_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _OTHER)}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that looks random (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(lengths: np.ndarray, window: int, most: int = MOST_WORDS) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, start, stop) of at most `most` words; documents of more are cut, with the overlap of a window less one."""
    out, words = [], 0
    for d, n in enumerate(lengths.tolist()):
        for a in range(0, max(n - window + 1, 1), most):
            b = min(n, a + most + window - 1)
            if out and words + b - a > most:
                yield out
                out, words = [], 0
            out.append((d, a, b))
            words += b - a
    if out:
        yield out


class Sums:
    """Hashes of ranges of words that depend on the words alone, in two independent numbers."""

    def __init__(self, words: np.ndarray):
        self.parts = []
        for base, salt in ((_BASE, np.uint64(1)), (_OTHER, np.uint64(2))):
            power = np.full(len(words) + 1, base, np.uint64)
            back = np.full(len(words) + 1, _INVERSE[int(base)], np.uint64)
            power[0] = back[0] = 1
            power, back = np.cumprod(power), np.cumprod(back)
            self.parts.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + salt) * power[:-1]))), back))

    def of(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        total, back = self.parts[which]
        return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def _named(kind: str, k: int, first: np.ndarray, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """A round: starts and names of the new symbols and, of a round of pairs, which of the old ones are left."""
    fresh = first[p]
    if kind == RUNS:
        keep = np.flatnonzero(fresh | np.concatenate(([True], s[1:] != s[:-1])))
        length = np.diff(np.append(keep, len(s))).astype(np.uint64)
        return p[keep], np.where(length > 1, mix(s[keep] ^ mix(length)), s[keep]), None
    left = mix(s + np.uint64(2 * k + 3)) >> np.uint64(63) == 0
    pair = np.flatnonzero(left[:-1] & ~left[1:] & ~fresh[1:])
    names, keep = s.copy(), np.ones(len(s), bool)
    names[pair] = mix(s[pair] * _OTHER + mix(s[pair + 1] + np.uint64(k)))
    keep[pair + 1] = False
    return p[keep], names[keep], left


class Parsed:
    """The parse of the documents of one list of pieces: words, as 64-bit hashes, and where each document's begin."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int):
        n = len(words)
        self.window, self.n, self.sums = window, n, Sums(words)
        self.first = np.zeros(n, bool)
        self.first[starts] = True
        self.end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        self.at = np.flatnonzero(np.arange(n) + window <= self.end)  # where windows start
        p, s, of = np.arange(n), mix(words), np.arange(n)
        live, l, r = np.arange(len(self.at)), self.at.copy(), self.at + window
        low, half = l.copy(), window // 2
        for k, kind in enumerate(ROUNDS):
            p2, s2, left = _named(kind, k, self.first, p, s)
            mark = np.zeros(n, np.int64)
            mark[p2] = 1
            of2 = np.cumsum(mark) - 1
            if left is None:
                l, r = np.append(p2, n)[of2[l] + 1], p2[of2[r - 1]]
            else:
                a, z = of[l], of[r - 1]
                l, r = np.where(left[a], l, np.append(p, n)[a + 1]), np.where(left[z], p[z], r)
            there = l < r
            there &= l <= self.at[live] + window - half
            live, l, r = live[there], l[there], r[there]
            low[live] = l
            p, s, of = p2, s2, of2
        self.low, self.half, self.p, self.s = low, half, p, s

    def keys(self, low: np.ndarray | None = None) -> np.ndarray:
        """The key of each window, in the order of self.at, or the keys that begin at the positions low."""
        low = self.low if low is None else low
        return self.sums.of(low, low + self.half)

    def windows(self, some: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the windows at the positions some."""
        return self.sums.of(some, some + self.window, which)

    def covers(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, end): the symbols [start, stop) of the further rounds all of whose positions are wanted, and the ends of the ranges
        of whole symbols that hold all windows that start in them."""
        p, s = self.p, self.s
        for k, kind in enumerate(FURTHER, len(ROUNDS)):
            p, s, _ = _named(kind, k, self.first, p, s)
        bounds = np.append(p, self.n)
        stop = bounds[1:]
        at = np.searchsorted(bounds, stop + self.window - 1)
        end = bounds[np.minimum(at, len(bounds) - 1)]
        count = np.concatenate(([0], np.cumsum(wanted)))
        good = (stop + self.window - 1 <= self.end[p]) & (end <= self.end[p]) & (count[stop] - count[p] == stop - p)
        return p[good], stop[good], end[good]
