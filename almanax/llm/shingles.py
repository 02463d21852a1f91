"""Word shingles of texts as 64-bit hashes, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


class WordHashes:
    """Hashes of words, kept while there are at most limit of them."""

    def __init__(self, limit: int = 300_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(words)
        known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_lists(texts: pa.Array):
    """Words of each text, A-Z lower-cased, null as empty: bytes.split parts at \\x20 and \\x09-\\x0D exactly."""
    for text in texts:
        yield text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def shingle_sets(texts: pa.Array, hashes: WordHashes, size: int = 5, chunk: int = 400_000):
    """Per text its distinct shingles, sorted. A text with fewer words has its whole sequence as one; without words, none."""
    lists: list[list[bytes]] = []
    n = 0
    for words in word_lists(texts):
        lists.append(words)
        n += len(words)
        if n >= chunk:
            yield from _sets(lists, hashes, size)
            lists, n = [], 0
    yield from _sets(lists, hashes, size)


def _sets(lists: list[list[bytes]], hashes: WordHashes, size: int):
    flat = hashes.of([w for words in lists for w in words])
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.cumsum(n) - n
    whole = flat[: max(0, len(flat) - size + 1)].copy()
    for k in range(1, size):
        whole = mix(whole * _A + flat[k : k + len(whole)])
    for start, m in zip(starts.tolist(), n.tolist(), strict=True):
        if m >= size:
            yield _distinct(whole[start : start + m - size + 1])
        elif m:
            h = flat[start : start + 1].copy()
            for x in flat[start + 1 : start + m]:
                h = mix(h * _A + x)
            yield mix(h + np.uint64(m))
        else:
            yield flat[:0]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def pack(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


__all__ = ["WordHashes", "fingerprint", "mix", "pack", "shingle_sets", "word_lists"]
