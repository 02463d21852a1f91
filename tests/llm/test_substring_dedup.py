"""Removal of long repeats against brute force, and what the parse promises of equal windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from almanax.llm import recompression, substring_dedup

DOC = "doc_id long, text string, digest string, spans int, keys int"


def find(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window):
    first = {}
    for d, text, *_ in rows:
        w = find(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, text, *_ in rows:
        w = find(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), [k for k, g in enumerate(gone) if g], " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def shown(df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r.kept_text, bytes(r.kept_digest).hex(), bytes(r.digest).hex()))
    return sorted(out, key=str)


def check(spark, rows, window):
    got = shown(substring_dedup.repeated_words(spark.createDataFrame(rows, DOC), window=window))
    want = plain(rows, window)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == hashlib.sha256(w[3].encode()).hexdigest() and (g[3] == w[3] if g[2] else g[3] is None and g[4] == g[5])


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(6)]
    base, out = some(700), []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            words = some(rng.choice([0, 10, 49, 50, 120])) + rng.choice(passages) + some(rng.choice([0, 1, 80]))
        elif kind < 0.6:
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 5])):
                words[rng.randrange(len(words))] = "edit"
            words = words[rng.choice([0, 0, 37]) :]
        elif kind < 0.7:
            words = ["spam"] * rng.choice([49, 50, 51, 130]) + some(3)
        elif kind < 0.8:
            words = ["a", "b"] * rng.choice([24, 25, 70])
        else:
            words = some(rng.choice([0, 1, 40, 300]))
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 5000), (2, 3)])
def test_repeats_of_odd_documents(spark, seed, size):
    vocabulary = [f"w{k}" if k % 7 else f"ü{k}—" for k in range(size)]
    found = texts(seed, 120, vocabulary)
    rng = random.Random(seed)
    rows = [(None if i % 50 == 49 else i, t, "x", 1, 1) for i, t in enumerate(found)]
    rows += rows[:4] + [(i + 1000, rng.choice(found), "x", 1, 1) for i in range(10)] + [(7, found[3] + " " + found[9], "x", 1, 1), (-5, None, None, None, None), (3000, "", "", 0, 0), (3001, "x" * 300_000, "", 0, 0)]
    check(spark, rows, 50)


def test_repeats_of_other_windows_and_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    rows = [(1, " ".join(long), "", 0, 0), (2, " ".join(long[5000:9000] + ["new"] + long[100:140]), "", 0, 0), (3, " ".join(["other"] + long), "", 0, 0), (4, " ".join(long[60:72]), "", 0, 0)]
    check(spark, rows, 12)
    assert substring_dedup.repeated_words(spark.createDataFrame([], DOC)).count() == 0


def test_drop_repeats_keeps_columns_and_clean_texts(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    rows = [(1, "intro\n" + passage, "a", 1, 2), (2, "mine " + passage + "  end", "b", 3, 4), (3, "clean   text\tas it was", "c", 5, 6), (None, passage, "d", 7, 8)]
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, DOC))
    assert got.columns == ["doc_id", "text", "digest", "spans", "keys"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], (2, "mine end", "b", 3, 4), rows[2], rows[3]], key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 50, 100_000])
def test_equal_windows_have_equal_keys(size):
    """Whatever stands around a window, at the beginning, within or at the end of a document, and wherever long documents are cut."""
    rng = np.random.default_rng(size)
    word = rng.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64)
    window = word[rng.integers(0, size, 50)]
    found = set()
    for before, after in [(0, 0), (0, 9), (13, 0), (200, 300), (1, 1), (64, 2)]:
        whole = np.concatenate((word[rng.integers(0, size, before)], window, word[rng.integers(0, size, after)]))
        parsed = recompression.Parsed(np.concatenate((whole, whole[::-1])), np.array([0, len(whole)]), 50)
        found.add((int(parsed.keys()[before]), int(parsed.windows(np.array([before]))[0]), int(parsed.windows(np.array([before]), 1)[0])))
    assert len(found) == 1
    lengths = np.array([3, 500, 0, 49, 50, 51])
    seen = [(d, k) for some in recompression.pieces(lengths, 50, 64) for d, a, b in some for k in range(a, b - 49)]
    assert sorted(seen) == [(d, k) for d, n in enumerate(lengths) for k in range(n - 49)]
