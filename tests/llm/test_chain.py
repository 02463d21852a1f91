"""The classifier chain written plainly: features, words by chi-square, folds, links one after another, and thresholds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanax.llm import toxicity

FOLDS, MOST = 3, 15


def words_of(text):
    letters = "".join(c.lower() if "A" <= c <= "Z" else " " if ord(c) < 128 and not c.isalnum() else c for c in text)
    whole = set(letters.split())
    return whole | {w[:n] + "*" for w in whole for n in (5, 7) if len(w) > n}


def shape_of(text):
    n, spread = len(text.encode()) + 1, len(text.split()) + 1
    count = lambda signs: sum(text.count(c) for c in signs)
    return [np.log1p(spread) / 8, len(words_of(text)) / spread, sum("A" <= c <= "Z" for c in text) / n, 10 * count("#*$%&|<>!?;{}[]()=~^@/\\") / n, 10 * count("0123456789") / n]


def best_words(texts, y):
    """Words of five rows or more by chi-square over 20, the best first, ties by the word."""
    n, b = len(texts), y.sum()
    if not 0 < b < n:
        return []
    told = []
    for w in sorted({w for t in texts for w in t}):
        has = np.array([w in t for t in texts])
        expected = has.sum() * b / n
        chi2 = (y[has].sum() - expected) ** 2 / max(expected * (1 - b / n) * (1 - has.sum() / n), 1e-9)
        if has.sum() >= 5 and chi2 > 20:
            told.append((-chi2, w))
    return sorted(w for _, w in sorted(told)[:MOST])


def fitted(x, y):
    """Logistic regression with a ridge of 0.2, and of 0.001 on the constant, by Newton's method until it stands."""
    if y.min() == y.max():
        return np.r_[np.zeros(x.shape[1]), 8.0 if y[0] else -8.0]
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.2), 1e-3]
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (ridge * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-10:
            step = step / 2
        w = w + step
    return w


def features(words, texts, sets, earlier):
    return np.array([[float(w in s) for w in words] + shape_of(t) + list(np.clip(e, -8, 8)) for t, s, e in zip(texts, sets, earlier, strict=True)])


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_against_plain_code(spark, seed):
    rng = random.Random(seed)
    names = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(300):
        junk, toxic = rng.random() < 0.4, rng.random() < 0.3
        words = [rng.choice(names) for _ in range(30)] + ["JUNK $$", "1234"][: 2 * (junk and rng.random() < 0.9)] + ["nastiness", "Awfully bad"][: 2 * (toxic and rng.random() < 0.8)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(junk), int(toxic or (junk and rng.random() < 0.3))))
    frame = spark.createDataFrame(rows, "doc_id long, text string, junk int, toxic int")
    labels = frame.where("doc_id < 240").select("doc_id", "junk", "toxic")
    chain = toxicity.fit_chain(frame.select("doc_id", "text"), labels, ("junk", "toxic"), most_words=MOST, folds=FOLDS)
    got = {r.doc_id: (r.p.junk, r.p.toxic) for r in frame.select("doc_id", toxicity.probabilities(chain, F.col("text")).alias("p")).collect()}

    fold = {r.doc_id: r.f for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("f")).collect()}
    texts, sets = [r[1] for r in rows], [words_of(r[1]) for r in rows]
    known = np.arange(240)
    folds = np.array([fold[i] for i in known])
    before, all_before = np.zeros((240, 0)), np.zeros((300, 0))
    for k in (0, 1):
        y = np.array([r[2 + k] for r in rows[:240]], float)
        words = best_words([sets[i] for i in known], y)
        assert [w.decode() for w in chain.links[k].words] == words and words
        w = fitted(features(words, texts[:240], sets[:240], before), y)
        told = features(words, texts, sets, all_before) @ w[:-1] + w[-1]
        unseen = np.zeros(240)
        for f in range(FOLDS):
            there, held = known[folds != f], known[folds == f]
            own = best_words([sets[i] for i in there], y[there])
            v = fitted(features(own, [texts[i] for i in there], [sets[i] for i in there], before[there]), y[there])
            unseen[held] = features(own, [texts[i] for i in held], [sets[i] for i in held], before[held]) @ v[:-1] + v[-1]
        p = 1 / (1 + np.exp(-unseen))
        f1 = {t: 2 * y[p >= t].sum() / max((p >= t).sum() + y.sum(), 1) for t in np.arange(10, 0, -1) * 0.05}
        assert f1[min(f1, key=lambda t: abs(t - chain.thresholds[k]))] >= max(f1.values()) - 0.03
        before, all_before = np.column_stack([before, unseen]), np.column_stack([all_before, told])
        want = 1 / (1 + np.exp(-told))
        assert np.abs(np.array([got[i][k] for i in range(300)]) - want).max() < 0.02
