"""The prefix trie of conversations and the audit of filters against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from almanax.llm import filter_audit, prefix_trie

CONV = "conv_id long, turn long, role string, text string, depth string, n long"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", turn_key(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, v in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(base, [])[:h] + v[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), sum(q not in children for q in below), saved, digest))
    return sorted(out, key=str)


def conversations(seed, n, alphabet, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.1 else rng.choice([t, t, t, 1])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(alphabet), "x", 1))
    return rows


@pytest.mark.parametrize("local", [1, 7, 20_000])
def test_trie_of_odd_conversations(spark, local):
    rows = conversations(local, 60, ["a", "a", "b", None, "ü" * 50, ""], 12)
    rows += rows[:3] + [(None, 0, "user", "nobody's", "x", 1)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV), local)
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_copies_and_long_prefixes(spark):
    """A first turn that all share, copies by the hundred, and a prefix of 300 turns under which conversations part."""
    rows = [(5 * c, t, "user", f"hello {t}", "x", 1) for c in range(300) for t in range(3)]
    rows += [(10_000 + 5 * c, t, "user", f"hello {t}" if t < 300 else f"own {c}", "x", 1) for c in range(4) for t in range(302)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV), 100)
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, None, None, None, None, None)], CONV)).count() == 0
    one = [(7, None, None, None, None, None)]
    assert sorted((tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(spark.createDataFrame(one, CONV)).collect()), key=str) == plain_trie(one)


def test_swaps_visit_all_orders():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def plain_audit(docs, labels):
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    good, bad = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    rows = {}
    for d, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, c in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", d is not None and first[t] < d)) if c}
        rows.setdefault(lang or "", []).append((d, fails))
    out = []
    for part, some in rows.items():
        total, mine = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d, fails in some if f in fails and not fails & before]
                total[f] += len(gone)
                mine.append((part, "".join(order), k + 1, sum(not fails & (before | {f}) for _, fails in some), len(gone), sum(f in fails and bool(fails & before) for _, fails in some), sum(fails == {f} for _, fails in some), sum(d in good for d in gone), sum(d in bad for d in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in mine]
    return sorted(out)


def test_audit_of_odd_documents(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n ", "A" * 30, "# one", *[" ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.choice([50, 250]))) + rng.choice(["", " $", " BIG BIG BIG BIG BIG BIG"]) for _ in range(30)], "x" * 200_000]
    docs = [(None if i % 40 == 39 else i, rng.choice(texts), rng.choice(["en", "fr", "", None]), "s", 1, 1) for i in range(150)]
    docs += docs[:5] + [(3, "another text of this id", "en", "s", 1, 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, part string, mask int, n long")
    got = filter_audit.audit_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.select("part", "filter_order", "step", *filter_audit.COUNTS).collect()) == plain_audit(docs, labels)
    assert filter_audit.audit_documents(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_filters(spark):
    """Seven filters of a caller's own cells: the orders are 5,040, and the Shapley sums of an order add up to what is removed."""
    masks = spark.createDataFrame([("p", m, 10 + m, m % 3, m % 2) for m in range(0, 128, 3)], "part string, mask int, n long, n_good long, n_toxic long")
    got = filter_audit.audit(masks, "ABCDEFG").toPandas()
    assert len(got) == 5040 * 7
    last, total = got[got.step == 7], sum(10 + m for m in range(0, 128, 3))
    assert (last.kept == 10).all() and got[got.filter_order == "GFEDCBA"].shapley.sum() == 5040 * (total - 10)
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "ABCDEFGHI")
