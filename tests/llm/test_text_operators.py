"""Each text operator against brute force, on small tables with nulls, empty and long texts, repeated rows and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanax.llm import line_dedup, ngram_join, packing, pq_dedup, quality, queries, scratch, secrets, sentencepiece, toxicity, url_filter, warc
from almanax.llm.components import components
from almanax.llm.token_ids import TokenIds

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system".split()


def doc(i, text, source="s0"):
    return (i, text, "en", source, None if text is None else len(text))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    return [None, "", "  \n\t ", "one", "one two three", sentence(rng, 60), sentence(rng, 60) + "\n" + sentence(rng, 50), "x" * 30_000, sentence(rng, 9000), "Ünïcode ß 日本語 🙂\x0b\x0c\r\nend"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [doc(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], DOC)


# 1


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/de/x?q#f", "https://example.net/en/a", "https://x.example.net/fr/", "http://w.org/fr/1", "http://badorg/fr/", None, "nothing", "ftp://", "http://h#frag/de/", "http://net/", "http://example.com?x=/de/"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(0, 1), (1, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/de/x", "example.com/de/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2] is None and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:2] == ("", "") and got[8][:3] == ("h", "", None) and got[9][2:] == ("net/", "block") and got[10][:3] == ("example.com", "", None)


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good' if i < 80 else 'new'}.x{i % 2}.com/a") for i in range(100)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "page_id long, bad int")
    got = {r.host: r for r in url_filter.host_reputation(pages, labels).collect()}
    assert got["bad.x0.com"].host_verdict == "block" and got["good.x0.com"].host_verdict == "allow" and got["good.x0.com"].bad_mean < got["new.x0.com"].bad_mean < got["bad.x0.com"].bad_mean
    judged = {r.host: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert all((judged[h].verdict, judged[h].rule, judged[h].bad_bound) == (got[h].host_verdict, None, got[h].bad_bound) for h in got) and {r.verdict for r in judged.values()} == {"allow", "block"}
    assert all(r.bad_bound < r.bad_mean for r in got.values()) and (got["bad.x0.com"].bad_bound > 0.5) and not {r.page_id for r in url_filter.filter_urls(pages, labels).collect()} & set(range(40))
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0 and url_filter.filter_urls(pages, labels.limit(0)).count() == 100


# 2


def test_token_ids_are_the_tokenizers():
    ids = TokenIds(path("word_bpe_49k.json"), most_chunks=50, most_words=20)
    texts = [*[t or "" for t in odd_texts()], "a<|endoftext|>b it's DON'T !!'s \x1c\x01", "ﬁ ΑΣ ΟΔΟΣ. İ １２ 　x \x85 ſtraße ŉ"]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    tok = TokenIds(path("word_bpe_49k.json")).tokenizer
    rows = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_layout(rows, 4096)
    assert packing.pack_documents(docs.limit(0), path("word_bpe_49k.json")).count() == 0


def check_layout(rows, size):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= size
    return len(at)


def test_packing_merges_over_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 500)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(6000)]
    pieces = spark.createDataFrame([(None if i == 7 else i, 0, 0, n, i) for i, n in enumerate(sizes)], packing._PIECES)
    rows = packing.pack_pieces(pieces, 100).collect()
    assert len(rows) == 6000 and check_layout(rows, 100) <= 1.02 * sum(sizes) / 100 + 1
    big = spark.createDataFrame([(i, 0, 0, 60, i) for i in range(2000)], packing._PIECES)  # none fit together
    assert check_layout(packing.pack_pieces(big, 100).collect(), 100) == 2000


# 3


def shingle_set(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def test_jaccard_components(spark, docs):
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(30, 200)).split() for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        rows.append(doc(100 + i, " ".join(words)))
    every = docs.unionByName(spark.createDataFrame(rows, DOC)).withColumn("component_id", F.lit("mine"))
    found = {}
    for r in ngram_join.jaccard_components(every).collect():
        found.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    sets = {r.doc_id: shingle_set(r.text) for r in every.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert found == {i: {(len(s), root(i))} for i, s in sets.items()}
    one = ngram_join.one_of_each(every)
    assert {r.doc_id for r in one.collect()} == {i for i in sets if root(i) == i} and one.columns == every.columns
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    words = sentence(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(words)
        w[i % 120] = f"x{i}"
        rows.append(doc(i, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    assert {r.component_id for r in got} == {0}


def test_cut_cells_are_whole(spark, monkeypatch):
    """Cells whose rows link with the leader, or only with rows that do, or with neither, against brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    rng = random.Random(21)
    words = sentence(rng, 100).split()
    rows = []
    for i in range(90):
        w = list(words)
        for k in range(i // 6):  # ever farther from the first, but near to the one before
            w[(7 * k) % 100] = f"y{k}"
        w[50] = f"x{i}"
        rows.append(doc(i, " ".join(w)))
    for i in range(90, 110):
        rows.append(doc(i, " ".join(words[:30] + [f"z{i}w{k}" for k in range(90)])))
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOC)).collect()}
    assert got == label and 1 < len(set(label.values())) < 60


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


# 4


def test_cosine_components(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(int(i), [float(x) for x in (base[i % 60] + 0.12 * rng.normal(size=16)).astype(np.float32)], 0) for i in range(400)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, [], 0), (1005, rows[3][1], 0), (1006, [2 * x for x in rows[3][1]], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (None, rows[3][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.cosine_components(frame).collect()}
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: {j for j, w in good if j != i and len(w) == len(v) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.95} for i, v in good}
    seen = {}
    for i in sorted(near):
        if i not in seen:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen[k] = i
                    todo += near[k]
    for i, v, _ in rows:
        assert got[i] == ((len(near[i]), seen[i], seen[i] == i) if i in near else (0, i, None if i is None else True)), i
    assert pq_dedup.cosine_components(frame.limit(0)).count() == 0


def links_of(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def found_links(spark, vectors):
    """Per vector the number of links found and the component."""
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = sorted(pq_dedup.cosine_components(frame).collect(), key=lambda r: r.vec_id)
    return np.array([r.n_links for r in rows]), np.array([r.component_id for r in rows])


def test_probes_are_sufficient(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 8)  # as many lists as 64,000 vectors have
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2000, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = rng.normal(size=(2000, 48))
    turn -= (turn * base).sum(1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.97, 2000)[:, None]  # the farthest that still link
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * turn])
    want = links_of(vectors).sum()
    found, component = found_links(spark, vectors)
    assert want == 4000 and 0.98 * want <= found.sum() <= want and (found <= links_of(vectors).sum(1)).all()
    assert ((component == np.arange(4000)) | (component == np.arange(4000) - 2000)).all()


def test_crowded_balls_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 20)
    monkeypatch.setattr(pq_dedup, "BLOCK_ROWS", 50)
    monkeypatch.setattr(pq_dedup, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(3, 24))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    spread = np.r_[np.full(500, 0.02), np.full(300, 0.045), np.full(300, 0.06)][:, None]  # wholly linked, nearly so, in part
    crowd = np.repeat(centre, [500, 300, 300], axis=0) + spread * rng.normal(size=(1100, 24))
    vectors = np.concatenate([crowd, rng.normal(size=(400, 24))])
    linked = links_of(vectors)
    found, component = found_links(spark, vectors)
    assert linked.sum() > 300_000 and found.sum() == linked.sum() and (found == linked.sum(1)).all()
    assert set(component[:500]) == {0}


# 5

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text):
    text = text or ""
    rows = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    rows += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    rows += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(rows)]


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é", "🙂", "\n", "hunter22", "x.y=z", "ſecret", "K", "ghp_" + "a" * 36, "AKIAAKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", "secret: secret: abcdef", "token=" + "a" * 100_000, "password=abcde"]
    frame = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC).withColumn("secret_spans", F.lit(1))
    for r in secrets.find_secrets(frame).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.secret_spans if s.kind in secrets.BASE] == base_spans(r.text), r.text
    clean = secrets.redact_secrets(frame.drop("secret_spans")).collect()
    assert all(r.text is None or not base_spans(r.text) or "removed" in r.text for r in clean) and all(r.text is None or r.n_chars == len(r.text) for r in clean)
    assert secrets.find_secrets(frame.limit(0)).count() == 0


# 6


def test_sentencepiece_is_the_librarys(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(sentencepiece, "CHUNK_CHARS", 300)  # many chunks
    model = path("piece_bpe_32k.model")
    m = SentencePieceProcessor(model_file=model)
    rng = random.Random(17)
    pieces = [m.id_to_piece(i) for i in range(300, 32_000, 7)]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = ["  Hello  world\n x\t🙂", "a" * 23 + " bbbbbb", "\n\n a", "a▁b  ", "日本語のテキスト漢字", "x" * 300, "\x00\x01é", "The quick brown foxes' jumping 2024-05-01, it's", "一二三" * 400, *mixed, *[t for t in odd_texts() if t is None or len(t) < 30_000]]
    frame = spark.createDataFrame([doc(i % 70, t) for i, t in enumerate(texts)], DOC).withColumns({"ids": F.lit(0), "row": F.lit("mine"), "words": F.lit(1)})
    coded = sentencepiece.encode_texts(frame, model)
    got = Counter((r.doc_id, r.text, tuple(r.ids)) for r in coded.collect())
    assert got == Counter((i % 70, t, tuple(m.encode(t or ""))) for i, t in enumerate(texts)) and set(coded.columns) == set(frame.columns)
    back = Counter((r.doc_id, r.text) for r in sentencepiece.decode_texts(coded, model).collect())
    assert back == Counter((i % 70, (t or "").replace("▁", " ")) for i, t in enumerate(texts))
    assert sentencepiece.encode_texts(frame.limit(0), model).count() == 0


def test_very_long_words(spark):
    from sentencepiece import SentencePieceProcessor

    model = path("piece_bpe_32k.model")
    m = SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    texts = ["x" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "ab" * 3000 + "c" * 3000]
    coded = sentencepiece.encode_texts(spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC), model)
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: m.encode(t) for i, t in enumerate(texts)}


def test_query_encodes_and_decodes(spark, tmp_path, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(sentencepiece, "FREQUENT_WORDS", 40)  # most words are looked up by a join
    m = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    every = sentencepiece.Cutter([m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))])
    rng = random.Random(4)
    texts = ["  Hello  world\n x\t🙂", "a▁b  ", "日本語のテキスト", "\n\n a", None, "", "The quick brown foxes", "The quick brown foxes", sentence(rng, 3000)]
    frame = spark.createDataFrame([*[doc(i, t) for i, t in enumerate(texts)], doc(None, "no id"), doc(1, "again")], DOC)
    frame.write.parquet(str(tmp_path / "documents.parquet"))

    def want(text):
        ids, parts = m.encode(text or ""), []
        for w in every.words(text):
            parts.append((part := [], w))
            while sum(len(m.id_to_piece(i)) if not m.is_byte(i) else 0 for i in part) + (len(bytes(int(m.id_to_piece(i)[3:5], 16) for i in part if m.is_byte(i)).decode("utf-8", "ignore"))) < len(w):
                part.append(ids.pop(0))
        assert not ids
        digest = lambda texts: sum((k + 1) * zlib.crc32(t.encode()) % (2**31 - 1) for k, t in enumerate(texts))
        return len(parts), sum(len(p) for p, _ in parts), digest([",".join(map(str, p)) for p, _ in parts]), digest([w for _, w in parts]), True

    rows = queries.op6_sentencepiece(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_ids, r.ids_digest, r.text_digest, r.decoded_same) for r in rows) == Counter((i, *want(t)) for i, t in [*enumerate(texts), (None, "no id"), (1, "again")])
    assert sentencepiece.digests(frame.limit(0), path("piece_bpe_32k.model")).count() == 0


def test_words_leave_pieces_whole():
    every = sentencepiece.Cutter(["▁a", "b", "1", "!!"])
    assert every.words("a b1  22 c!!\n") == ["▁a", "▁b", "1", "▁▁", "2", "2", "▁c", "!!", "\n"]
    assert sentencepiece.Cutter(["▁a1", "b."]).words("a1 b.") == ["▁a1", "▁b."]
    assert sentencepiece.Cutter(["a▁b"]).words("a b c") == ["▁a▁b▁c"]
    assert every.words(None) == every.words("") == []


def test_viterbi(spark):
    pieces = {"▁": -3.0, "▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "aba": -6.0, "▁ab": -4.1, "ba": -1.2}
    table = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")
    costs = [-s for s in pieces.values()]
    words = ["▁abab", "▁ababa", "▁a", "▁bbb", "▁aéb"]
    got = {r.word: list(r.ids) for r in sentencepiece.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, costs, list(range(100, 356))).collect()}

    def best(w):
        out = [(0.0, [])] + [None] * len(w)
        for i in range(1, len(w) + 1):
            tries = []
            for j in range(max(0, i - 3), i):
                p = w[j:i]
                if p in pieces:
                    tries.append((out[j][0] + pieces[p], out[j][1] + [list(pieces).index(p)]))
                elif i - j == 1:
                    tries.append((out[j][0] - 16.0, out[j][1] + [100 + b for b in p.encode()]))
            out[i] = max(tries, key=lambda t: t[0])
        return out[-1][1]

    assert got == {w: best(w) for w in words}


# 7


def test_line_dedup(spark):
    rows = [doc(i, f"Share this\nbody {i}\n\n share THIS \nrare", "a" if i % 2 else None) for i in range(60)] + [doc(100, None, "a"), doc(101, "", "a"), doc(102, "Share this", "b"), doc(1, "Share this\nbody 1\n\n share THIS \nrare", "a")]
    frame = spark.createDataFrame(rows, DOC).withColumn("_common", F.lit("mine"))
    out = line_dedup.drop_boilerplate(frame)
    got = {(r.doc_id, r.source): r for r in out.collect()}
    assert out.columns == frame.columns and out.count() == len(rows) and got[1, "a"].text == "body 1\n" and got[0, None].text == "body 0\n" and got[100, "a"].text is None and got[101, "a"].text == "" and got[102, "b"].text == "Share this"
    assert got[1, "a"].n_chars == 7 and got[0, None]["_common"] == "mine" and line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


def over_limit(pages, host_pages):
    return pages >= 2 and 10 * pages > host_pages and 10 * (10 * pages - host_pages) ** 2 > 243 * host_pages


@pytest.mark.parametrize(("pages", "host_pages", "goes"), [(1, 1, False), (2, 2, True), (2, 6, True), (2, 7, False), (3, 12, True), (3, 13, False), (62, 500, True), (61, 500, False)])
def test_share_that_makes_boilerplate(spark, pages, host_pages, goes):
    assert over_limit(pages, host_pages) == goes
    frame = spark.createDataFrame([doc(i, f"only {i}" + ("\nfollow us" if i < pages else "")) for i in range(host_pages)], DOC)
    left = [r.text for r in line_dedup.drop_boilerplate(frame).collect()]
    assert sum("follow us" in t for t in left) == (0 if goes else pages) and all("only" in t for t in left)


def test_copies_are_one_page(spark):
    rng = random.Random(7)
    copied = "\n".join(sentence(rng, 12) for _ in range(4))
    rows = [doc(i, copied) for i in range(30)] + [doc(30 + i, sentence(rng, 30) + f" x{i}") for i in range(60)]
    left = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOC)).collect()}
    assert left == {i: t for i, t, *_ in rows}  # a third of the pages, whole
    kept = {r.doc_id: r.words_left == r.n_words for r in quality.judge_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert all(kept.values())


# 8


def plain_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality_metrics(spark, docs):
    more = spark.createDataFrame([doc(50, "a b c a b c a b c d"), doc(51, "# | <>\n# | <>\n\n \n# | <>"), doc(52, " ".join(f"w{i}" for i in range(60))), doc(None, "x y z")], DOC)
    every = docs.unionByName(more)
    texts = {r.doc_id: r.text for r in every.collect()}
    for r in quality.judge_documents(every).collect():
        n, chars, symbols, dup, repeat = plain_metrics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    kept = quality.keep_good_documents(every.withColumn("kept", F.lit("mine")))
    assert kept.columns == [*every.columns, "kept"] and 52 in {r.doc_id for r in kept.collect()} and quality.judge_documents(docs.limit(0)).count() == 0


def test_depleted_documents_go(spark):
    rng = random.Random(1)
    menu = "\n".join(" ".join(f"menu{k}w{i}" for i in range(15)) for k in range(4))
    rows = [doc(i, menu + "\n" + " ".join(f"only{i}x{j}" for j in range(5))) for i in range(40)] + [doc(100 + i, menu + "\n" + " ".join(f"long{i}x{j}" for j in range(200))) for i in range(5)] + [doc(200 + i, sentence(rng, 80) + f" end{i}") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.judge_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(5))


def test_lines_of_a_seventh_of_a_host(spark):
    menu = "\n".join(" ".join(f"menu{k}w{i}" for i in range(15)) for k in range(4))
    body = lambda i, n: " ".join(f"b{i}x{j}" for j in range(n))
    rows = [doc(i, f"{menu}\n{body(i, 10)}") for i in range(14)] + [doc(100 + i, f"{menu}\n{body(100 + i, 90)}") for i in range(6)] + [doc(200 + i, body(i + 200, 80)) for i in range(120)]
    rare = "\n".join(" ".join(f"rare{k}w{i}" for i in range(15)) for k in range(4))
    rows += [doc(400 + i, f"{rare}\n{body(400 + i, 10)}", "other") for i in range(8)] + [doc(500 + i, body(500 + i, 80), "other") for i in range(100)]
    got = {r.doc_id: (r.words_left, r.kept) for r in quality.judge_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert over_limit(20, 140) and not over_limit(8, 108)
    assert all(got[i] == (10, False) for i in range(14)) and all(got[100 + i] == (90, True) for i in range(6)) and all(got[400 + i] == (70, True) for i in range(8))


def test_repeated_words_of_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(150)}" for _ in range(60_000)]
    (r,) = quality.judge_documents(spark.createDataFrame([doc(1, " ".join(words))], DOC)).collect()
    assert r.n_repeat_words == plain_metrics(" ".join(words))[4]


# 9


def test_chain_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        toxic, junk = i % 5 == 0, i % 7 == 0
        words = sentence(rng, 40).split() + (["awfulness", "nastily"] if toxic else []) + (["zzz"] * 10 + ["$$$"] if junk else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(junk), int(toxic)))
    rows += [(9000, None, 0, 0), (9001, "", None, 1), (9002, "x" * 100_000, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, junk int, toxic int")
    labels = frame.where("doc_id % 2 = 0").select("doc_id", "junk", "toxic")
    out = toxicity.score_documents(frame.select("doc_id", "text"), labels, ("junk", "toxic")).collect()
    held = [r for r in out if r.doc_id < 900 and r.doc_id % 2]
    assert len(out) == len(rows) and sum(r.toxic == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held) and sum((r.p_junk > 0.5) == (r.doc_id % 7 == 0) for r in held) >= 0.97 * len(held)
    none = toxicity.score_documents(frame.select("doc_id", "text"), labels.limit(0), ("junk", "toxic")).collect()
    assert {r.p_toxic for r in none} == {0.5}
    assert toxicity.score_documents(frame.select("doc_id", "text").limit(0), labels, ("junk", "toxic")).count() == 0


def test_chain_samples_labels_that_have_a_document(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 20) + (" awfulness" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic").unionByName(spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    chain = toxicity.fit_chain(frame.select("doc_id", "text"), labels, ("toxic",), most_rows=300)
    assert b"awfulness" in chain.links[0].words
    p = 1 / (1 + np.exp(-chain.logits([b"time year awfulness", b"time year people"])[:, 0]))
    assert p[0] > 0.9 and p[1] < 0.1


def test_chain_bounds_repeated_ids(spark):
    rows = [(i % 20, f"word{i % 2} time year " * 3 + str(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("mine"), "y": F.lit(1), "fold": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    out = toxicity.score_documents(docs, labels, ("toxic",), most_rows=10)
    assert out.count() == 400
    with_rows = []
    kept = toxicity._telling_words
    try:
        toxicity._telling_words = lambda frame, *rest: (with_rows.append(frame.count()), kept(frame, *rest))[1]
        toxicity.fit_chain(docs, labels, ("toxic",), most_rows=10)
    finally:
        toxicity._telling_words = kept
    assert with_rows == [10]


def test_scratch_tables_can_be_cleared(spark):
    scratch.clear()
    got = components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    assert got == 41 and scratch.clear() == 1 and scratch.clear() == 0


def test_chain_keeps_its_bounds(spark):
    rows = [(i, " ".join(f"w{i % 2}x{k}" for k in range(700)), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit_chain(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), ("toxic",))
    assert len(chain.links[0].words) == 400 and toxicity.MOST_ROWS == 20_000


# 10


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "q", "ÿ" * 200_000), (2, "http://b", "x"), (None, "q", "alone")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = Counter([(1, 1, digest("x"), "revisit", 2), (2, 1, digest("x"), "response", None), (2, 1, digest("x"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None), (5, 400_000, digest("ÿ" * 200_000), "response", None), (None, 5, digest("alone"), "response", None)])
    assert got == want and warc.round_trip(pages.limit(0)).count() == 0


def test_warc_pushes_filters_down(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"body {i // 2}") for i in range(40)], "page_id long, url string, html string")
    place = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(pages), place)
    read = warc.read_warc(spark, place).where("record_type = 'response' and target_uri like 'http://h1/%'")
    assert "EqualTo" not in read._jdf.queryExecution().executedPlan().toString() and {r.payload.decode() for r in read.collect()} == {f"body {i // 2}" for i in range(40) if i % 2 and i % 3 == 1}
    assert warc.read_warc(spark, place, payload=False).where("payload is not null").count() == 0
    every = warc.read_warc(spark, place)
    assert [every.count(), every.where("record_type = 'revisit'").count(), every.count(), every.where("record_type = 'response'").count()] == [40, 20, 40, 20]


def test_warc_writes_add_up(spark, tmp_path):
    place = str(tmp_path / "w")
    record = lambda *ids: warc.with_revisits(spark.createDataFrame([(i, f"http://h/{i}", f"body {i}") for i in ids], "page_id long, url string, html string"))
    read = lambda: sorted(r.payload.decode() for r in warc.read_warc(spark, place).collect())
    warc.write_warc(record(1, 2), place)
    warc.write_warc(record(3), place)
    assert read() == ["body 1", "body 2", "body 3"]
    (tmp_path / "w" / "left.warc.gz").write_bytes(b"of a lost task")
    warc.write_warc(record(4), place)
    assert read() == ["body 1", "body 2", "body 3", "body 4"]
    warc.write_warc(record(5), place, "overwrite")
    assert read() == ["body 5"] and len(list((tmp_path / "w").glob("_records-*.json"))) == 1
    writer = warc.WarcWriter(place, ["record_type", "payload"])
    written = writer.write(iter([pa.RecordBatch.from_pylist([{"record_type": "response", "payload": b"never"}])]))
    assert (tmp_path / "w" / written.name).exists()
    writer.abort([written, None])
    assert not (tmp_path / "w" / written.name).exists() and read() == ["body 5"]


def test_warc_archives_that_are_cut(spark, tmp_path):
    place = tmp_path / "w"
    warc.write_warc(warc.with_revisits(spark.createDataFrame([(1, "http://h/1", "x" * 5000)], "page_id long, url string, html string")).coalesce(1), str(place))
    (file,) = [f for f in place.glob("*.warc.gz") if f.stat().st_size]
    file.write_bytes(file.read_bytes()[:-30])
    with pytest.raises(PySparkException, match="ends within a record"):
        warc.read_warc(spark, str(place)).collect()
    assert warc.read_warc(spark, str(place)).where("record_type = 'revisit'").count() == 0


def test_round_trip_pushes_record_types_down(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"body {i // 2}") for i in range(10)], "page_id long, url string, html string")
    plan = warc.round_trip(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "= response" not in plan and "= revisit" not in plan  # Spark is left no filter but that for nulls


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.payload for r in got) == [b"abc", b"abc", b"hello", b"hello"]
    assert warc.read_warc(spark, str(tmp_path)).where("record_type = 'response'").count() == 2


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf_dir)
        assert current.columns == docs.columns
        current = spark.createDataFrame(current.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in current.collect()}
    check_layout(packed, 4096)
    tok = TokenIds(path("word_bpe_49k.json"))
    want = Counter()
    for r in current.collect():
        raw = tok.of(r.text or "") + b"\1\0\0\0"
        for k, at in enumerate(range(0, len(raw), 4 * 4096)):
            want[r.doc_id, k, zlib.crc32(raw[at : at + 4 * 4096])] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    copied = sentence(rng, 40) + "\n" + sentence(rng, 40)
    shared = copied.split("\n")[0] + "\n" + sentence(rng, 120)
    texts = [sentence(rng, 80) for _ in range(39)] + [shared] + [copied] * 20
    spark.createDataFrame([doc(i, t + ("\nshare this" if i < 30 else "")) for i, t in enumerate(texts)], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = TokenIds(path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(tok.of(t) + b"\1\0\0\0")
    # the copies are one page of 41, the line of the first 30 is boilerplate, and each text is packed once
    assert Counter(r.ids_crc32 for r in packed) == Counter(crc(t) for t in texts[:41])


def plain_boilerplate(rows):
    """(source, line) of the lines over the limit, over a source's distinct texts."""
    texts = {(r["source"], r["text"]) for r in rows if plain_metrics(r["text"])[0]}
    pages = Counter(source for source, _ in texts)
    held = Counter((source, line) for source, text in texts for line in {x.strip().lower() for x in text.split("\n") if x.strip()})
    return {k for k, n in held.items() if over_limit(n, pages[k[0]])}


def plain_pipeline(rows):
    """The stages of the pipeline before packing, one by one."""
    common, kept = plain_boilerplate(rows), []
    for r in rows:
        n, _, _, _, repeat = plain_metrics(r["text"])
        left = sum(len(x.split()) for x in (r["text"] or "").split("\n") if (r["source"], x.strip().lower()) not in common)
        if not (n < 50 or 100 * repeat > 50 * n) and left >= 0.3 * n:
            kept.append(r)
    common = plain_boilerplate(kept)
    lined = [r | {"text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip().lower()) not in common)} for r in kept]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in lined}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    one = [r for r in lined if label[r["doc_id"]] == r["doc_id"]]
    return len(kept), [r | {"text": re.sub(r"(?<=password=)\w{6,}", "[assign removed]", r["text"])} for r in one]


def test_pipeline_against_plain_code(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    menu = "\n".join(" ".join(f"menu{k}x{j}" for j in range(25)) for k in range(3))
    copied = sentence(rng, 70) + "\n" + sentence(rng, 30)
    texts = [("a", sentence(rng, 80) + f" end{i}" + ("\n Share THIS page\nmore text here" if i % 2 else "")) for i in range(40)]
    texts += [("a", copied)] * 25 + [("b", f"{copied} near{i}") for i in range(6)] + [("b", sentence(rng, 90) + f" b{i}") for i in range(40)]
    texts += [("c", f"{menu}\nonly{i} few words") for i in range(12)] + [("c", f"{menu}\n" + sentence(rng, 90) + f" c{i}") for i in range(4)] + [("c", sentence(rng, 60) + f" d{i}") for i in range(20)]
    texts += [("b", sentence(rng, 60) + f" password=hunter{i}secret " + sentence(rng, 9)) for i in range(4)] + [("b", None), ("b", ""), ("b", "too short"), ("b", "again and again " * 40), (None, sentence(rng, 5000))]
    rows = [{"doc_id": i, "text": t, "source": s} for i, (s, t) in enumerate(texts)]
    spark.createDataFrame([doc(r["doc_id"], r["text"], r["source"]) for r in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    passed, want = plain_pipeline(rows)
    assert len(rows) > passed > len(want) > 80  # every stage has something to do
    tok = TokenIds(path("word_bpe_49k.json")).tokenizer
    pieces = Counter()
    for r in want:
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[r["doc_id"], k, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == pieces
    check_layout(packed, 4096)
