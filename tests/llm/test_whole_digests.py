"""op6's digests come from every document's own ids and from the text that those decode to."""

import zlib

import numpy as np
from sentencepiece import SentencePieceProcessor

from almanax.llm import queries, sentencepiece
from almanax.llm.queries import tokenizer


def test_documents_are_encoded_and_decoded_whole(spark, tmp_path, monkeypatch):
    texts = ["  Hello  world\n x\t🙂", "a▁b  ", "", None, "The quick brown foxes", "日本語のテキスト " * 50, "The quick brown foxes"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    m = SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepiece, "CHUNK_CHARS", 30)
    rows = queries.op6_sentencepiece(spark, str(tmp_path)).collect()
    crc = lambda text: zlib.crc32(text.encode())
    want = {i: (len(m.encode(t or "")), crc(",".join(map(str, m.encode(t or "")))), crc((t or "").replace("▁", " ")), True) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_ids, r.ids_crc32, r.text_crc32, r.decoded_same) for r in rows} == want
    by_words = ["doc_id", "n_words", "n_ids", "ids_digest", "text_digest", "decoded_same"]
    plain = sentencepiece.word_digests(frame, tokenizer("piece_bpe_32k.model")).select(by_words).collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r[c] for c in by_words) for r in rows)


def test_no_text_is_shuffled_or_written(spark, tmp_path, monkeypatch):
    """Only words of a bounded sample are; all rows stay where they are read."""
    saved = []
    save = sentencepiece.save
    monkeypatch.setattr(sentencepiece, "save", lambda df, name: saved.append((name, df.columns)) or save(df, name))
    frame = spark.createDataFrame([(i, f"text {i} of words") for i in range(50)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op6_sentencepiece(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    assert saved == [("words", ["word"])]


def test_the_fold_of_many_words_is_the_fold_by_aggregate(spark, monkeypatch):
    """Words of any length, frequent or not, with pieces or without, whose edges come in several parts."""
    model = tokenizer("piece_bpe_32k.model")
    monkeypatch.setattr(sentencepiece, "TASK_EDGES", 50)
    monkeypatch.setattr(sentencepiece, "FREQUENT_WORDS", 3)
    monkeypatch.setattr(sentencepiece, "CHUNK_CHARS", 200)
    texts = ["internationalization", "ab" * 90, "🙂é\x00x", "thonretionthha" * 3, "x", "anblewh sttible"] + [f"word{i}ing" for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    m, costs = SentencePieceProcessor(model_file=model), sentencepiece.piece_costs(model)
    every = sentencepiece.Cutter([p for p, _, _ in sentencepiece._texts_of(m)])
    words = sorted({w for t in texts for w in every.words(t)})
    coded = sentencepiece.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), sentencepiece.load_pieces(spark, model, costs), costs, sentencepiece.byte_ids(model))
    ids = {r.word: list(r.ids) for r in coded.collect()}
    got = {r.text: list(r.ids) for r in sentencepiece.encode_texts(frame, model).collect()}
    assert got == {t: [i for w in every.words(t) for i in ids[w]] for t in texts} == {t: m.encode(t) for t in texts}


def test_the_fold_by_scores():
    """A unigram model's costs: the best sum; of equal ways that whose last piece is longer."""
    pieces = {"▁": -3.0, "▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "aba": -6.0, "▁ab": -4.1, "ba": -1.2}
    fold = object.__new__(sentencepiece._Fold)
    fold.bpe, fold.costs, fold.bytes_of, fold.score, fold.unknown = False, [-s for s in pieces.values()], list(range(100, 356)), np.array(list(pieces.values())), -16.0
    fold.rank = fold.left = np.zeros(len(pieces), np.int64)
    fold.char = np.full(max(map(ord, "▁ab")) + 2, -1, np.int32)
    for p in "▁ab":
        fold.char[ord(p)] = list(pieces).index(p)
    words = ["▁abab", "▁ababa", "ab", "▁bbb", "▁aéb", "b" * 70 + "ab"]
    edges = [(k, e, n, list(pieces).index(w[e - n : e])) for k, w in enumerate(words) for e in range(1, len(w) + 1) for n in (2, 3) if n <= e and w[e - n : e] in pieces]
    ids, first, sizes = fold(words, *np.array(edges).T)

    def best(w):
        out = [(0.0, [])]
        for i in range(1, len(w) + 1):
            tries = []
            for j in range(i - 1, max(0, i - 3) - 1, -1):
                if w[j:i] in pieces:
                    tries.append((out[j][0] + pieces[w[j:i]], i - j, [*out[j][1], list(pieces).index(w[j:i])]))
                elif i - j == 1:
                    tries.append((out[j][0] - 16.0, 1, [*out[j][1], *[100 + b for b in w[j:i].encode()]]))
            score, _, way = max(tries)
            out.append((score, way))
        return out[-1][1]

    assert [ids[a : a + n].tolist() for a, n in zip(first, sizes, strict=True)] == [best(w) for w in words]
