"""SentencePiece encoding and decoding as relations.

Method. Texts are cut into words at places that no piece spans. Of every distinct word the substrings up to the longest piece
are exploded and equi-joined to the piece table; the edges found are grouped by word, and Spark's higher-order aggregate folds
each word's lattice by Viterbi: the best way to each place, from left to right, is the best of those that its edges prolong.

The cost of a way. Of a unigram model it is the sum of its pieces' negated scores. A BPE model merges the best-ranked
neighbours first, the leftmost of equal ones, which is Viterbi too: a word's possible merges, in the order of (rank, place),
gain 2^k, 2^(k-1) and so on, a piece gains the sum over the merges that make it, and a way that over its pieces. So of two ways
the one with the first merge that they don't share is better, and the ids are the library's. Words with more merges than a
number has bits have sorted lists of merges in place of sums, compared alike; merges that all ways within reach share are
dropped from long lists, as they decide nothing. All this holds for models whose pieces merge in the order of their ranks,
which is checked as a model is read.

To encode texts, the words that are most frequent in some of the rows are encoded first, once, and their ids go to all tasks. A
task holds a chunk of texts as numbers of words; the chunk's distinct other words are exploded and joined to the piece table
between its rows, in their order, and a NumPy fold goes through the lattices of many words at once, by the same costs and the same
choice between equal ways. So no row, no text and no id is shuffled or written: words that few chunks share are cheaper encoded
in each of them than moved. encode_words() is the fold by Spark's aggregate, of each distinct word once.

Decoding looks each row's ids up in the piece table, an array of fixed size, and puts the bytes found together; no row moves.

Defined results: a null or empty text has no ids. Characters without a piece become the ids of their UTF-8 bytes. A blank is
the model's space mark, one of which stands before every text. Repeated rows are encoded each, and any key will do. An empty
table gives an empty result. Words may be of any length; those without a place that no piece spans are one word.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import count, islice, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from almanax.llm.scratch import save

SPACE = "▁"
#: Ways to cut a marked text into words, finest first; the first that leaves every piece whole is taken.
WORDS = (rf"{SPACE}*[^\W\d_¹²³]+|\d|{SPACE}+(?=\d)|{SPACE}*(?:[^\w{SPACE}\n]|[_¹²³])+|\n|{SPACE}+", rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+", r"(?s:.+)")
#: Longer words are cut where two characters meet that no piece holds side by side; longer costs lose their common merges.
LONG_WORD, LONG_COST = 64, 64
#: Merges of a word that weigh as powers of two, whose sums a double holds exactly; with more, costs are lists.
MOST_WEIGHTS = 52
#: Characters of a chunk's texts, beyond which a new one begins, and words of a lattice task.
CHUNK_CHARS, TASK_WORDS = 20 << 20, 40_000
#: Words that go to all tasks: at most so many, of at most so many characters; and distinct tokens that a task holds at once.
FREQUENT_WORDS, FREQUENT_CHARS, TASK_TOKENS = 300_000, 32, 250_000
#: Rows by which it is told which words are frequent, and edges of words that a task folds at once.
SAMPLE_ROWS, TASK_EDGES = 16_384, 400_000
PRIME = (1 << 31) - 1
_BEHIND_BLANKS = re.compile(rf"{SPACE}+[^{SPACE}]*").findall
_END = (1 << 63) - 1


def _model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _texts_of(m) -> list[tuple[str, int, float]]:
    return [(m.id_to_piece(i), i, float(m.get_score(i))) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


def merges(piece: str, rank: dict[str, int]) -> list[tuple[int, int]] | None:
    """(rank, place) of the merges that make a piece of its characters, in their order; None if they don't."""
    parts, places, out = list(piece), list(range(len(piece))), []
    while len(parts) > 1:
        pairs = [(rank[a + b], k) for k, (a, b) in enumerate(pairwise(parts)) if a + b in rank]
        if not pairs:
            return None
        r, k = min(pairs)
        out.append((r, places[k]))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del places[k + 1]
    return out


def load_pieces(spark: SparkSession, model: str, costs: list) -> DataFrame:
    """piece and id of the pieces that have costs; a table of the model's fixed size."""
    return spark.createDataFrame([(p, i) for p, i, _ in _texts_of(_model(model)) if costs[i] is not None], "piece string, id int").coalesce(1)


def piece_costs(model: str, kind: str = "bpe") -> list:
    """Per id what its piece costs: a negated score (unigram), or the merges that make it, each as rank << 32 | place (bpe).

    Of a BPE model, None for ids that no merges make.
    """
    rows, m = _texts_of(_model(model)), _model(model)
    out: list = [None] * m.get_piece_size()
    rank = {p: k for k, (p, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    for p, i, score in rows:
        made = merges(p, rank) if kind == "bpe" else None
        if made is not None and any(a > b for (a, _), (b, _) in pairwise(made)):
            raise ValueError("a piece of this model does not merge in the order of its ranks")
        out[i] = -score if kind == "unigram" else None if made is None else [(r << 32) + at for r, at in made]
    return out


def byte_ids(model: str) -> list[int]:
    m = _model(model)
    return [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Cutter:
    """Cuts texts into words whose pieces are those of the text; the words put together are the marked text."""

    def __init__(self, pieces: list[str]) -> None:
        self.find = next(f for f in (re.compile(w).findall for w in WORDS) if all(f(p) == [p] for p in pieces))
        self.adjoin = {a + b for p in pieces for a, b in pairwise(p)}

    def tokens(self, text: str | None) -> list[str]:
        """What stands behind the blanks, more of which begin a token; cut() gives the words of each."""
        if not text:
            return []
        if self.find.__self__.pattern == WORDS[-1]:
            return [text.replace(" ", SPACE)]
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [t[1:] for t in _BEHIND_BLANKS(SPACE + text.replace(" ", SPACE))]

    def cut(self, token: str) -> list[str]:
        return self._cut(SPACE + token)

    def words(self, text: str | None) -> list[str]:
        return self._cut(SPACE + text.replace(" ", SPACE)) if text else []

    def _cut(self, marked: str) -> list[str]:
        found = self.find(marked)
        return [part for w in found for part in (self._parts(w) if len(w) > LONG_WORD else [w])] if max(map(len, found)) > LONG_WORD else found

    def _parts(self, word: str) -> Iterator[str]:
        first = 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.adjoin:
                yield word[first:k]
                first = k
        yield word[first:]


def _chunks(cutter: Cutter, frequent: list[str]):
    """Of each chunk its words that aren't frequent, numbered behind those, then its rows with their words as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, places = count(TaskContext.get().partitionId() << 40), {w: i for i, w in enumerate(frequent)}
        held, found, tokens, size = [], [], defaultdict(count().__next__), 0
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                at = 0
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = cutter.tokens(text)
                    found.append(np.fromiter(map(tokens.__getitem__, own), np.int32, len(own)))
                    size += len(text or "")
                    if size >= CHUNK_CHARS:
                        yield from told(next(number), places, [*held, batch.column(0).slice(at, k + 1 - at)], found, tokens)
                        held, found, tokens, size, at = [], [], defaultdict(count().__next__), 0, k + 1
                held.append(batch.column(0).slice(at))
        if found:
            yield from told(next(number), places, held, found, tokens)

    def told(chunk: int, places: dict[str, int], held: list[pa.Array], found: list[np.ndarray], tokens: dict[str, int]) -> Iterator[pa.RecordBatch]:
        known = defaultdict(count(len(places)).__next__, places)
        flat, ends = array("i"), array("q")
        for t in tokens:
            flat.extend(map(known.__getitem__, cutter.cut(t)))
            ends.append(len(flat))
        tokens.clear()
        words, sizes = np.frombuffer(flat, np.int32), np.diff(np.frombuffer(ends, np.int64), prepend=0)
        first = np.cumsum(sizes) - sizes
        rare = list(islice(known, len(places), None))
        known.clear()
        for k in range(0, len(rare), 10_000):
            n = len(some := rare[k : k + 10_000])
            yield table(held[0].type, n, chunk=pa.array([chunk] * n, pa.int64()), idx=pa.array(range(len(places) + k, len(places) + k + n), pa.int32()), word=pa.array(some, pa.string()))
        at = 0
        for rows in held:
            used, at = found[at : at + len(rows)], at + len(rows)
            if used:
                place, ends = _ragged(first, sizes, np.concatenate(used))
                row_ends = 4 * ends[np.r_[0, np.cumsum([len(u) for u in used])]]
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(row_ends.astype(np.int32)), pa.py_buffer(words[place])])
                yield table(rows.type, len(rows), chunk=pa.array([chunk] * len(rows), pa.int64()), row=rows, words=packed)

    def table(carried: pa.DataType, n: int, **columns) -> pa.RecordBatch:
        schema = pa.schema([("chunk", pa.int64()), ("row", carried), ("words", pa.binary()), ("idx", pa.int32()), ("word", pa.string())])
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    return run


def _ragged(first: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of the lists used lie, one after another, and the ends of those lists, from 0."""
    n = sizes[used]
    ends = np.r_[0, np.cumsum(n)]
    return np.repeat(first[used] - ends[:-1], n) + np.arange(ends[-1]), ends


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """wid, of and edges, sorted: end << 40 | len << 32 | id + 1. words: wid, word and of (a struct with word), which goes along.

    Each place has an edge of one character, without an id (0) if that is no piece.
    """
    # dealt by wid, whose rows then stay together through both explosions and the grouping
    spans = words.select("wid", "word", "of", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    size = F.least(F.lit(longest), "end")
    spans = spans.select("wid", "end", F.substring("word", F.col("end") - size + 1, size).alias("tail"), F.when(F.col("end") == 1, F.col("of")).alias("of"))
    # of one character only a word's first substring, which brings the word along
    spans = spans.select("wid", "of", "end", "tail", F.explode(F.sequence(F.least(F.lit(2), F.length("tail")), F.length("tail"))).alias("len"))
    spans = spans.select("wid", "of", "end", "len", F.expr("right(tail, len)").alias("piece"))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    code = lambda end, n, place: F.shiftleft(end.cast("long"), 40) + F.shiftleft(n.cast("long"), 32) + place
    edge = F.when(F.col("len") > 1, code(F.col("end"), F.col("len"), F.col("id") + 1))  # NULL is not collected
    grouped = edges.groupBy("wid").agg(F.max("of").alias("of"), F.collect_list(edge).alias("edges"))
    # a table of the characters that are pieces, by code point
    chars = {ord(r["piece"]): r["id"] for r in pieces.where(F.length("piece") == 1).collect()}
    table = F.from_json(F.lit(json.dumps([chars.get(k, -1) + 1 for k in range(max(chars, default=0) + 1)])), "array<int>")
    each = F.transform(F.split("of.word", ""), lambda c, i: code(i + 1, F.lit(1), F.coalesce(F.get(table, F.ascii(c)), F.lit(0))))
    return grouped.select("wid", "of", F.sort_array(F.concat("edges", each)).alias("edges"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once; unlike transform(), aggregate() doesn't copy what it gives."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, f)


def _without_common(costs: Column) -> Column:
    """Lists without the merges that all of them have."""
    common = F.aggregate(costs, F.element_at(costs, 1), F.array_intersect)
    return _let(common, lambda c: F.transform(costs, lambda x: F.concat(F.array_except(x, c), F.array(F.lit(_END)))))


def viterbi(edges: Column, longest: int, lists: bool = False) -> Column:
    """The pieces (end << 8 | len, in order) of a word by its sorted edges (end, len, cost); of equal ways that whose last piece is longer.

    Costs are numbers, of which a way has the sum, or lists (of a character: an empty one), of which it has the sorted union.
    """
    # costs: of the best ways to the places before; best and edge: the best way so far to the place at hand, and its last piece
    state = lambda costs, chosen, best, edge: F.struct(costs.alias("costs"), chosen.alias("chosen"), best.alias("best"), edge.alias("edge"))
    named = lambda e: F.shiftleft(e["end"], 8) + e["len"]

    def opened(s: Column, e: Column) -> Column:
        """The first edge of a place has one character: the best way to the place before is known."""
        costs, chosen = F.concat(s["costs"], F.array(s["best"])), F.concat(s["chosen"], F.array(s["edge"]))
        if not lists:
            return state(costs, chosen, s["best"] + e["cost"], named(e))
        near = _let(costs, lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - longest + 1), F.lit(longest)))
        near = F.when(F.size(s["best"]) > LONG_COST, _without_common(near)).otherwise(near)
        return _let(near, lambda c: state(c, chosen, F.element_at(c, -1), named(e)))

    def tried(s: Column, e: Column) -> Column:
        before = F.element_at(s["costs"], -e["len"])
        if lists:
            return _let(F.sort_array(F.concat(before, e["cost"])), lambda w: F.when(w <= s["best"], state(s["costs"], s["chosen"], w, named(e))).otherwise(s))
        return F.when(before + e["cost"] <= s["best"], state(s["costs"], s["chosen"], before + e["cost"], named(e))).otherwise(s)

    none = F.array().cast("array<int>")
    zero = state(F.array().cast("array<array<bigint>>" if lists else "array<double>"), none, F.array(F.lit(_END)) if lists else F.lit(0.0), F.lit(0))
    chosen = F.aggregate(edges, zero, lambda s, e: F.when(e["len"] == 1, opened(s, e)).otherwise(tried(s, e)), lambda s: F.concat(s["chosen"], F.array(s["edge"])))
    # of the last pieces of the best ways to all places, those that the whole word's way has
    pair = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    taken = lambda s, x: F.when(F.shiftright(x, 8) == s["at"], pair(s["at"] - x.bitwiseAND(255), F.concat(s["out"], F.array(x)))).otherwise(s)
    return F.aggregate(F.reverse(chosen), pair(F.element_at(edges, -1)["end"], none), taken, lambda s: F.reverse(F.filter(s["out"], lambda x: x > 0)))


def best_pieces(edges: Column, costs: list, longest: int) -> Column:
    """The pieces of a word, as of viterbi(), by its edges as of lattice() and the costs of piece_costs()."""
    end, size = lambda c: F.shiftright(c, 40).cast("int"), lambda c: F.shiftright(c, 32).bitwiseAND(255).cast("int")
    place = lambda c: c.bitwiseAND(0xFFFFFFFF).cast("int")  # noqa: E731  id + 1
    edge = lambda e, n, cost: F.struct(e.alias("end"), n.alias("len"), cost.alias("cost"))
    if all(c is None or isinstance(c, float) for c in costs):
        table = F.from_json(F.lit(json.dumps([max((c for c in costs if c is not None), default=0.0) + 10.0, *costs])), "array<double>")
        return viterbi(F.transform(edges, lambda c: edge(end(c), size(c), F.element_at(table, place(c) + 1))), longest)
    # a character costs nothing, with an id or without
    table = F.from_json(F.lit(json.dumps([[], *[[] if c is None else c for c in costs]])), "array<array<bigint>>")
    moved = lambda c: F.when(size(c) == 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.element_at(table, place(c) + 1), lambda m: m + (end(c) - size(c))))
    powers = F.from_json(F.lit(json.dumps([2.0 ** (MOST_WEIGHTS - k) for k in range(MOST_WEIGHTS)])), "array<double>")

    def told(listed: Column) -> Column:
        def weighed(ranked: Column) -> Column:
            weight = lambda x: F.aggregate(x["cost"], F.lit(0.0), lambda a, m: a - F.element_at(powers, F.array_position(ranked, m).cast("int")))
            summed = viterbi(F.transform(listed, lambda x: edge(x["end"], x["len"], weight(x))), longest)
            return F.when(F.size(ranked) <= MOST_WEIGHTS, summed).otherwise(viterbi(listed, longest, lists=True))

        # an edge's own merge is its last; the merges of its parts are edges too
        return _let(F.sort_array(F.transform(F.filter(listed, lambda x: x["len"] > 1), lambda x: F.element_at(x["cost"], -1))), weighed)

    return _let(F.transform(edges, lambda c: edge(end(c), size(c), moved(c))), told)


def _ids(word: Column, edges: Column, pieces: Column, bytes_of: list[int]) -> Column:
    """Ids of a word's pieces; a character without an id gives those of its bytes."""
    table = F.from_json(F.lit(json.dumps(bytes_of)), "array<int>")
    hexes = lambda x: F.hex(F.encode(x, "utf-8"))
    fallback = lambda x: _let(hexes(x), lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda p: F.element_at(table, F.conv(F.substr(h, p, F.lit(2)), 16, 10).cast("int") + 1)))
    place = lambda c: c.bitwiseAND(0xFFFFFFFF).cast("int")
    char = lambda c: F.substr(word, F.shiftright(c, 40).cast("int"), F.lit(1))

    def told(taken: Column) -> Column:
        spelt = F.flatten(F.transform(taken, lambda c: F.when(place(c) > 0, F.array(place(c) - 1)).otherwise(fallback(char(c)))))
        return F.when(F.exists(taken, lambda c: place(c) == 0), spelt).otherwise(F.transform(taken, lambda c: place(c) - 1))

    taken = _let(pieces, lambda ps: F.filter(edges, lambda c: F.array_contains(ps, F.shiftright(c, 32).cast("int"))))
    return _let(taken, told)


def encode_words(words: DataFrame, pieces: DataFrame, costs: list, bytes_of: list[int], tasks: int | None = None, *also: str) -> DataFrame:
    """word, ids and other columns of distinct words that aren't empty. pieces: piece and id; costs: by id, as of piece_costs()."""
    tasks = tasks or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    told = lattice(words.select(F.monotonically_increasing_id().alias("wid"), "word", F.struct("word", *also).alias("of")).repartition(tasks, "wid"), pieces, longest)
    told = told.select("of", "edges", best_pieces(F.col("edges"), costs, longest).alias("pieces"))
    return told.select("of.*", _ids(F.col("of.word"), F.col("edges"), F.col("pieces"), bytes_of).alias("ids"))


class _Fold:
    """Viterbi over the lattices of many words at once, place by place, with the costs and the order of ways of viterbi()."""

    def __init__(self, model: str, costs: list) -> None:
        rows = [(p, i) for p, i, _ in _texts_of(_model(model)) if costs[i] is not None]
        self.costs, self.bytes_of, self.bpe = costs, byte_ids(model), not any(isinstance(c, float) for c in costs)
        # per id: of bpe the rank and the left part's length of the last merge, else its score
        self.rank, self.left, self.score = (np.zeros(len(costs), t) for t in (np.int64, np.int64, np.float64))
        for p, i in rows:
            if not self.bpe:
                self.score[i] = -costs[i]
            elif len(p) > 1:
                starts = list(range(len(p)))
                for m in costs[i]:
                    k = starts.index(m & 0xFFFFFFFF) + 1
                    self.rank[i], self.left[i] = m >> 32, starts.pop(k)
        self.char = np.full(max((ord(p) for p, _ in rows if len(p) == 1), default=0) + 2, -1, np.int32)  # the last: of all others
        for p, i in rows:
            if len(p) == 1:
                self.char[ord(p)] = i
        self.unknown = 0.0 if self.bpe else -max((c for c in costs if c is not None), default=0.0) - 10.0

    def __call__(self, words: list[str], of: np.ndarray, end: np.ndarray, size: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and by word where they begin and how many they are. Edges of more than one character: of (their word), end, size and piece."""
        lengths, n_edges = np.fromiter(map(len, words), np.int64, len(words)), np.bincount(of, minlength=len(words))
        long = (lengths > LONG_WORD) | (self.bpe & (n_edges > MOST_WEIGHTS))
        order = np.argsort(np.where(long, LONG_WORD + 1, lengths), kind="stable")  # words of one length side by side
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        by = np.lexsort((end - size, self.rank[piece], place[of]))
        at, start, size, piece = place[of][by], (end - size)[by], size[by], piece[by]
        firsts = np.searchsorted(at, np.arange(len(words) + 1))
        out, n_short = [], len(words) - int(long.sum())
        for k in range(0, n_short, 2048):
            stop = min(k + 2048, n_short)
            e = slice(firsts[k], firsts[stop])
            turn = np.arange(e.start, e.stop) - firsts[at[e]]
            out.append(self._block([words[w] for w in order[k:stop]], at[e] - k, start[e], size[e], piece[e], turn))
        for k in range(n_short, len(words)):
            e = slice(firsts[k], firsts[k + 1])
            out.append(self._long(words[order[k]], start[e].tolist(), size[e].tolist(), piece[e].tolist()))
        ids, sizes = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return ids.astype(np.int32), (np.cumsum(sizes) - sizes)[place], sizes[place]

    def _spelt(self, ids: np.ndarray, codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word; those below 0 are the ids of their character's bytes."""
        none = np.flatnonzero(ids < 0).tolist()
        spelt = [[self.bytes_of[b] for b in chr(codes[k]).encode()] for k in none]
        times = np.ones(len(ids), np.int64)
        times[none] = [len(x) for x in spelt]
        begin, out = np.cumsum(times) - times, np.repeat(ids, times)
        for k, x in zip(none, spelt, strict=True):
            out[begin[k] : begin[k] + len(x)] = x
        return out, np.bincount(np.repeat(of, times), minlength=n)

    def _chars(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        return codes, self.char[np.minimum(codes, len(self.char) - 1)]

    def _block(self, words: list[str], of: np.ndarray, start: np.ndarray, size: np.ndarray, piece: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        codes, chars = self._chars(words)
        first, longest, widest = np.cumsum(lengths) - lengths, int(lengths.max()), int(size.max(initial=1))
        gain = np.full((longest, widest + 1, n), -np.inf)  # of the edges by their start, size and word
        idx = np.repeat(np.arange(n), lengths), np.arange(len(codes)) - np.repeat(first, lengths)
        gain[:, 1] = 0.0
        gain[idx[1], 1, idx[0]] = 0.0 if self.bpe else np.where(chars < 0, self.unknown, self.score[chars])
        ids = np.zeros((longest, widest + 1, n), np.int32)
        ids[start, size, of] = piece
        for s in range(2, widest + 1):  # of bpe the last merge of an edge, and those of its two parts
            e = np.flatnonzero(size == s)
            p, w, left = start[e], of[e], self.left[piece[e]]
            gain[p, s, w] = np.ldexp(1.0, MOST_WEIGHTS - turn[e]) + gain[p, left, w] + gain[p + left, s - left, w] if self.bpe else self.score[piece[e]]
        best, last = np.zeros((longest + 1, n)), np.ones((longest + 1, n), np.int64)
        for p in range(1, longest + 1):
            best[p] = best[p - 1] + gain[p - 1, 1]
            for s in range(2, min(widest, p) + 1):
                way = best[p - s] + gain[p - s, s]
                better = (way >= best[p]) & (way > -np.inf)
                best[p][better], last[p][better] = way[better], s
        at, w, taken = lengths, np.arange(n), []
        while len(w):
            s = last[at, w]
            at = at - s
            code = first[w] + at
            taken.append((w, at, np.where(s > 1, ids[at, s, w], chars[code]), codes[code]))
            at, w = at[at > 0], w[at > 0]
        w, at, found, code = (np.concatenate(x) for x in zip(*taken, strict=True))
        by = np.lexsort((at, w))
        return self._spelt(found[by], code[by], w[by], n)

    def _long(self, word: str, start: list[int], size: list[int], piece: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """One word of any length: of bpe ways are their sorted merges, without those that all ways within reach share."""
        edges, (codes, chars) = defaultdict(list), self._chars([word])
        for p, s, i in zip(start, size, piece, strict=True):
            edges[p + s].append((s, i))
        near, taken = deque([[_END] if self.bpe else 0.0], maxlen=max(size, default=1)), []
        for p in range(1, len(word) + 1):
            if self.bpe and len(near[-1]) > LONG_COST:
                common = set(near[0]).intersection(*near)
                near = deque([[*(m for m in x if m not in common), _END] for x in near], maxlen=near.maxlen)
            best, by = near[-1] if self.bpe else near[-1] - (self.unknown if chars[p - 1] < 0 else self.score[chars[p - 1]]), (1, int(chars[p - 1]))
            for s, i in sorted(edges[p]):
                way = sorted([*near[-s], *(m + p - s for m in self.costs[i])]) if self.bpe else near[-s] - self.score[i]
                if way <= best:
                    best, by = way, (s, i)
            near.append(best)
            taken.append(by)
        out, p = [], len(word)
        while p:
            s, i = taken[p - 1]
            p -= s
            out.append((i, codes[p]))
        ids, code = np.array(out[::-1]).T
        return self._spelt(ids, code, np.zeros(len(ids), np.int64), 1)


def _word_crcs(model: str, digests: bool):
    """crc32s of words' ids, with commas between, and of the texts that they decode to; zeros if they aren't wanted."""
    text, name = piece_bytes(model), [str(i) for i in range(_model(model).get_piece_size())]

    def run(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        out, flat = np.zeros((2, len(sizes)), np.int64), ids.tolist()
        for k, (at, n) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True) if digests else ()):
            own = flat[at : at + n]
            out[0, k] = crc32(",".join([name[i] for i in own]).encode())
            out[1, k] = crc32(b"".join([text[i] for i in own]).decode("utf-8", "replace").encode())
        return list(out)

    return run


class _Pending:
    """Words whose edges come one after another. A word's first row brings it and has no edge; rows of the next word end it."""

    def __init__(self, fold: _Fold) -> None:
        self.fold, self.parts, self.rows, self.next = fold, [], 0, None

    def add(self, idx: pa.Array, edge: pa.Array, word: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        self.parts.append((idx.to_numpy(), edge.fill_null(0).to_numpy(), word.drop_null().to_pylist()))
        self.rows += len(idx)
        if self.rows >= TASK_EDGES:
            yield from self.rest(True)

    def rest(self, but_last: bool = False) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Words and, as of _Fold, their ids."""
        if not self.parts:
            return
        idx, edge, words = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]), [w for p in self.parts for w in p[2]]
        begins = np.flatnonzero(edge == 0)
        first = idx[0] if self.next is None else self.next
        if not np.array_equal(idx[begins], first + np.arange(len(words))) or (np.diff(idx) < 0).any():
            raise RuntimeError("edges came out of the order of their words")
        at = begins[-1] if but_last else len(idx)
        self.parts, self.rows, self.next = [(idx[at:], edge[at:], words[-1:])] if but_last else [], len(idx) - at, idx[-1] if but_last else None
        if words := words[: len(words) - but_last]:
            kept = np.flatnonzero(edge[:at])
            of, edge = (idx[kept] - first).astype(np.int64), edge[kept]
            yield words, *self.fold(words, of, edge >> 32, edge >> 24 & 255, (edge & 0xFFFFFF) - 1)


def _word_ids(fold: _Fold, crcs_of):
    """word, ids and crc32s by the edges of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = _Pending(fold)
        for batch in batches:
            yield from map(told, pending.add(*batch.columns))
        yield from map(told, pending.rest())

    def told(found: tuple) -> pa.RecordBatch:
        words, ids, first, sizes = found
        place, ends = _ragged(first, sizes, np.arange(len(words)))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[place], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), listed, *map(pa.array, crcs_of(ids, first, sizes))], names=["word", "ids", *_TOLD[1:3]])

    return run


def _put_together(fold: _Fold, crcs_of, frequent: pa.Table, pieces: list[bytes] | None = None):
    """Of each chunk its words' edges come first, in their order: each row with the ids of its words in theirs, and the digests of their crc32s.

    With pieces (bytes by id), ids are decoded: in their place come their number, if they give the row's source, and crc32s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent["ids"].combine_chunks()
        sizes = known.value_lengths().to_numpy().astype(np.int64)
        base = [known.flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes, *[frequent[c].to_numpy() for c in _TOLD[1:3]]]
        chunk, pending, parts, every = None, _Pending(fold), [], base
        for batch in batches:
            chunks, is_row = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_row[1:] != is_row[:-1])) + 1, len(chunks)] if len(chunks) else np.zeros(1, np.int64)
            for at, end in pairwise(cuts.tolist()):
                rows = batch.slice(at, end - at)
                if chunks[at] != chunk:
                    chunk, pending, parts, every = chunks[at], _Pending(fold), [], base
                if not is_row[at]:
                    parts += pending.add(*rows.columns[1:4])
                    continue
                parts += pending.rest()
                if parts:
                    every, parts = behind(base, parts), []
                yield from told(rows, *every)

    def behind(base: list[np.ndarray], parts: list) -> list[np.ndarray]:
        """The frequent words' ids, and behind them those of a chunk's others."""
        begin, out = len(base[0]), [[x] for x in base]
        for _, ids, first, sizes in parts:
            for x, more in zip(out, [ids, first + begin, sizes, *crcs_of(ids, first, sizes)], strict=True):
                x.append(more)
            begin += len(ids)
        return [np.concatenate(x) for x in out]

    def told(rows: pa.RecordBatch, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, *crcs: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = [np.frombuffer(w.as_buffer(), np.int32) for w in rows.column(4)]
        for k in range(0, len(words), 256):  # a row's ids and no more than some others' are held
            some = words[k : k + 256]
            used = np.concatenate(some)
            place, ends = _ragged(first, sizes, used)
            word_ends = np.r_[0, np.cumsum([len(w) for w in some])]
            ids, row_ends = pa.array(flat[place], pa.int32()), ends[word_ends]
            weight = np.arange(1, len(used) + 1) - np.repeat(word_ends[:-1], np.diff(word_ends))
            sums = [np.diff(np.r_[0, np.cumsum(weight * c[used] % PRIME)][word_ends]) for c in crcs]
            row, counted, sums = rows.column(5).slice(k, len(some)), pa.array([len(w) for w in some], pa.int64()), [pa.array(x, pa.int64()) for x in sums]
            if pieces is None:
                yield pa.RecordBatch.from_arrays([row, counted, pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), ids), *sums], names=["row", "n_words", "ids", "ids_digest", "text_digest"])
                continue
            back = decoded(ids, row_ends, row.field("source").to_pylist())
            yield pa.RecordBatch.from_arrays([row.field("id"), counted, pa.array(np.diff(row_ends)), *sums, *map(pa.array, back)], names=["id", "n_words", "n_ids", "ids_digest", "text_digest", *_WHOLE])

    def decoded(ids: pa.Array, row_ends: np.ndarray, sources: list[str | None]) -> Iterator[list]:
        """Of every row what its ids decode to, beside its source."""
        out = []
        for (at, end), source in zip(pairwise(row_ends.tolist()), sources, strict=True):
            own = ids.slice(at, end - at)
            text = _joined(texts.take(own)).decode("utf-8", "replace").replace(SPACE, " ")[1:]
            out.append((text == (source or "").replace(SPACE, " "), crc32(_joined(names.take(own))[:-1]), crc32(text.encode())))
        return map(list, zip(*out, strict=True))

    if pieces is not None:
        texts, names = pa.array(pieces, pa.binary()), pa.array([b"%d," % i for i in range(len(pieces))], pa.binary())
    return run


_WHOLE = ("decoded_same", "ids_crc32", "text_crc32")


def _joined(parts: pa.Array) -> bytes:
    """The bytes of an array that take() made, which lie one after another."""
    return parts.buffers()[2].to_pybytes()[: np.frombuffer(parts.buffers()[1], np.int32)[len(parts)]] if len(parts) else b""


_TOLD = ("n_ids", "ids_crc", "text_crc", "same")


def _crcs(model: str) -> list[Column]:
    """Of a word's ids the crc32 of them with commas between, that of the text that they decode to, and if that is the word."""
    back = marked_text(model, F.col("ids"))
    return [F.crc32(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")), F.crc32(back.cast("binary")), (back == F.col("word")).cast("long")]


def _frequent(texts: DataFrame, cutter: Cutter, pieces: DataFrame, fold: _Fold, crcs_of) -> pa.Table:
    """word, ids and crc32s of the words that are most frequent in some rows; which they are decides on work only, not on results."""
    share = min(1.0, SAMPLE_ROWS / max(texts.count(), 1))
    words = (texts.sample(share, 1) if share < 1 else texts).mapInArrow(_counts(cutter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = save(words.where(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word"), "words")
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = _edges(words.repartition(spread, "word").select(F.monotonically_increasing_id().alias("idx"), "word"), pieces)
    return edges.select("idx", "edge", "word").mapInArrow(_word_ids(fold, crcs_of), f"word string, ids array<int>, {_TOLD[1]} long, {_TOLD[2]} long").toArrow()


def _edges(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """words with edge (end << 32 | len << 24 | id + 1), as of lattice() but left in the order of words; a word's first row has no edge.

    Only that row brings the word. Rows without a word stay single.
    """
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    also = [c for c in words.columns if c != "word"]
    spans = words.select("*", F.explode(F.when(F.col("word").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("word")))).alias("end"))
    size = F.least(F.lit(longest), "end")
    spans = spans.select(*also, F.when(F.col("end") == 1, F.col("word")).alias("word"), "end", F.substring("word", F.col("end") - size + 1, size).alias("tail"))
    sizes = F.when(F.col("end") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.least(F.lit(2), F.length("tail")), F.length("tail")))
    spans = spans.select("*", F.explode(sizes).alias("len")).withColumn("piece", F.expr("right(tail, len)"))
    found = spans.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("len") < 2))
    edge = F.when(F.col("len") > 1, F.shiftleft(F.col("end").cast("long"), 32) + F.shiftleft(F.col("len").cast("long"), 24) + F.col("id") + 1)
    return found.select(*also, "word", edge.alias("edge"))


def encoded_rows(docs: DataFrame, model: str, row: Column, text: str = "text", kind: str = "bpe", digests: bool = False) -> DataFrame:
    """Of every row of docs: row (a struct of what is to be carried), n_words, ids, ids_digest and text_digest (0).

    With digests, whose row has id and source: id in place of row, n_ids and what the decoded ids give in place of ids.
    """
    cutter = Cutter([p for p, _, _ in _texts_of(_model(model))])
    carried = docs.select(row.alias("row"), F.col(text).alias("text"))
    kept = carried.schema["row"].dataType.simpleString()
    costs = piece_costs(model, kind)
    pieces = load_pieces(docs.sparkSession, model, costs)
    fold, crcs_of = _Fold(model, costs), _word_crcs(model, digests)
    frequent = _frequent(carried.select("text"), cutter, pieces, fold, crcs_of)
    chunks = carried.mapInArrow(_chunks(cutter, frequent["word"].to_pylist()), f"chunk long, row {kept}, words binary, idx int, word string")
    edges = _edges(chunks, pieces).select("chunk", "idx", "edge", "word", "words", "row")
    if not digests:
        return edges.mapInArrow(_put_together(fold, crcs_of, frequent), f"row {kept}, n_words long, ids array<int>, ids_digest long, text_digest long")
    key = carried.schema["row"].dataType["id"].dataType.simpleString()
    told = f"id {key}, n_words long, n_ids long, ids_digest long, text_digest long, decoded_same boolean, ids_crc32 long, text_crc32 long"
    return edges.mapInArrow(_put_together(fold, crcs_of, frequent, piece_bytes(model)), told)


def encode_texts(docs: DataFrame, model: str, text: str = "text", kind: str = "bpe") -> DataFrame:
    """docs with ids, an array; a column of that name is replaced."""
    docs = docs.drop("ids")
    return encoded_rows(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text, kind).select("row.*", "ids")


def piece_bytes(model: str) -> list[bytes]:
    """Per id the UTF-8 bytes that it decodes to; control ids have none."""
    m = _model(model)
    texts = {i: p.encode() for p, i, _ in _texts_of(m)} | {i: bytes([b]) for b, i in enumerate(byte_ids(model))}
    return [texts.get(i, b"") for i in range(m.get_piece_size())]


def marked_text(model: str, ids: Column) -> Column:
    """The marked text of ids; control ids have none, and bytes that aren't UTF-8 become the replacement mark."""
    table = F.split(F.lit(",".join(b.hex() for b in piece_bytes(model))), ",")  # a literal of the model's size
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")), "utf-8")


def decode_texts(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """coded with text, that of each row's ids; a column of that name is replaced."""
    text = F.substring(F.translate(marked_text(model, F.col(ids)), SPACE, " "), 2, 2_147_483_647)
    return coded.withColumn("text", F.coalesce(text, F.lit("")))


def _counts(cutter: Cutter):
    """Words and how often a task met them, by counts of tokens, each of which is cut once."""

    def flat(held: Counter[str]) -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for token, n in held.items():
            for w in cutter.cut(token):
                words[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(cutter.tokens(text.as_py()))
                if len(held) > TASK_TOKENS:
                    yield flat(held)
                    held.clear()
        yield flat(held)

    return run


class _Places(dict):
    """Places of words, -1 of those without one."""

    def __missing__(self, word: str) -> int:
        return -1


def _look_up(cutter: Cutter, frequent: pa.Table, key: pa.DataType):
    """Per row the sums over its frequent words, and its other words by their place."""
    schema = pa.schema([("rid", pa.int64()), ("id", key), *[(c, pa.int64()) for c in ("n_words", "n_ids", "ids_digest", "text_digest", "same")], ("pos", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40)
        place = _Places((w, i) for i, w in enumerate(frequent["word"].to_pylist())).__getitem__
        table = [np.r_[frequent[c].to_numpy().astype(np.int64), 0] for c in _TOLD]  # the last is for words that aren't frequent
        table[3][-1] = 1
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rids, sums, rare = [next(number) for _ in range(batch.num_rows)], [], []
                for rid, text in zip(rids, batch.column(1), strict=True):
                    words = cutter.words(text.as_py())
                    at, weight = np.fromiter(map(place, words), np.int64, len(words)), np.arange(1, len(words) + 1)
                    n, ids, back, same = (t[at] for t in table)
                    sums.append((len(words), n.sum(), (weight * ids % PRIME).sum(), (weight * back % PRIME).sum(), same.min(initial=1)))
                    rare += [(rid, k, words[k]) for k in np.flatnonzero(at < 0).tolist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)]
                none = lambda n, *names: [pa.nulls(n, schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), batch.column(0), *columns, *none(len(rids), "pos", "word")], schema=schema)
                r, k, w = zip(*rare, strict=True) if rare else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), *none(len(r), "id", "n_words", "n_ids", "ids_digest", "text_digest", "same"), pa.array(k, pa.int64()), pa.array(w, pa.string())], schema=schema)

    return run


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", kind: str = "bpe") -> DataFrame:
    """Per row of docs, all of whose ids are made and decoded: numbers of words and ids, digests by words, if the text is the row's, and crc32s.

    A digest is the sum over the words, numbered from 1, of number * crc32 mod PRIME, where the crc32 is that of the word's ids
    with commas between them, or of the text that they decode to. ids_crc32 is that of all ids with commas between them, text_crc32
    that of the text that they decode to. The source's own space marks count as blanks.
    """
    coded = encoded_rows(docs, model, F.struct(F.col(doc_id).alias("id"), F.col(text).alias("source")), text, kind, digests=True)
    return coded.withColumnRenamed("id", doc_id)


def word_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", kind: str = "bpe") -> DataFrame:
    """The digests by words of digests(), from each distinct word's alone: no row's ids are put together and no row is decoded.

    The frequent words, of bounded number and length, go to all tasks; only occurrences of others are shuffled, to meet theirs.
    """
    spark = docs.sparkSession
    cutter, costs = Cutter([p for p, _, _ in _texts_of(_model(model))]), piece_costs(model, kind)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    words = save(rows.select("text").mapInArrow(_counts(cutter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words.count() // TASK_WORDS)
    coded = encode_words(words, load_pieces(spark, model, costs), costs, byte_ids(model), tasks, "n")
    told = [F.size("ids").cast("long"), *_crcs(model)]
    coded = save(coded.select("word", "n", *[c.alias(k) for c, k in zip(told, _TOLD, strict=True)]), "coded")
    frequent = coded.where(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word", *_TOLD).toArrow()
    key = rows.schema["id"].dataType
    held = save(rows.mapInArrow(_look_up(cutter, frequent, to_arrow_type(key)), f"rid long, id {key.simpleString()}, n_words long, n_ids long, ids_digest long, text_digest long, same long, pos long, word string"), "looked_up")
    times = lambda crc: F.pmod((F.col("pos") + 1) * F.col(crc), F.lit(PRIME))
    rare = held.where("word is not null").select("rid", "pos", "word").join(coded.drop("n"), "word")
    rare = rare.select("rid", F.lit(None).cast(key).alias("id"), F.lit(0).cast("long").alias("n_words"), "n_ids", times("ids_crc").alias("ids_digest"), times("text_crc").alias("text_digest"), "same")
    every = held.where("word is null").drop("pos", "word").unionByName(rare)
    out = every.groupBy("rid").agg(F.first("id", True).alias(doc_id), *[F.sum(c).alias(c) for c in ("n_words", "n_ids", "ids_digest", "text_digest")], (F.min("same") == 1).alias("decoded_same"))
    return out.drop("rid")
