"""Removal of long repeats: words that a window covers which also starts in a document with a smaller id.

Method (recompression, see recompression.py). Words are hashed, and rounds over them name runs and pairs. Spark's global rounds then
settle, from the longest symbols to the windows themselves, which document is the first with a symbol:

1. Documents with equal words are one content, known by the smallest id; other copies lose all words.
2. Every content gives the distinct keys of its windows, half a window of words from where a high-level symbol begins. A key that one
   document has alone tells that its windows repeat nothing; these go, and with them most of all text.
3. Of the contents that are left, long symbols whose windows are all still open claim the range of words around them. Where a range of
   the same words is a smaller document's, all windows that start in the symbol repeat. So near copies cost a row for each long
   symbol, not for each word.
4. The windows that are still open claim themselves, once per document. Those of a smaller document repeat.

The first document of any window is never settled before the last step, so nothing is lost: results are those of comparing all windows.
A claim is counted by its 128-bit hash alone, pre-aggregated, but meets its rows by hash and document together, so that a passage in
very many documents is dealt by its documents. Keys that very many share are looked up by a broadcast of fewer than 1,000 rows.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null text has none. A null doc_id neither takes nor loses words. Rows of one doc_id
don't take words from each other. Fewer words than a window lose none. Repeated rows are all returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.llm.hot import look_up
from almanax.llm.lines import WORD, words
from almanax.llm.recompression import Parsed, mix, pieces
from almanax.llm.scratch import save

WINDOW = 50
_WORD = re.compile(WORD)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(words(text), " ").cast("binary"), 256))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, as unsigned numbers, and the rows' bounds in them; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    return np.asarray(column.flatten()).astype(np.int64).view(np.uint64), np.r_[0, np.cumsum(lengths)]


def _list_column(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, np.int64), *rows])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(values, kind))


def _parsed(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, Parsed]]:
    """Of the column `hashes`, lists of pieces (row, start, stop), where each piece begins, and their parse."""
    values, bounds = _lists(batch.column("hashes"))
    for some in pieces(np.diff(bounds), window):
        some = [(d, a, b) for d, a, b in some if b - a >= window]
        if some:
            starts = np.cumsum([0, *[b - a for _, a, b in some[:-1]]])
            yield some, starts, Parsed(np.concatenate([values[bounds[d] + a : bounds[d] + b] for d, a, b in some]), starts, window)


def _owner(some: list[tuple[int, int, int]], starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of positions in a list of pieces, and the positions in their documents."""
    which = np.searchsorted(starts, at, side="right") - 1
    row, begin = np.array([d for d, _, _ in some]), np.array([a for _, a, _ in some])
    return row[which], at - starts[which] + begin[which]


def _heads(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of words and the distinct keys of each document's windows."""
        for batch in batches:
            keys: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for some, starts, parsed in _parsed(batch, window):
                row, _ = _owner(some, starts, parsed.at)
                new = np.concatenate(([True], parsed.low[1:] != parsed.low[:-1]))
                row, found = row[new], parsed.keys(parsed.low[new])
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for d in {d for d, _, _ in some}:
                    keys[d].append(found[bounds[d] : bounds[d + 1]])
            rows = [np.unique(np.concatenate(k)).view(np.int64) if k else np.zeros(0, np.int64) for k in keys]
            n = batch.column("hashes").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), n, _list_column(rows, pa.int64())], names=["doc_id", "digest", "n_words", "keys"])

    return run


def _among(row: np.ndarray, found: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each number is in the list of its row."""
    values, bounds = _lists(lists)
    wanted = values ^ mix(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64))
    return np.isin(found ^ mix(row.astype(np.uint64)), wanted)


def _claims(window: int, long: bool):
    """Claims of ranges by long symbols or by the open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.asarray(batch.column("doc_id"))
            r = np.asarray(batch.column("r"))
            settled = None if long else _Settled(batch)
            for some, starts, parsed in _parsed(batch, window):
                row, place = _owner(some, starts, parsed.at)
                is_open = _among(row, parsed.keys(), batch.column("keys"))
                if long:
                    wanted = np.zeros(parsed.n, bool)
                    wanted[parsed.at[is_open]] = True
                    start, stop, end = parsed.covers(wanted)
                    (row, place), length = _owner(some, starts, start), stop - start
                    a, b = (parsed.sums.of(start, end, k) for k in (0, 1))
                else:
                    is_open &= ~settled.holds(row, place)
                    row, place, at = row[is_open], place[is_open], parsed.at[is_open]
                    a, b = (parsed.windows(at, k) for k in (0, 1))
                    length = np.ones(len(at), np.int64)
                # of equal claims of a document, one
                once = np.unique(a ^ mix(row.astype(np.uint64)), return_index=True)[1]
                columns = [a[once].view(np.int64), b[once].view(np.int64), doc[row[once]], r[row[once]], place[once], (place + length)[once]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "doc_id", "r", "start", "stop"])

    return run


class _Settled:
    """The ranges of starts, per row of a batch, that are known to repeat."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("settled")
        lengths = np.array(column.value_lengths().fill_null(0), np.int64)
        pairs = column.flatten()
        row = np.repeat(np.arange(batch.num_rows), lengths)
        start, stop = np.asarray(pairs.field("start")), np.asarray(pairs.field("stop"))
        order = np.lexsort((start, row))
        self.row, self.start, self.stop = row[order], start[order], stop[order]

    def holds(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranges of a row don't overlap: they are symbols of one parse, but pieces of a long document may overlap by some."""
        if not len(self.row):
            return np.zeros(len(row), bool)
        span = np.int64(1 << 40)
        at = np.searchsorted(self.row * span + self.start, row * span + place, side="right") - 1
        return (at >= 0) & (self.row[at] == row) & (place < self.stop[at])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of words that repeated windows cover, and the words that are left."""
        for batch in batches:
            lengths = batch.column("hashes").value_lengths().to_pylist()
            change = [np.zeros(n + 1, np.int64) for n in lengths]
            settled = _Settled(batch)
            for some, starts, parsed in _parsed(batch, window):
                row, place = _owner(some, starts, parsed.at)
                gone = settled.holds(row, place) | _among(row, parsed.windows(parsed.at), batch.column("gone"))
                row, place = row[gone], place[gone]
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for d in {d for d, _, _ in some}:
                    mine = place[bounds[d] : bounds[d + 1]]
                    change[d][mine] += 1
                    change[d][mine + window] -= 1
            spans, kept = [], []
            for text, c in zip(batch.column("text"), change, strict=True):
                covered = np.cumsum(c[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                spans.append([{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()])
                found = _WORD.findall(text.as_py()) if len(edge) else []
                kept.append(" ".join([w for w, x in zip(found, covered.tolist(), strict=True) if not x]) if len(edge) else None)
            yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(spans, _SPANS), pa.array(kept, pa.string())], names=["r", "spans", "kept_text"])

    return run


def _later(claims: DataFrame) -> DataFrame:
    """The claims that a smaller document makes as well; claims is a saved table."""
    first = claims.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    return claims.join(first, ["a", "b", "doc_id"], "left_anti")


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, n_words, spans, kept_text, kept_digest) of every row of docs.

    digest is the SHA-256 of the words joined by single spaces, kept_digest that of those which are left; spans are the removed
    words' places [start, stop); kept_text is null where nothing is removed.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    head = texts.select("doc_id", _digest(F.col("text")).alias("digest"), _hashes(F.col("text")).alias("hashes"))
    head = save(head.mapInArrow(_heads(window), "doc_id long, digest binary, n_words long, keys array<long>"), "heads")
    able = head.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    contents = able.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    contents = able.join(contents, ["digest", "doc_id"]).dropDuplicates(["digest"])
    contents = save(contents.withColumn("r", F.monotonically_increasing_id()), "contents")

    # keys that two documents have at least, and the contents that have one
    key = contents.select("r", "doc_id", F.explode("keys").alias("key"))
    shared = key.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("rows"))
    shared = save(shared.where("least < most").select("key", "rows"), "shared")
    open_keys = look_up(key, shared, "key", "rows").groupBy("r").agg(F.collect_list("key").alias("keys"))
    open_keys = open_keys.join(contents.select("r", "doc_id", F.col("digest").alias("content")), "r")
    some = texts.join(open_keys, "doc_id").where(_digest(F.col("text")).eqNullSafe(F.col("content"))).dropDuplicates(["r"])
    some = save(some.select("r", "doc_id", "text", "keys"), "open")

    ranges = "a long, b long, doc_id long, r long, start long, stop long"
    hashed = some.withColumn("hashes", _hashes(F.col("text")))
    long = save(hashed.select("r", "doc_id", "hashes", "keys").mapInArrow(_claims(window, True), ranges), "claims")
    settled = _later(long).groupBy("r").agg(F.collect_list(F.struct("start", "stop")).alias("settled"))
    hashed = save(some.join(settled, "r", "left"), "settled").withColumn("hashes", _hashes(F.col("text")))
    single = save(hashed.select("r", "doc_id", "hashes", "keys", "settled").mapInArrow(_claims(window, False), ranges).select("a", "b", "doc_id", "r"), "claims")
    gone = _later(single).groupBy("r").agg(F.collect_list("a").alias("gone"))
    removed = hashed.select("r", "text", "hashes", "settled").join(gone, "r", "left").where("gone is not null or settled is not null")
    spans = "array<struct<start:bigint,stop:bigint>>"
    removed = removed.mapInArrow(_removed(window), f"r long, spans {spans}, kept_text string").withColumn("kept_digest", F.unhex(F.sha2(F.col("kept_text").cast("binary"), 256)))

    done = contents.select("r", "digest", "doc_id").join(removed, "r", "left").drop("r").withColumn("is_first", F.lit(True))
    all_gone = F.col("is_first").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    out = head.select("doc_id", "digest", "n_words").join(done, ["digest", "doc_id"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return out.select(
        F.col("doc_id").alias(doc_id), "digest", "n_words",
        F.when(all_gone, whole).otherwise(F.coalesce("spans", F.array().cast(spans))).alias("spans"),
        F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(all_gone, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("kept_digest", "digest")).alias("kept_digest"),
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the repeated words; a text that loses none is as it was, another is its other words joined by single spaces."""
    found = repeated_words(docs, doc_id, text, window).where("kept_text is not null").select(F.col(doc_id).alias("_id"), F.col("digest").alias("_digest"), F.col("kept_text").alias("_kept")).distinct()
    both = docs.withColumn("_own", _digest(F.col(text)))
    both = both.join(found, (F.col(doc_id) == F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    return both.select(*[F.coalesce("_kept", c).alias(c) if c == text else F.col(c) for c in docs.columns])
