"""Best-fit packing of token sequences by hierarchical residual packing.

Method. Documents become ids (a byte-level BPE, then one end id) and, if longer than a sequence, pieces. Pieces are dealt to
partitions, each of which packs its own best fit first, longest pieces first. Bins that are full or nearly so are emitted. The
underfull ones become items themselves and go to fewer partitions, level by level, until one partition is left or a level
joins hardly any bins; then all are emitted. A partition's items are bounded at every level.

Only lengths and numbers of pieces move, never their texts or ids: a bin carries its members, which are at most as many as a
sequence has tokens.

Defined results: a null or empty text has just the end id. Repeated rows and equal ids are items each. A null doc_id is packed
like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.llm.scratch import save
from almanax.llm.token_ids import token_ids

SEQUENCE, END_ID = 4096, 1
#: A bin with at most so many free places is emitted at once.
NEARLY_FULL = 32
#: Items of one packing task at most; partitions that meet in one at the next level.
TASK_ITEMS, FAN_IN = 50_000, 16

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_MEMBER = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])
_BIN = "full boolean, length int, sequence_id long, members binary"
_BIN_ARROW = pa.schema([("full", pa.bool_()), ("length", pa.int32()), ("sequence_id", pa.int64()), ("members", pa.binary())])


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = token_ids(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (ids.of(text.as_py()) if text.is_valid else b"") + end
                n = len(raw) // 4
                rows += [(doc, k, at, min(sequence, n - at), zlib.crc32(raw[4 * at : 4 * (at + sequence)])) for k, at in enumerate(range(0, n, sequence))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, sequence: int) -> list[list[int]]:
    """Bins of items, by number: longest first, each to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(sequence + 1)]
    rooms = 0  # bit mask of the rooms that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = sequence, len(bins)
            bins.append([i])
        left = room - n
        by_room[left].append(k)
        rooms |= 1 << left
    return bins


def _packed(sequence: int, level: int, last: bool):
    """Bins of a partition's items; both are (length, members). last: emit all bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths, members = table.column(0).to_numpy(), table.column(1).to_pylist()
        order = sorted(range(len(members)), key=members.__getitem__)  # as repeated tasks must give the same bins
        lengths, members = lengths[order], [members[i] for i in order]
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        bins = best_fit(lengths, sequence)
        for at in range(0, len(bins), 2000):
            some = bins[at : at + 2000]
            size = [int(lengths[b].sum()) for b in some]
            columns = [[last or s >= sequence - NEARLY_FULL for s in size], size, range(first + at, first + at + len(some)), [b"".join([members[i] for i in b]) for b in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BIN_ARROW, strict=True)], schema=_BIN_ARROW)

    return run


def _as_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column(0)
        rows = np.zeros(batch.num_rows, _MEMBER)
        rows["doc_id"], rows["known"] = doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False)
        for k, name in enumerate(("piece", "start", "length", "crc"), 1):
            rows[name] = batch.column(k).to_numpy()
        raw = rows.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(rows["length"], pa.int32()), pa.array([raw[i : i + _MEMBER.itemsize] for i in range(0, len(raw), _MEMBER.itemsize)], pa.binary())], names=["length", "members"])


_PLACED = pa.schema([*_PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of the bins, laid out one after another."""
    for batch in batches:
        blobs = [b.as_buffer().to_pybytes() for b in batch.column(1)]
        if not blobs:
            continue
        rows = np.frombuffer(b"".join(blobs), _MEMBER)
        counts = [len(b) // _MEMBER.itemsize for b in blobs]
        before = np.cumsum(rows["length"]) - rows["length"]
        first = np.cumsum(counts) - counts
        doc = pa.array(rows["doc_id"], mask=rows["known"] == 0)
        columns = [doc, pa.array(rows["piece"].astype(np.int32)), *[pa.array(rows[c].copy()) for c in ("start", "length", "crc")], pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(before - np.repeat(before[first], counts))]
        yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    items = save(pieces.mapInArrow(_as_items, "length int, members binary"), "items")
    n, parts, level, done = items.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), 0, []
    parts = max(1, min(parts, n // 2000))
    while n:
        parts = max(parts, math.ceil(n / TASK_ITEMS))
        dealt = items.repartition(parts, F.xxhash64("members"))
        last = parts == 1
        bins = save(dealt.mapInArrow(_packed(sequence, level, last), _BIN), "bins")
        done.append(bins.where("full"))
        if last:
            break
        items = bins.where("not full").select("length", "members")
        before, n = n, items.count()
        if level and n > 0.99 * before:
            done.append(bins.where("not full"))
            break
        parts, level = math.ceil(parts / FAN_IN), level + 1
    if not done:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("sequence_id", "members").mapInArrow(_members, f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs."""
    return pack_pieces(save(token_pieces(docs, tokenizer, doc_id, text, sequence), "pieces"), sequence)
