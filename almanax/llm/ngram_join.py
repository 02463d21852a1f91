"""Exact n-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Method. A document is the set of its distinct 5-word shingles, one row of the matrix; equal rows are one class. Two classes
link when 100 * intersection >= 80 * union. Let n be a size and miss = n - ceil(0.8 n).

1. Columns are ordered by hash. A row's head is its first P(n) columns, about 0.3 n. Rows that link must share t(n) or more
   columns of their heads: with o = ceil(4/9 (n + s)) the least overlap of sizes n and s, the first of the shared columns lie in
   both heads as far as min(P(n) - n + o, P(s) - s + o) >= min(P(n) - n/5, n/8).
2. Heads are dealt by column blocks; columns that only one class has go, the others get their number of classes.
3. A class with fewer than t(n) columns left links with nothing. Of the others' columns, rarest first, all but the last t(n) - 1
   are kept: linked rows still share one of them.
4. All classes that have a kept column join the cell of the column's smallest class, its leader. So linked classes share a cell.
   In a cell of more than one block every row is first held against the leader. Rows that link with it are of one component
   already, so no two of them are compared again; the others are compared with each other and with them. Large groups of near
   copies thus cost as much as they have rows.
5. A cell's rows are cut into blocks of bounded size, and each pair of blocks that has to be compared is one product: overlaps
   are accumulated over all columns of the whole rows, and pairs below the bound dropped. A product emits a spanning forest of
   its links, never all pairs.

Defined results: a null, empty or blank text has no shingles and is a component of its own; a text of fewer than five words
has its sequence as its one shingle. Texts of one doc_id are linked with each other, as a doc_id is one node. A null doc_id links nothing
and has a null component. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.llm.components import components
from almanax.llm.scratch import save
from almanax.llm.shingles import WordHashes, fingerprint, shingle_sets

#: Bounds of a block of rows: rows, and shingles in them.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
#: Up to so many bytes of ids of documents go to all executors; beyond it the documents are joined by a shuffle.
MOST_BROADCAST = 32 << 20
_BLOCKS = 8  # column blocks for each shuffle partition


def head_size(n: int) -> int:
    return min(n, max(-(-3 * n // 10), n - -(-4 * n // 5) + 1))


def _head(n: Column) -> Column:
    return F.least(n, F.greatest(F.ceil(3 * n / 10), n - F.ceil(4 * n / 5) + 1))


def _least_shared(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil((5 * _head(n) - n) / 5), F.ceil(n / 8)))


_SKETCH = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("data", pa.binary())])


def _sketch(size: int, parts: int):
    """Rows of documents (n, fp) and, for each column block, the heads' entries as pairs of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, fps, heads = [], [], []
            for s in shingle_sets(batch.column(1), hashes, size):
                sizes.append(len(s))
                fps.append(fingerprint(s))
                heads.append(s[: head_size(len(s))].copy())
            if not sizes:
                continue
            fp = np.array(fps, np.int64)
            # rows only pass, so they are dealt in turn; equal texts of a batch give their head once
            turn = (np.arange(len(fp)) + int(fp[0] & 0xFFFF)) % parts
            first = np.sort(np.unique(fp, return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), batch.column(0), pa.array(sizes, pa.int32()), pa.array(fp), pa.nulls(len(fp), pa.binary())], schema=_SKETCH)
            heads = [heads[k] for k in first]
            column = np.concatenate(heads)
            owner = np.repeat(fp[first], [len(h) for h in heads])
            block = (column >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(block, kind="stable")
            both = np.stack([column[order].view(np.int64), owner[order]], axis=1)
            ends = np.searchsorted(block[order], np.arange(parts), side="right")
            blobs = [both[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            used = [k for k, x in enumerate(blobs) if x]
            empty = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), empty, pa.nulls(len(used), pa.int32()), empty, pa.array([blobs[k] for k in used], pa.binary())], schema=_SKETCH)

    return run


_KEPT = "doc_id long, n int, fp long, shared array<struct<df:int,h:long>>"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("shared", pa.list_(pa.struct([("df", pa.int32()), ("h", pa.int64())])))])


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents pass; of the entries of whole column blocks, those of columns that two or more classes have, by class."""
    blobs = []
    for batch in batches:
        docs = batch.filter(batch.column(4).is_null())
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([docs.column(1), docs.column(2), docs.column(3), pa.nulls(docs.num_rows, _KEPT_ARROW.field(3).type)], schema=_KEPT_ARROW)
        blobs += [x.as_buffer().to_pybytes() for x in batch.column(4) if x.is_valid]
    both = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    del blobs
    h, fp = both[:, 0], both[:, 1]
    order = np.lexsort((fp, h))
    h, fp = h[order], fp[order]
    if not len(h):
        return
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))
    h, fp = h[new], fp[new]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    df = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
    h, fp, df = h[df > 1], fp[df > 1], df[df > 1]
    order = np.argsort(fp, kind="stable")
    h, fp, df = h[order], fp[order], df[order]
    first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
    for at in range(0, len(first), 20_000):
        starts = first[at : at + 20_000]
        end = first[at + 20_000] if at + 20_000 < len(first) else len(fp)
        entries = pa.StructArray.from_arrays([pa.array(df[starts[0] : end], pa.int32()), pa.array(h[starts[0] : end])], names=["df", "h"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, end] - starts[0], pa.int32()), entries)
        none = pa.nulls(len(starts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(starts), pa.int32()), pa.array(fp[starts]), lists], schema=_KEPT_ARROW)


def _whole_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the classes' own documents; other texts of the same doc_id go."""
        hashes = WordHashes()
        for batch in batches:
            keep = [(k, s) for k, s in enumerate(shingle_sets(batch.column(1), hashes, size)) if fingerprint(s) == batch.column(2)[k].as_py()]
            ids = batch.column(0).take(pa.array([k for k, _ in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for _, s in keep], pa.binary())], names=["rep", "shingles"])

    return run


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, above the diagonal: the product of the incidence matrix with its transpose.

    Columns of up to 16 rows add their pairs one by one; columns of more rows are multiplied as dense chunks.
    """
    m = len(rows)
    value, owner = np.concatenate(rows), np.repeat(np.arange(m), [len(x) for x in rows])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    count = np.diff(np.r_[first, len(value)])
    total = np.zeros(m * m, np.int64)
    for c in np.unique(count[(count > 1) & (count <= 16)]).tolist():
        who = owner[first[count == c][:, None] + np.arange(c)]
        for p in range(c - 1):
            for q in range(p + 1, c):
                total += np.bincount(who[:, p] * m + who[:, q], minlength=m * m)
    total = total.reshape(m, m)
    wide = np.flatnonzero(count > 16)
    for at in range(0, len(wide), 4096):
        some = wide[at : at + 4096]
        dense = np.zeros((m, len(some)), np.float32)
        entry = np.repeat(first[some] - np.r_[0, np.cumsum(count[some])[:-1]], count[some]) + np.arange(count[some].sum())
        dense[owner[entry], np.repeat(np.arange(len(some)), count[some])] = 1
        total += np.triu(dense @ dense.T, 1).astype(np.int64)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric boolean matrix that keep its components, one fewer than the nodes of each."""
    out, todo = [], linked.any(axis=0)
    while todo.any():
        front = np.array([np.flatnonzero(todo)[0]])
        todo[front] = False
        while len(front):
            near = linked[front]
            new = np.flatnonzero(near.any(axis=0) & todo)
            out += zip(front[near[:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            todo[new] = False
            front = new
    return out


def _against_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a cell's rows link with its leader."""
    for batch in batches:
        linked = []
        for mine, lead in zip(batch.column(3), batch.column(4), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, lead))
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= 80 * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_())], names=["leader", "rep", "n", "linked"])


def _links_of(block: np.ndarray, ids: np.ndarray, rows: list[np.ndarray]) -> list[tuple[int, int]]:
    n = np.array([len(x) for x in rows])
    upper = overlaps(rows)
    both = upper + upper.T
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    return [(int(ids[a]), int(ids[b])) for a, b in forest(linked)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by product (leader, i, j); a product's rows are bounded, so it is held whole."""
    key, block, ids, rows = None, [], [], []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(rows) > 1:
            out.extend(_links_of(np.array(block), np.array(ids), rows))

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
        for k, name in enumerate(names):
            if name != key:
                close()
                key, block, ids, rows = name, [], [], []
            block.append(batch.column(3)[k].as_py())
            ids.append(batch.column(4)[k].as_py())
            rows.append(np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64))
        if len(out) > 50_000:
            yield table()
            out.clear()
    close()
    yield table()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = texts.mapInArrow(_sketch(size, partitions * _BLOCKS), "part int, doc_id long, n int, fp long, data binary")
    kept = save(sketch.repartition(partitions, "part").mapInArrow(_shared_columns, _KEPT), "shared")
    rows = kept.where("n is not null").select("doc_id", "n", "fp")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))

    n, m = F.col("n"), F.size("e")
    shared = kept.where("n is null").groupBy("fp").agg(F.flatten(F.collect_list("shared")).alias("e"))
    index = shared.join(classes, "fp").withColumn("t", _least_shared(n).cast("int")).where(m >= F.col("t"))
    index = save(index.select("rep", "fp", "n", F.explode(F.slice(F.sort_array("e"), F.lit(1), m - F.col("t") + 1)).alias("x")).select("rep", "fp", "n", F.col("x.h").alias("h")), "index")

    leaders = index.groupBy("h").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "leader")
    cells = save(index.join(leaders, "h").select("leader", "rep", "fp", "n").distinct(), "cells")
    shape = cells.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1")
    shape = shape.select("leader", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("g"))
    cells = save(cells.join(shape, "leader"), "cells")

    wanted = cells.select(F.col("rep").alias("doc_id"), "fp").distinct()
    if cells.count() * 16 <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    sets = save(texts.join(wanted, "doc_id").select("doc_id", "text", "fp").mapInArrow(_whole_rows(size), "rep long, shingles binary"), "sets")

    # rows of cells that are cut: against their leader first
    large = cells.where("g > 1").select("leader", "rep", "n")
    lead = sets.join(large.select(F.col("leader").alias("rep")).distinct(), "rep", "left_semi").dropDuplicates(["rep"]).select(F.col("rep").alias("leader"), F.col("shingles").alias("lead"))
    checked = large.join(sets, "rep").join(lead, "leader").select("leader", "rep", "n", "shingles", "lead")
    checked = save(checked.mapInArrow(_against_leader, "leader long, rep long, n int, linked boolean"), "checked")
    blocks = lambda some: F.greatest(F.ceil(F.count_if(some) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    cut = checked.groupBy("leader").agg(blocks(~F.col("linked")).alias("others"), blocks(F.col("linked")).alias("near")).where("others > 0")
    spread = lambda number: F.pmod(F.xxhash64("rep"), F.col(number)).cast("int")
    numbered = checked.join(cut, "leader").select("leader", "rep", "others", "near", F.when(F.col("linked"), F.col("others") + spread("near")).otherwise(spread("others")).alias("block"))
    one, none = F.lit(1), F.lit(0)
    numbered = numbered.unionByName(cells.where("g = 1").select("leader", "rep", one.alias("others"), none.alias("near"), none.alias("block")))

    dealt = numbered.join(sets, "rep")
    # blocks of others meet all blocks, blocks of near rows only those of others
    last = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("near")).otherwise(F.col("others")) - 1
    dealt = dealt.select("leader", "rep", "block", "shingles", F.explode(F.sequence(none, last)).alias("other"))
    dealt = dealt.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "shingles")
    dealt = dealt.repartition(partitions, "leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    links = dealt.mapInArrow(_products, "a long, b long").unionByName(checked.where("linked").select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    # the texts of one doc_id are one node
    ids = rows.where("n > 0 and doc_id is not null").select("doc_id", "fp")
    several = ids.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    links = links.unionByName(ids.join(several, "doc_id", "left_semi").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links)

    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    # equal texts under different ids share a class; its component is a null id's neither
    out = rows.join(of_class, "fp", "left")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The rows of docs without those that link, directly or not, to a smaller doc_id; repeated rows of one id all stay."""
    found = jaccard_components(docs, doc_id, text, **kwargs).where(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct()
    return docs.join(found, doc_id, "left_anti")
