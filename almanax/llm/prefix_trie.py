"""The trie of all prefixes of conversations, by distributed MSD radix partitioning.

Method. Turns get numbers from a dictionary of distinct (role, text), so a conversation is a string of numbers. Equal strings are
one class with its members' number, smallest id and a digest of their ids. From the root on, a bucket is the set of classes under
one node. A round takes the buckets that are too large for a task: it finds the bucket's common prefix (that of its least and
greatest string), emits the nodes on it, and partitions the rest by the next number. Buckets of at most LOCAL turns leave the
rounds; tasks finish them by multikey quicksort, many buckets one after another, and emit a node each time that equals are gathered.
Leaves and sums of the buckets are added up over the rounds, the last first.

So no task holds more than LOCAL turns and one conversation, and a round costs a shuffle of the rows still in large buckets; a
prefix that all of a bucket share, of any length, costs one round. Figures at the driver: the number of large buckets of a round.

Defined results: a null role or text is empty. Rows with a null conversation belong to none. Rows of one turn, repeated ones too, are
turns each, ordered by role and then by the digest of role and text. Without conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.llm.hot import look_up
from almanax.llm.scratch import save

#: Turns of a bucket that a task finishes by itself.
LOCAL = 20_000
#: Up to so many large buckets go to all executors (some 40 bytes each); beyond, rows meet them by a shuffle.
MOST_BROADCAST = 100_000
#: Members of a class are joined to text in pieces of as many neighbouring ids at most.
_PIECE = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes) per conversation: its turns' numbers in order and the UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    turns = save(turns, "turns")
    numbers = save(turns.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    inner = look_up(turns, numbers, "key", "rows").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "id", "size"))).alias("t"))
    return inner.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuild(own: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, ids, sizes) with the first h turns of conversation c - c % family in place of c's own first h; h is crc32(c) % (most + 1).

    A conversation has at most 2 * family - 1 relatives, so no key is hot. own is read twice: save it.
    """
    c = F.col("conv_id")
    heads = own.select(c.alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    both = own.withColumn("base", c - c % family).withColumn("h", h).join(heads, "base", "left")

    def mixed(head: str, rest: str) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.concat(F.slice(F.coalesce(head, empty), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.size(rest)))

    return both.select("conv_id", mixed("head_ids", "ids").alias("ids"), mixed("head_sizes", "sizes").alias("sizes"))


_CLASS = "first long, n long, ids array<long>, upto array<long>, ends string"
_CLASS_ARROW = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("upto", pa.list_(pa.int64())), ("ends", pa.string())])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by class and id; a class's digest is carried from piece to piece, not its text."""
    key, one, digest, out = None, None, None, []
    for batch in batches:
        for name, convs, ids, sizes in zip(*[batch.column(c).to_pylist() for c in ("key", "convs", "ids", "sizes")], strict=True):
            if name != key:
                if one:
                    out.append((*one, digest.hexdigest()))
                key, one, digest = name, [convs[0], 0, ids, np.r_[0, np.cumsum(sizes)].astype(np.int64).tolist()], hashlib.sha256()
            else:
                digest.update(b",")
            one[1] += len(convs)
            digest.update(",".join(map(str, convs)).encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CLASS_ARROW, strict=True)], schema=_CLASS_ARROW)
            out = []
    if one:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*one, digest.hexdigest()), _CLASS_ARROW, strict=True)], schema=_CLASS_ARROW)


def classes(sequences: DataFrame) -> DataFrame:
    """(first, n, ids, upto, ends) of each distinct sequence: smallest member, members, bytes of the first d turns, digest of the members."""
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256))
    pieces = sequences.select(key.alias("key"), "conv_id", "ids", "sizes").groupBy("key", F.floor(F.col("conv_id") / _PIECE).alias("piece"))
    pieces = pieces.agg(F.sort_array(F.collect_list("conv_id")).alias("convs"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "convs", "ids", "sizes").mapInArrow(_classes, _CLASS)


_NODE = "round int, bucket long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE_ARROW = pa.schema([("round", pa.int32()), ("bucket", pa.int64()), ("top", pa.bool_()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


def sort_bucket(rows: list[tuple], above: int, parent_conv: int) -> list[list]:
    """[top, *node] of the trie of rows (ids, upto, n, first, ends), none of which is empty, by multikey quicksort.

    ids and upto begin behind the node above, of depth `above`. Of a range of rows those with the pivot's number at place d are
    gathered and are a node; smaller and greater ones are left for their turn at the same place.
    """
    nodes: list[list] = []
    up: list[int] = []
    todo = [(rows, 0, -1)]
    while todo:
        some, d, parent = todo.pop()
        pivot = some[len(some) // 2][0][d]
        less, more = [r for r in some if r[0][d] < pivot], [r for r in some if r[0][d] > pivot]
        same = [r for r in some if r[0][d] == pivot] if less or more else some
        todo += [(r, d, parent) for r in (less, more) if r]
        n = sum(r[2] for r in same)
        end = next((r[4] for r in same if len(r[0]) == d + 1), NO_ENDS)
        up.append(parent)
        one = same[0][1]
        nodes.append([parent < 0, min(r[3] for r in same), above + d + 1, nodes[parent][1] if parent >= 0 else parent_conv, n, 0, 0, (n - 1) * (one[d + 1] - one[d]), end])
        rest = [r for r in same if len(r[0]) > d + 1]
        if rest:
            todo.append((rest, d + 1, len(nodes) - 1))
    for k in range(len(nodes) - 1, -1, -1):  # children stand behind their parents
        nodes[k][6] = nodes[k][6] or 1
        if up[k] >= 0:
            over = nodes[up[k]]
            over[5] += 1
            over[6] += nodes[k][6]
            over[7] += nodes[k][7]
    return nodes


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket is bounded and finished when the next begins."""
    key, rows, above, parent = None, [], 0, 0
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

    def close() -> None:
        if rows:
            out.extend((key[0], key[1], *n) for n in sort_bucket(rows, above, parent))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("round", "bucket", "x", "e", "node_conv", "ids", "upto", "n", "first", "ends")]
        for r, bucket, x, e, node_conv, *row in zip(*columns, strict=True):
            if (r, bucket, x) != key:
                close()
                key, rows, above, parent = (r, bucket, x), [], e, node_conv
                if len(out) >= LOCAL:
                    yield table()
                    out = []
            rows.append(row)
    close()
    if out:
        yield table()


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two arrays."""
    differ = F.array_position(F.zip_with(lo, hi, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(lo)).cast("int")


def trie(classes: DataFrame, local: int = LOCAL) -> DataFrame:
    """Per node conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    rows = classes.select(F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("s"), F.lit(None).cast("long").alias("parent_conv"), "*")
    large, heads, leaving = 1, [], []
    while large:
        hint = F.broadcast if large <= MOST_BROADCAST else lambda df: df
        head = rows.groupBy("bucket").agg(
            *[F.first(c).alias(c) for c in ("parent", "s", "parent_conv")], F.min("first").alias("node_conv"), F.sum("n").alias("n"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.first("upto").alias("upto")
        )
        e = _common(F.col("lo"), F.col("hi"))
        head = save(head.select("bucket", "parent", "s", "parent_conv", "node_conv", "n", e.alias("e"), F.slice("upto", F.lit(1), e + 1).alias("upto")), "heads")
        inside = rows.drop("parent", "s", "parent_conv").join(hint(head.select("bucket", "e", "node_conv")), "bucket")
        inside = inside.withColumn("x", F.when(F.size("ids") > F.col("e"), F.get("ids", F.col("e"))))
        parts = inside.groupBy("bucket", "x").agg(F.sum(F.size("ids") - F.col("e")).alias("turns"), F.max(F.when(F.col("x").isNull(), F.col("ends"))).alias("ends"))
        parts = save(parts.withColumn("child", F.monotonically_increasing_id()), "parts")
        under = parts.groupBy("bucket").agg(F.count("x").alias("n_children"), F.max("ends").alias("ends"))
        heads.append(head.join(under, "bucket"))
        big = parts.where(F.col("x").isNotNull() & (F.col("turns") > local)).select("bucket", "x", "child")
        large = big.count()
        hint = F.broadcast if large <= MOST_BROADCAST else lambda df: df
        dealt = save(inside.where("x is not null").join(hint(big), ["bucket", "x"], "left"), "dealt")
        leaving.append(dealt.where("child is null").withColumn("round", F.lit(len(heads) - 1)))
        rows = dealt.where("child is not null").select(F.col("child").alias("bucket"), F.col("bucket").alias("parent"), (F.col("e") + 1).alias("s"), F.col("node_conv").alias("parent_conv"), "first", "n", "ids", "upto", "ends")

    small = leaving[0]
    for more in leaving[1:]:
        small = small.unionByName(more)
    rest = [F.slice(c, F.col("e") + 1, F.size(c)).alias(c) for c in ("ids", "upto")]
    small = small.select("round", "bucket", "x", "e", "node_conv", *rest, "n", "first", "ends").repartition("round", "bucket", "x").sortWithinPartitions("round", "bucket", "x")
    nodes = save(small.mapInArrow(_local, _NODE), "nodes")
    sums = save(nodes.where("top").groupBy("round", "bucket").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "sums")

    out = nodes.drop("round", "bucket", "top")
    below = None
    for r in range(len(heads) - 1, -1, -1):
        under = sums.where(F.col("round") == r).drop("round")
        if below is not None:
            under = under.unionByName(below).groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        at = heads[r].join(under, "bucket", "left").withColumn("leaves", F.coalesce("leaves", F.lit(1).cast("long"))).withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
        # the nodes on the common prefix, from depth s to e
        chain = at.withColumn("d", F.explode(F.sequence("s", "e")))
        saved = F.col("saved") + (F.col("n") - 1) * (F.get("upto", F.col("e")) - F.get("upto", F.greatest(F.col("d") - 1, F.lit(0))))
        last, first = F.col("d") == F.col("e"), F.col("d") == F.col("s")
        chain = chain.select(
            F.col("node_conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(first, F.col("parent_conv")).otherwise(F.col("node_conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
            F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"), F.col("parent"), first.alias("first"),
        )
        below = chain.where("first").select(F.col("parent").alias("bucket"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        out = out.unionByName(chain.drop("parent", "first"))
    return out


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of all rebuilt conversations (rebuild())."""
    own = save(encode_turns(conversations), "own")
    return trie(save(classes(rebuild(own)), "classes"), local)
