"""Near-duplicate embeddings by product quantisation over inverted lists, with exact rerank.

Method. Equal vectors are one class. Two levels of coarse centroids (the second for the residuals of the first) and one
codebook per subspace of what is left are fitted to a bounded sample of classes; the number of lists grows with the classes up to
(MOST_CENTRES + 1) * MOST_CENTRES, 65,792, or fewer of long vectors (MOST_VALUES). Beyond some 8 million classes lists get longer
instead, and the work of a class with them: raise both then, as memory allows.
Every class is put into its nearest list and coded. It then asks the lists that it probes: distances come from lookup tables
(asymmetric: exact query, coded list), and what may still reach the least cosine is reranked by the exact cosine in double
precision. As x.y is at most the lookup's value plus the norm of y's quantisation error, the lookups lose no pair.

Probes. A list's inner part, its ball, has the members within half the least cosine's angle of its centre: all of them link
each other, so they are counted and linked without a comparison. By the triangle inequality a class outside a ball links with
all of it, with none of it, or has to ask it; balls lose no pair, however many rows crowd in them. The outer parts are asked by
the classes that are in no ball, each asking its nearest `probes` outer parts; a pair is found if either asks the other's. The
tests measure the recall of these probes against brute force. With probes None a class asks all outer parts that the triangle
inequality leaves, by their greatest angle to their centre, and the result is exact, at more work.

A list's part is cut into blocks of bounded size, and a block that too many ask is dealt to several tasks. A task holds one
block and streams those who ask. It gives each class the number of its links and links to the smallest class that the found
pairs reach, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, have no
links and are their own component. Vectors of different lengths are never compared. Repeated rows are vectors each. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.llm.components import components
from almanax.llm.scratch import save

LEAST_COSINE = 0.95
#: Rows that centroids and codebooks are fitted to, at most; every vector is indexed.
SAMPLE, SUBSPACES, CODES = 16_384, 8, 256
#: Classes of a list on average, centroids of a level at most, and outer parts that a class asks.
LIST_ROWS, MOST_CENTRES, PROBES = 128, 256, 24
#: Values of all lists' centres at most, and distances to centres that are held at once.
MOST_VALUES, HELD_SCORES = 1 << 23, 1 << 22
#: Members of a block, and those who ask one copy of it.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 65_536
_SLACK = 1e-4  # of single-precision lookups
_TURN = 1e-6  # radians by which a bound on angles must hold


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[filled])[:-1]], axis=0)
        centres[filled] = sums / count[filled, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """points: centres of the lists, a row for each pair of a centroid and a residual's; books: per subspace its columns and codewords.

    A list's outer part has the number 2 * list, its ball 2 * list + 1.
    """

    points: np.ndarray
    books: list[tuple[np.ndarray, np.ndarray]]
    angle: float
    directions: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        norm = np.sqrt((self.points**2).sum(1))
        object.__setattr__(self, "directions", self.points / np.where(norm > 0, norm, 1.0)[:, None])

    @classmethod
    def fit(cls, unit: np.ndarray, lists: float, least: float, seed: int = 7) -> Quantiser:
        k = int(max(1, min(MOST_CENTRES, np.ceil(lists**0.5), (MOST_VALUES / unit.shape[1]) ** 0.5)))
        coarse = _k_means(unit, k, 8, seed)
        rest = unit - coarse[(unit @ coarse.T - 0.5 * (coarse**2).sum(1)).argmax(1)]
        fine = np.concatenate([np.zeros((1, unit.shape[1])), _k_means(rest, k, 8, seed + 1)])  # so that a centroid is a centre itself
        model = cls((coarse[:, None] + fine[None]).reshape(-1, unit.shape[1]), [], float(np.arccos(min(1.0, max(-1.0, least)))))
        rest = unit - model.points[model.scores(unit).argmax(1)]
        columns = np.array_split(np.arange(unit.shape[1]), min(SUBSPACES, unit.shape[1]))
        return cls(model.points, [(p, _k_means(rest[:, p], CODES, 6, seed + 2 + i)) for i, p in enumerate(columns)], model.angle)

    def scores(self, unit: np.ndarray) -> np.ndarray:
        """Greatest where a point is nearest."""
        return unit @ self.points.T - 0.5 * (self.points**2).sum(1)

    def part(self, unit: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part that each row is in, and its angle to the part's centre."""
        own = scores.argmax(1)
        turn = np.arccos(np.clip((unit * self.directions[own]).sum(1), -1, 1))
        return 2 * own + (turn <= self.angle / 2 - _TURN), turn

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norms of the errors."""
        rest = unit - self.points[own]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for m, (columns, words) in enumerate(self.books):
            codes[:, m] = (rest[:, columns] @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
            rest[:, columns] -= words[codes[:, m]]
        return codes, np.sqrt((rest**2).sum(1))

    def tables(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per subspace, the products of each row with all codewords."""
        return [(unit[:, columns] @ words.T).astype(np.float32) for columns, words in self.books]


@dataclass(frozen=True)
class Parts:
    """Of the parts that have members, by number: classes, vectors, the greatest angle to the centre and the smallest class."""

    part: np.ndarray
    classes: np.ndarray
    vectors: np.ndarray
    radius: np.ndarray
    least: np.ndarray

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Each part's first block and number of blocks: large parts are cut, neighbouring small ones share a block."""
        first, number, block, filled = np.zeros(len(self.part), np.int64), np.ones(len(self.part), np.int64), 0, 0
        for k, n in enumerate(self.classes.tolist()):
            if filled and filled + n > BLOCK_ROWS:
                block, filled = block + 1, 0
            first[k] = block
            if n > BLOCK_ROWS:
                number[k] = -(-n // BLOCK_ROWS)
                block += number[k]
            else:
                filled += n
        return first, number


class Asking:
    """Which parts each class asks, and which balls it links with as a whole."""

    def __init__(self, model: Quantiser, parts: Parts, probes: int | None = PROBES) -> None:
        self.model, self.parts, self.probes = model, parts, probes
        self.place = np.full(2 * len(model.points), -1)
        self.place[parts.part] = np.arange(len(parts.part))
        self.outer, self.balls = np.flatnonzero(parts.part % 2 == 0), np.flatnonzero(parts.part % 2)

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the own parts, a mask of the parts that are asked, and of the balls that link as a whole."""
        parts, scores = self.parts, self.model.scores(unit)
        own = self.place[self.model.part(unit, scores)[0]]
        asked, whole = (np.zeros((len(unit), len(parts.part)), bool) for _ in range(2))
        if len(self.balls):
            turn = np.arccos(np.clip(unit @ self.model.directions[parts.part[self.balls] // 2].T, -1, 1))
            reach = parts.radius[self.balls]
            whole[:, self.balls] = turn + reach <= self.model.angle - _TURN
            asked[:, self.balls] = (turn - reach <= self.model.angle + _TURN) & ~whole[:, self.balls]
        inside = parts.part[own] % 2 == 1
        before = np.arange(len(parts.part)) <= own[:, None]  # of two balls, the members of the first ask the second
        asked[inside] &= ~before[inside]
        whole[inside] &= ~before[inside]
        if len(self.outer) and self.probes is None:
            rows = np.flatnonzero(~inside)
            turn = np.arccos(np.clip(unit[rows] @ self.model.directions[parts.part[self.outer] // 2].T, -1, 1))
            asked[rows[:, None], self.outer[None]] = turn - parts.radius[self.outer] <= self.model.angle + _TURN
        elif len(self.outer):
            near = scores[:, parts.part[self.outer] // 2]
            k = min(self.probes, len(self.outer))
            best = self.outer[np.argpartition(-near, k - 1, axis=1)[:, :k]]
            rows = np.flatnonzero(~inside)
            asked[rows[:, None], best[rows]] = True
            asked[rows, own[rows]] = True
        return own, asked, whole


def _doubles(vectors: pa.Array) -> pa.Array:
    """Each vector as the bytes of its doubles; null for those that link with nothing."""
    out = []
    for v in vectors:
        x = np.array([np.nan if e is None else e for e in v.as_py()], np.float64) if v.is_valid and len(v) else np.empty(0)
        with np.errstate(all="ignore"):
            norm = np.sqrt(x @ x)
        out.append(x.tobytes() if len(x) and np.isfinite(norm) and norm > 0 else None)
    return pa.array(out, pa.binary())


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _doubles(batch.column(1))], names=["vec_id", "v"])


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and the same as unit vectors."""
    x = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in column), np.float64).reshape(len(column), -1)
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def _slices(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    rows = max(16, min(1024, HELD_SCORES // lists))
    for whole in batches:
        yield from (whole.slice(k, rows) for k in range(0, whole.num_rows, rows))


def _members(model: Quantiser):
    """Per batch and part: classes, vectors, the greatest angle and the smallest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(model.points)):
            reps, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            unit = _matrix(batch.column(2))[1]
            part, turn = model.part(unit, model.scores(unit))
            order = np.argsort(part, kind="stable")
            part, turn, reps, n = part[order], turn[order], reps[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            columns = [part[first], np.diff(np.r_[first, len(part)]), np.add.reduceat(n, first), np.maximum.reduceat(turn, first), np.minimum.reduceat(reps, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "classes", "vectors", "radius", "least"])

    return run


def _askers(asking: Asking, first: np.ndarray, number: np.ndarray):
    """Number of classes that ask each block."""
    n_blocks = int((first + number).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_blocks + 1, np.int64)
        for batch in _slices(batches, len(asking.model.points)):
            row, block = _asked_blocks(asking.of(_matrix(batch.column(0))[1])[1], first, number)
            total += np.bincount(block, minlength=n_blocks + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["block", "n"])

    return run


def _asked_blocks(asked: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, block) of the parts that rows ask."""
    row, part = np.nonzero(asked)
    row = np.repeat(row, number[part])
    step = np.arange(len(row)) - np.repeat(np.cumsum(number[part]) - number[part], number[part])
    block = np.repeat(first[part], number[part]) + step
    both = np.unique(row.astype(np.int64) << 32 | block)
    return both >> 32, both & 0xFFFFFFFF


_CELL = "block int, copy int, asks boolean, a long, b long, n long, own int, err double, codes binary, asked binary, v binary"
_CELL_ARROW = pa.schema(
    [("block", pa.int32()), ("copy", pa.int32()), ("asks", pa.bool_()), *[(c, pa.int64()) for c in "abn"], ("own", pa.int32()), ("err", pa.float64()), ("codes", pa.binary()), ("asked", pa.binary()), ("v", pa.binary())]
)


def _told(a, b, n, own, block: int = -1) -> pa.RecordBatch:
    """Rows that need no comparison: a link (a, b), a's number of links n, a's ball own, or n more links of all of a ball."""
    m = len(a)
    columns = {"block": pa.array(np.full(m, block, np.int32)), "copy": pa.array(np.arange(m, dtype=np.int32) % 1024), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "own": pa.array(own, pa.int32())}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(m, f.type)) for f in _CELL_ARROW], schema=_CELL_ARROW)


def _deal(asking: Asking, first: np.ndarray, number: np.ndarray, copies: np.ndarray):
    """Each class as a member of its block, in all its copies, and as one that asks blocks; and what balls tell at once."""
    model, parts = asking.model, asking.parts

    def rows(block, copy, asks, take, batch, own, err, codes, asked) -> pa.RecordBatch:
        at = pa.array(take)
        none = pa.nulls(len(take), pa.int64())
        code = pa.nulls(len(take), pa.binary()) if codes is None else pa.array([codes[i] for i in take], pa.binary())
        columns = [pa.array(block.astype(np.int32)), pa.array(copy.astype(np.int32)), pa.array(np.full(len(take), asks)), batch.column(0).take(at), none, batch.column(1).take(at), pa.array(own[take].astype(np.int32)), pa.array(err[take]), code]
        return pa.RecordBatch.from_arrays([*columns, pa.array([asked[i] for i in take], pa.binary()), batch.column(2).take(at)], schema=_CELL_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(model.points)):
            reps, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            unit = _matrix(batch.column(2))[1]
            own, asks, whole = asking.of(unit)
            codes, err = model.encode(unit, parts.part[own] // 2)
            mixed = ((reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            raw = [c.tobytes() for c in codes]
            asked = [np.flatnonzero(a).astype(np.int32).tobytes() for a in asks]

            block = first[own] + mixed % number[own]
            take = np.repeat(np.arange(len(unit)), copies[block])
            copy = np.arange(len(take)) - np.repeat(np.cumsum(copies[block]) - copies[block], copies[block])
            yield rows(block[take], copy, False, take, batch, own, err, raw, asked)
            take, block = _asked_blocks(asks, first, number)
            yield rows(block, (mixed[take] >> 7) % copies[block], True, take, batch, own, err, None, asked)

            ball = parts.part[own] % 2 == 1
            inside = np.flatnonzero(ball)
            row, part = np.nonzero(whole)
            gained = np.bincount(part, weights=n[row], minlength=len(parts.part)).astype(np.int64)
            some = np.flatnonzero(gained)
            yield _told(reps[inside], parts.least[own[inside]], [None] * len(inside), [None] * len(inside))
            yield _told(reps[row], parts.least[part], [None] * len(row), [None] * len(row))
            yield _told(reps[inside], [None] * len(inside), parts.vectors[own[inside]] - n[inside], own[inside])
            yield _told(reps[row], [None] * len(row), parts.vectors[part], [None] * len(row))
            yield _told([None] * len(some), [None] * len(some), gained[some], some)

    return run


_FOUND = "a long, b long, n long, own int"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("own", pa.int32())])


class _Block:
    """The members of one copy of a block."""

    def __init__(self, model: Quantiser, parts: Parts, least: float, rows: pa.Table) -> None:
        self.model, self.parts, self.least = model, parts, least
        rows = rows.combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["a"].to_numpy(), kind="stable")))
        self.reps, self.n, self.own, self.err = (rows[c].to_numpy() for c in ("a", "n", "own", "err"))
        self.x = _matrix(rows["v"].combine_chunks())[0]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.codes = np.frombuffer(b"".join(c.as_buffer().to_pybytes() for c in rows["codes"].combine_chunks()), np.uint8).reshape(len(rows), -1)
        self.asked = [frozenset(np.frombuffer(a.as_buffer(), np.int32).tolist()) for a in rows["asked"].combine_chunks()]
        self.of_part = {int(p): np.flatnonzero(self.own == p) for p in np.unique(self.own)}

    def pairs(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of the rows (who ask) and the members, each pair of classes in one direction only."""
        x, unit = _matrix(rows["v"].combine_chunks())
        norm, reps, own = np.sqrt((x * x).sum(1)), rows["a"].to_numpy(), rows["own"].to_numpy()
        tables = self.model.tables(unit)
        lists = [np.frombuffer(a.as_buffer(), np.int32) for a in rows["asked"].combine_chunks()]
        asker, part = np.repeat(np.arange(len(x)), [len(a) for a in lists]), np.concatenate(lists)
        found = []
        for p, members in self.of_part.items():
            q = asker[part == p]
            if not len(q):
                continue
            near = (unit[q] @ self.model.points[self.parts.part[p] // 2]).astype(np.float32)[:, None] + self.err[members].astype(np.float32)
            for m, table in enumerate(tables):
                near += table[q][:, self.codes[members, m]]
            i, j = np.nonzero(near >= self.least - _SLACK)
            a, b = q[i], members[j]
            for at in range(0, len(a), 50_000):
                c, d = a[at : at + 50_000], b[at : at + 50_000]
                exact = (x[c] * self.x[d]).sum(1) / (norm[c] * self.norm[d])
                hit = exact >= self.least
                found.append((c[hit], d[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        same = own[a] == self.own[b]
        # of two outer parts that ask each other, the first asks
        both, at = np.unique(own[a].astype(np.int64) << 32 | b, return_inverse=True)
        back = np.array([k >> 32 in self.asked[k & 0xFFFFFFFF] for k in both.tolist()], bool)[at] & (self.parts.part[self.own[b]] % 2 == 0)
        keep = np.where(same, reps[a] < self.reps[b], ~back | (own[a] < self.own[b]))
        return a[keep], b[keep]

    def found(self, rows: pa.Table) -> pa.RecordBatch | None:
        a, b = self.pairs(rows)
        if not len(a):
            return None
        nodes, at = np.unique(np.r_[rows["a"].to_numpy()[a], self.reps[b]], return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        number = np.bincount(x, self.n[b], len(nodes)) + np.bincount(y, rows["n"].to_numpy()[a], len(nodes))
        label = np.arange(len(nodes))
        while True:  # the smallest node that the pairs reach
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(nodes)))
        columns = [np.r_[nodes[far], nodes], pa.array([*nodes[label[far]].tolist(), *[None] * len(nodes)], pa.int64()), pa.array([*[None] * len(far), *number.astype(np.int64).tolist()], pa.int64()), pa.nulls(len(far) + len(nodes), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *columns[1:]], schema=_FOUND_ARROW)


def _compare(model: Quantiser, parts: Parts, least: float):
    """Rows come by block and copy, members first; a block's members are held, those who ask stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block = None, [], None
        for whole in batches:
            for batch in (whole.slice(k, 4096) for k in range(0, whole.num_rows, 4096)):
                names = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                asks = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
                cuts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]) | (asks[1:] != asks[:-1])) + 1, len(names)]
                for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows = batch.slice(at, end - at)
                    if names[at] < 0:
                        yield pa.RecordBatch.from_arrays([rows.column(k) for k in (3, 4, 5, 6)], schema=_FOUND_ARROW)
                        continue
                    if names[at] != key:
                        key, members, block = names[at], [], None
                    if not asks[at]:
                        members.append(rows)
                        continue
                    if block is None and members:
                        block = _Block(model, parts, least, pa.Table.from_batches(members))
                    if block is not None and (out := block.found(pa.Table.from_batches([rows]))) is not None:
                        yield out

    return run


def _of_length(classes: DataFrame, least: float, probes: int | None) -> DataFrame:
    """(a, b, n, own) over classes (rep, n, v) of one length; own numbers the balls."""
    total, spread = classes.count(), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    model = Quantiser.fit(_matrix(sample["v"].combine_chunks())[1], total / LIST_ROWS, least)
    held = classes.repartition(spread, F.xxhash64("rep")).select("rep", "n", "v").mapInArrow(_members(model), "part long, classes long, vectors long, radius double, least long")
    # at most two rows for each list, of which there are at most (MOST_CENTRES + 1) ** 2
    rows = held.groupBy("part").agg(F.sum("classes").alias("classes"), F.sum("vectors").alias("vectors"), F.max("radius").alias("radius"), F.min("least").alias("least")).orderBy("part").toArrow()
    parts = Parts(*[rows[c].to_numpy() for c in ("part", "classes", "vectors", "radius", "least")])
    asking, (first, number) = Asking(model, parts, probes), parts.blocks()
    copies = np.ones(int((first + number).max()) + 1, np.int64)
    for r in classes.select("v").mapInArrow(_askers(asking, first, number), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_QUERIES).collect():
        copies[r["block"]] = -(-r["n"] // BLOCK_QUERIES)
    dealt = classes.repartition(spread, F.xxhash64("rep")).select("rep", "n", "v").mapInArrow(_deal(asking, first, number, copies), _CELL)
    return dealt.repartition(spread, "block", "copy").sortWithinPartitions("block", "copy", "asks").mapInArrow(_compare(model, parts, least), _FOUND)


def cosine_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE, probes: int | None = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors. probes: outer parts that a vector asks; None for an exact result."""
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(_with_bytes, "vec_id long, v binary")
    raw = raw.withColumn("same", F.when(F.col("vec_id").isNotNull(), F.md5("v")))
    rows = save(raw, "vectors")
    classes = save(rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")
    lengths = [r[0] for r in classes.groupBy(F.length("v").alias("d")).count().where("count > 1").collect()]
    found = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("own")).limit(0)
    for d in sorted(lengths):
        one = _of_length(classes.where(F.length("v") == d).select("rep", "n", "v"), least, probes)
        found = found.unionByName(one.withColumn("own", F.concat(F.lit(f"{d}:"), F.col("own"))))
    found = save(found, "found")
    of_balls = found.where("a is null").groupBy("own").agg(F.sum("n").alias("more"))
    numbers = found.where("a is not null and b is null").join(of_balls, "own", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.col("n") + F.coalesce("more", F.lit(0).cast("long"))).alias("others"))
    member = components(found.where("b is not null").select("a", "b"))
    told = classes.select("same", "rep", "n").join(numbers, "rep", "left").join(member, F.col("rep") == F.col("node"), "left")
    told = told.select("same", (F.col("n") - 1 + F.coalesce("others", F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "same").join(told, "same", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
