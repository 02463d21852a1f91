"""Toxicity by a classifier chain.

Method. Categories are predicted one after another by logistic models; each model's features are words, beginnings of words and
a few shape figures of the text, and the logits that the chain gave to the earlier categories. A later model is trained with out-of-fold predictions
of the earlier ones: those of models that never saw the row. Words become features if a chi-square test on the training rows
ties them to a category; a fold's words are chosen without the fold's rows.

The models are fitted to a bounded sample of labelled rows that have a document, the most_rows with the least hash of their id; all
documents are scored, whole.

Defined results: a null or empty text has no words and gets the probabilities of its zero features. Rows with null labels
aren't trained on; of documents with one id the least text is. If a category has rows of one class only, or no rows, its probability is its share (0.5 without rows).
Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from almanax.llm.scratch import save

MOST_ROWS, MOST_WORDS, FOLDS, LEAST_CHI2, LEAST_ROWS = 20_000, 400, 5, 20.0, 5
#: Bytes of the beginnings of words that are features too.
BEGINNINGS = (5, 7)
_SHAPE = ("words", "distinct", "upper", "marks", "digits")
#: Lower-cases A-Z and turns all other ASCII marks but digits into blanks.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_words(text: bytes) -> set[bytes]:
    """The distinct words, and with a star those beginnings that inflected words share."""
    words = set(text.translate(_FOLD).split())
    return words.union(*[{w[:n] + b"*" for w in words if len(w) > n} for n in BEGINNINGS])


def shape(text: bytes, words: int) -> list[float]:
    """Figures that don't grow with the text."""
    n = len(text) + 1
    spread = len(text.split()) + 1
    upper = n - 1 - len(text.translate(None, bytes(range(65, 91))))
    digits = n - 1 - len(text.translate(None, bytes(range(48, 58))))
    marks = n - 1 - len(text.translate(None, b"#*$%&|<>!?;{}[]()=~^@/\\"))
    return [np.log1p(spread) / 8, words / spread, upper / n, 10 * marks / n, 10 * digits / n]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 15) -> np.ndarray:
    """Weights, the constant last, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 0.01:
            break
    return w


@dataclass
class Link:
    """A category's model: words, and weights of words, shape, earlier logits and the constant."""

    words: list[bytes]
    weights: np.ndarray
    place: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}

    def matrix(self, sets: Sequence[set[bytes]], shapes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(sets), len(self.words)))
        for i, words in enumerate(sets):
            x[i, [self.place[w] for w in self.place.keys() & words]] = 1
        return np.column_stack([x, shapes, np.clip(earlier, -8, 8)])

    def logits(self, sets: Sequence[set[bytes]], shapes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.matrix(sets, shapes, earlier) @ self.weights[:-1] + self.weights[-1]


def _fit_link(words: list[bytes], sets, shapes: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
    link = Link(words, np.zeros(len(words) + shapes.shape[1] + earlier.shape[1] + 1))
    if not len(y):
        return link
    if y.min() == y.max():
        link.weights[-1] = 8.0 if y[0] else -8.0
        return link
    link.weights = logistic(link.matrix(sets, shapes, earlier), y)
    return link


@dataclass
class Chain:
    """thresholds: per category the probability with the best F1 on the training rows, by out-of-fold predictions."""

    categories: tuple[str, ...]
    links: list[Link]
    thresholds: list[float]

    def logits(self, texts: Sequence[bytes]) -> np.ndarray:
        """Of each text only the words that are features are held."""
        wanted = frozenset().union(*[link.place for link in self.links])
        sets, shapes = [], np.zeros((len(texts), len(_SHAPE)))
        for i, t in enumerate(texts):
            words = text_words(t)
            shapes[i] = shape(t, len(words))
            sets.append(words & wanted)
        out = np.zeros((len(texts), 0))
        for link in self.links:
            out = np.column_stack([out, link.logits(sets, shapes, out)])
        return out


_FEATURES = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.string())), ("shape", pa.list_(pa.float64())), ("fold", pa.int32()), ("y", pa.list_(pa.int32()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words are bytes; as strings of their Latin-1 letters they can be hashed by Spark."""
    for whole in batches:
        for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            sets = [text_words(t) for t in texts]
            words = pa.array([[w.decode("latin-1") for w in s] for s in sets], pa.list_(pa.string()))
            shapes = pa.array([shape(t, len(s)) for t, s in zip(texts, sets, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, shapes, batch.column(2), batch.column(3)], schema=_FEATURES)


def _telling_words(rows: DataFrame, categories: int, folds: int, most: int) -> dict[tuple[int, int], list[bytes]]:
    """Words for category k by chi-square, under (k, f) from the rows outside fold f, and under (k, -1) from all rows."""
    fold, every = F.col("fold"), range(folds)
    y = [F.element_at("y", k + 1) for k in range(categories)]
    sums = [*[F.count_if(fold == f).alias(f"n{f}") for f in every], *[F.sum(F.when(fold == f, y[k]).otherwise(0)).alias(f"y{k}_{f}") for k in range(categories) for f in every]]
    total = rows.agg(*sums).first().asDict()
    each = rows.select("fold", "y", F.explode("words").alias("word")).groupBy("word").agg(*sums)
    variants = []
    for k in range(categories):
        for f in (-1, *every):
            used = [g for g in every if g != f]
            n, b = sum(total[f"n{g}"] for g in used), sum(total[f"y{k}_{g}"] or 0 for g in used)
            if 0 < b < n:
                wn, wy = sum((F.col(f"n{g}") for g in used), F.lit(0)), sum((F.col(f"y{k}_{g}") for g in used), F.lit(0))
                expected = wn * F.lit(b / n)
                chi2 = F.pow(wy - expected, 2) / F.greatest(expected * F.lit(1 - b / n) * (1 - wn / n), F.lit(1e-9))
                variants.append(F.when(wn >= LEAST_ROWS, F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), chi2.alias("chi2"))))
    out: dict[tuple[int, int], list[bytes]] = {(k, f): [] for k in range(categories) for f in (-1, *every)}
    if variants:
        told = each.select("word", F.explode(F.array_compact(F.array(*variants))).alias("v")).select("word", "v.*").where(F.col("chi2") > LEAST_CHI2)
        best = told.withColumn("place", F.row_number().over(W.partitionBy("k", "f").orderBy(F.desc("chi2"), "word"))).where(F.col("place") <= most)
        for r in best.select("k", "f", "word").collect():  # at most most words for each category and fold
            out[r["k"], r["f"]].append(r["word"].encode("latin-1"))
    return {at: sorted(ws) for at, ws in out.items()}


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, folds: int = FOLDS) -> Chain:
    """labels has ids and a 0/1 column for each category; their order is the chain's. Only texts of the sample are read further."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("y")).where(~F.array_contains(F.transform("y", lambda v: v.isNull()), True))
    # labels without a document don't use up the sample
    known = known.join(docs.select(F.col(doc_id).cast("long").alias("id")), "id", "left_semi")
    some = known.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")  # most_rows small rows at most
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # an id's documents don't exceed the bound
    sample = save(texts.select("id", "text", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"), "y"), "sample")
    rows = sample.mapInArrow(_features, "id long, words array<string>, shape array<double>, fold int, y array<int>")
    words = _telling_words(rows, len(categories), folds, most_words)
    wanted = sorted({w for ws in words.values() for w in ws})
    # of a bounded number of rows, the words that are features
    kept = rows.select("shape", "fold", "y", F.array_intersect("words", F.array(*[F.lit(w.decode("latin-1")) for w in wanted]).cast("array<string>")).alias("words")).toArrow()
    sets = [{w.encode("latin-1") for w in ws} for ws in kept["words"].to_pylist()]
    shapes = np.array(kept["shape"].to_pylist()).reshape(len(sets), len(_SHAPE))
    fold, target = kept["fold"].to_numpy(), np.array(kept["y"].to_pylist()).reshape(len(sets), len(categories))
    links, earlier, thresholds = [], np.zeros((len(sets), 0)), []
    for k in range(len(categories)):
        y = target[:, k].astype(float)
        links.append(_fit_link(words[k, -1], sets, shapes, earlier, y))
        unseen = np.zeros(len(sets))
        for f in range(folds):
            there, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            link = _fit_link(words[k, f], [sets[i] for i in there], shapes[there], earlier[there], y[there])
            unseen[held] = link.logits([sets[i] for i in held], shapes[held], earlier[held])
        earlier = np.column_stack([earlier, unseen])
        thresholds.append(_best_threshold(1 / (1 + np.exp(-np.clip(unseen, -30, 30))), y))
    return Chain(tuple(categories), links, thresholds)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of 0.05 to 0.5, the one with the best F1; the highest of equal ones, and 0.5 without any rows of the category."""
    tried = np.arange(10, 0, -1) * 0.05
    hit = np.array([(y[p >= t].sum(), (p >= t).sum()) for t in tried], float)
    f1 = 2 * hit[:, 0] / np.maximum(hit[:, 1] + y.sum(), 1)
    return float(tried[f1.argmax()])


def probabilities(chain: Chain, text: Column) -> Column:
    """Struct of one probability per category."""
    fields = [pa.field(c, pa.float64()) for c in chain.categories]

    @F.arrow_udf(", ".join(f"{c} double" for c in chain.categories))
    def score(texts: pa.Array) -> pa.Array:
        parts = [chain.logits([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[k : k + 512]]) for k in range(0, len(texts), 512)]
        p = 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros((0, len(fields))), -30, 30)))
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(fields))], fields=fields)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, categories: Sequence[str], doc_id: str = "doc_id", text: str = "text", threshold: float | None = None, **fit) -> DataFrame:
    """Per row of docs: its id, p_<category> of each, and the last category as a boolean. labels has ids and 0/1 columns.

    threshold: of the last category; else the one fitted.
    """
    chain = fit_chain(docs, labels, categories, doc_id, text, **fit)
    scored = docs.select(F.col(doc_id), probabilities(chain, F.col(text)).alias("_p"))
    return scored.select(doc_id, *[F.col("_p")[c].alias(f"p_{c}") for c in categories], (F.col("_p")[categories[-1]] >= (chain.thresholds[-1] if threshold is None else threshold)).alias(categories[-1]))
