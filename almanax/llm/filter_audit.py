"""How filters overlap and what each order of them costs, by a walk over all orders that swaps two neighbours at a time.

Method. Spark gives each document a mask of the filters that it fails and counts documents by part and mask: 2^n cells for n
filters, however many documents. A part's cells are then walked in one small task: the orders of the filters are visited so that
each follows from the one before by swapping two neighbours (Steinhaus, Johnson and Trotter). A filter removes the documents of the
cells that hold it and none of the filters before it, so a swap changes two steps only; these are counted anew from the cells and the
other steps stay. Each filter's Shapley sum is added up along the walk.

Defined results: a null text is empty, a null part is the empty string. A copy is a row with the text of a smaller doc_id; rows of
one doc_id are not copies of each other, and a null doc_id neither is a copy nor makes one. Every row counts as a document, repeated
ones too. A document is good or toxic if any of its label rows says so; labels without a document count nothing. No documents give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.llm.lines import words

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_rules(text: str = "text") -> dict[str, Column]:
    """What fails a text, by letter: A few words, B few different ones, C many capitals, D odd signs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n_words, n_distinct = F.size(words(whole)), F.size(F.array_distinct(words(whole)))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n_words < 200, "B": 100 * n_distinct.cast("long") < 50 * n_words.cast("long"), "C": 100 * capitals.cast("long") > 3 * F.length(whole).cast("long"), "D": whole.rlike(r"[#$%&*|]")}


def cells(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters that they fail, bit k for the k-th of rules, the last bit for copies.

    A text's smallest doc_id is found by its SHA-256, pre-aggregated in tasks; rows then meet it by text and doc_id together, so
    that a text with very many copies is dealt by its rows.
    """
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(rules.values())), F.lit(0))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("fp"), mask.alias("mask"))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    is_copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.join(first, ["fp", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(is_copy, F.lit(1 << len(rules))).otherwise(F.lit(0))).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good").alias("n_good"), total("bad").alias("n_toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose items change places with those at k + 1, one after another, to visit all orders of n items once each."""
    place, left = list(range(n)), [True] * n  # by item: where it is, and whether it is looking left
    at = list(range(n))
    while True:
        for item in range(n - 1, -1, -1):
            k = place[item] + (-1 if left[item] else 1)
            if 0 <= k < n and at[k] < item:
                break
        else:
            return
        j, other = place[item], at[k]
        at[j], at[k], place[item], place[other] = other, item, k, j
        left[item + 1 :] = [not x for x in left[item + 1 :]]
        yield min(j, k)


def walk(counts: list[tuple[int, int, int]], letters: Sequence[str]) -> list[tuple]:
    """(filter_order, step, *COUNTS) of every order of letters, from the (n, n_good, n_toxic) of each mask."""
    n = len(letters)

    def gone(k: int, before: int) -> tuple[int, ...]:
        """What filter k removes after those of the set before, summed over the cells."""
        return tuple(sum(c) for c in zip(*(counts[m] for m in range(1 << n) if m >> k & 1 and not m & before), strict=True))

    fails = [gone(k, 0)[0] for k in range(n)]
    total = sum(c[0] for c in counts)
    order, removed, shapley, visited = list(range(n)), [], [0] * n, []
    for step in range(n):
        removed.append(gone(order[step], sum(1 << k for k in order[:step])))

    def visit() -> None:
        for k, r in zip(order, removed, strict=True):
            shapley[k] += r[0]
        visited.append((list(order), list(removed)))

    visit()
    for j in swaps(n):
        order[j], order[j + 1] = order[j + 1], order[j]
        before = sum(1 << k for k in order[:j])
        removed[j : j + 2] = gone(order[j], before), gone(order[j + 1], before | 1 << order[j])
        visit()
    out = []
    for order, removed in visited:
        name, kept = "".join(letters[k] for k in order), total
        for step, (k, (r, good, toxic)) in enumerate(zip(order, removed, strict=True), 1):
            kept -= r
            out.append((name, step, kept, r, fails[k] - r, counts[1 << k][0], good, toxic, shapley[k]))
    return out


def audit(cells: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Per part, order and step the counts of COUNTS; cells as cells() gives them, bit k for the k-th letter. At most 8 filters.

    Shapley sums are over all orders, for their mean divide by the number of orders.
    """
    if not 1 <= len(letters) <= 8:
        raise ValueError("from one to eight filters: the orders are listed")

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        counts = [(0, 0, 0)] * (1 << len(letters))
        for m, *c in some[["mask", "n", "n_good", "n_toxic"]].itertuples(index=False):
            counts[m] = tuple(map(int, c))
        return pd.DataFrame([(key[0], *r) for r in walk(counts, letters)], columns=["part", "filter_order", "step", *COUNTS])

    return cells.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))



def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four rules on texts and of copies (E), by language."""
    rules = text_rules()
    return audit(cells(docs, labels, rules), [*rules, "E"])
