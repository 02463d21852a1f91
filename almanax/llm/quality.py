"""Quality rules on documents and on lines that many documents of a host share. DataFrame functions only.

Method. The base rules look at one document (its number of words, and the words in repeated 3-word windows). Then lines are
normalised and hashed, the distinct documents of each host that hold a line are counted, lines above the limit (line dedup's:
a share of the host's distinct documents, by its lower confidence bound) are taken out, and a document is rejected if too
little of it is left.
Documents with the same text count once, so a text isn't rejected for having copies.

Defined results: a null or blank text has no words, fails the base rules and isn't kept. A null host is a host of its own.
Rows with a repeated doc_id are judged one by one on their own text. An empty table gives an empty result. Other columns
pass through, unless they have the name of an output column; such a column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.llm.lines import ONE_IN, SPACES, Z_SQUARED, has_word, is_boilerplate, line_key, lines, words
from almanax.llm.scratch import save

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A document is depleted if fewer than this share of its words are in other lines.
LEAST_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(ws: Column, size: int = 3) -> Column:
    """Number of words that stand in a window of so many words that the text holds twice or more.

    Windows are sorted by hash and place, which puts equal ones side by side.
    """
    n = F.size(ws) - (size - 1)
    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  computes value once
    spot = lambda i: F.struct(F.xxhash64(*[F.element_at(ws, i + k) for k in range(size)]).alias("h"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(1), n), spot))

    def marked(spots: Column) -> Column:
        """Of sorted windows, the places of those whose neighbour is the same."""
        same = F.zip_with(spots, F.slice(spots, F.lit(2), F.size(spots)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    found = one(ordered, lambda o: one(marked(o), covered))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(found)


def base_metrics(text: Column, ws: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    full = F.filter(lines(text), has_word)
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.octet_length(body) - F.octet_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": repeated_window_words(ws),
    }


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", one_in: int = ONE_IN, z_squared: float = Z_SQUARED, least_left: float = LEAST_LEFT, carry: bool = False) -> DataFrame:
    """Per row of docs: _id, the metrics, base_failed, words_left (in lines below the limits), kept, and with carry the row itself as _row."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    scan = docs.select(*rest, F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    scan = scan.withColumn("_words", words(F.col("_text")))
    counted = lambda x: F.struct(line_key(x).alias("key"), F.size(words(x)).alias("n"))
    passed = ["_row"] if carry else []
    held = scan.select(
        *passed, "_id", "_host", F.xxhash64(F.col("_text")).alias("_same"), F.length("_text").alias("_length"), *[c.alias(k) for k, c in base_metrics(F.col("_text"), F.col("_words")).items()],
        F.filter(F.transform(lines(F.col("_text")), counted), lambda x: x["n"] > 0).alias("_lines"),
    )
    held = save(held, "quality")

    # a text has one line of each key here, and a host one copy of each text, so counts of rows are counts of documents
    texts = held.where(F.size("_lines") > 0).groupBy("_host", "_same", "_length").agg(F.first("_lines").alias("_lines"))
    spread = texts.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["key"]))).alias("key"))
    in_host = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"))
    common = spread.groupBy("_host", "key").agg(F.count(F.lit(1)).alias("line_docs")).where("line_docs > 1")
    common = common.join(in_host, common["_host"].eqNullSafe(in_host["_host"])).where(is_boilerplate(F.col("line_docs"), F.col("host_docs"), one_in, z_squared)).select(common["_host"], "key")
    # more than one in so many of a host's documents hold such a line, so a host has at most that many times a document's lines
    common = save(common.groupBy("_host").agg(F.collect_list("key").alias("_common")), "boilerplate")
    judged = held.join(common.withColumnRenamed("_host", "_h"), held["_host"].eqNullSafe(F.col("_h")), "left").drop("_h")
    left = F.aggregate(F.filter("_lines", lambda x: ~F.coalesce(F.array_contains("_common", x["key"]), F.lit(False))), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    judged = judged.select(*passed, "_id", *METRICS, left.alias("words_left"))
    judged = judged.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= least_left * F.col("n_words")))


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """One row per row of docs: doc_id, the metrics, base_failed, words_left and kept."""
    return quality_rules(docs, doc_id, text, host, **limits).select(F.col("_id").alias(doc_id), *METRICS, "base_failed", "words_left", "kept")


def keep_good_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return quality_rules(docs, doc_id, text, host, carry=True, **limits).where("kept").select("_row.*")
