"""Line dedup by site-relative frequency. DataFrame functions only.

Method. Per host, the pages that hold a line (normalised and hashed) are divided by the host's pages; lines whose ratio
exceeds a limit, by its lower confidence bound, are boilerplate and dropped from every page of the host. A host's equal texts
are one page, so that copies of a page don't make its lines boilerplate.

Defined results: a null host is a host of its own; a null text stays null and an empty one empty; blank lines are never
counted and stay. A page that loses all its lines has the empty text. Repeated rows, all other columns and all rows pass
through. A line on one page only always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.llm.lines import ONE_IN, Z_SQUARED, has_word, is_boilerplate, line_key, lines
from almanax.llm.scratch import save


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", one_in: int = ONE_IN, z_squared: float = Z_SQUARED) -> DataFrame:
    """host, key, pages (that hold the line) and host_pages, of the lines to drop.

    A page gives each of its lines once, so partial sums before the shuffle leave at most one row per task, host and line.
    """
    keys = F.array_distinct(F.transform(F.filter(lines(F.col(text)), has_word), line_key))
    rows = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("same"), F.length(text).alias("length"), keys.alias("keys"))
    rows = rows.groupBy("host", "same", "length").agg(F.first("keys").alias("keys"))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    held = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    both = held.join(total.withColumnRenamed("host", "_host"), held["host"].eqNullSafe(F.col("_host")))
    return both.where(is_boilerplate(F.col("pages"), F.col("host_pages"), one_in, z_squared)).select("host", "key", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = "n_chars", **limits) -> DataFrame:
    """docs with the text's boilerplate lines dropped, and n_chars, if there is such a column, counted anew.

    A host has at most (lines per page) * one_in boilerplate lines, so they join as one short array per host: a table of known
    size, which Spark broadcasts if it is small, so texts aren't shuffled, and else joins by host, splitting hot hosts.
    """
    own = "_".join(["_common", *docs.columns])  # unlike any column of docs
    common = boilerplate_lines(docs, text, host, **limits).groupBy("host").agg(F.collect_list("key").alias(own)).withColumnRenamed("host", own + "_host")
    common = save(common, "boilerplate")
    joined = docs.join(common, docs[host].eqNullSafe(common[own + "_host"]), "left")
    kept = F.filter(lines(F.col(text)), lambda x: ~(has_word(x) & F.array_contains(own, line_key(x))))
    joined = joined.withColumn(text, F.when(F.col(text).isNull() | F.col(own).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    if n_chars in docs.columns:
        joined = joined.withColumn(n_chars, F.length(F.col(text)).cast(docs.schema[n_chars].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
