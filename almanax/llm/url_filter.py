"""URL filter by explicit rules and by an Empirical-Bayes reputation of hosts. DataFrame functions only.

Method. Labelled pages give each host a count of labelled and of bad pages. The bad share is shrunk down a chain of
beta-binomial priors: the whole table, then the suffix, then the registered domain, then the host. The strength of each
prior is fitted by moments to the groups of that level. A host is blocked if the lower posterior bound of its bad share
(mean minus z standard deviations of its Beta posterior) exceeds a limit. Hosts without labels get their domain's or
suffix's prior.

Defined results: a null url, or one without "://", has empty host and path and takes the verdict of the empty host
(rules never fit it). Repeated rows are judged one by one. Labels that are null count as absent; without any labels the
prior is the given prior_bad. Other columns pass through untouched, unless their name is that of an output column; such
a column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fixed values of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za")
Z, MAX_BAD, PRIOR_BAD, LEAST_STRENGTH, MOST_STRENGTH = 1.645, 0.5, 0.1, 2.0, 1000.0


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(hit, value) if fits is None else fits.when(hit, value)
    return fits


def _shrunk(prior: Column) -> Column:
    return (F.col("bad") + F.col("strength") * prior) / (F.col("n") + F.col("strength"))


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior's strength by moments over the groups of a level.

    For beta-binomial groups, sum n (p - m)^2 over the groups has the mean m(1-m)(G + (N - G) r), G groups and N rows, where
    r = 1 / (1 + strength); solved for the strength and held between the two bounds.
    """
    t = level.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count(F.lit(1)).alias("G"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("S"))
    m = F.col("B") / F.col("N")
    spread = F.col("S") - F.col("N") * m * m
    r = (spread / (m * (1 - m)) - F.col("G")) / (F.col("N") - F.col("G"))
    fitted = F.when((F.col("N") > F.col("G")) & (m > 0) & (m < 1) & (r > 0), 1 / r - 1).otherwise(F.lit(MOST_STRENGTH))
    return t.select(F.least(F.greatest(F.coalesce(fitted, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))


def host_reputation(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", bad: str = "bad", prior_bad: float = PRIOR_BAD, z: float = Z, max_bad: float = MAX_BAD) -> DataFrame:
    """One row per host of pages: host, n_labelled, n_bad, bad_mean, bad_bound, host_verdict.

    labels has page_id and a 0/1 column named by bad; several labels of a page all count.
    """
    hosts = pages.select(F.col(page_id).alias("_id"), url_host(F.col(url)).alias("host"))
    seen = labels.where(F.col(bad).isNotNull()).select(F.col(page_id).alias("_id"), F.col(bad).cast("long").alias("_bad"))
    labelled = hosts.join(seen, "_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"))
    host = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).join(labelled, "host", "left").na.fill(0, ["n", "bad"])
    host = host.withColumns({"domain": registered_domain(F.col("host")), "suffix": url_suffix(F.col("host"))})

    # each level has one row per group that pages have; those without labels just take the level above
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffix.agg(F.coalesce((F.sum("bad") + F.lit(prior_bad) * LEAST_STRENGTH) / (F.sum("n") + LEAST_STRENGTH), F.lit(prior_bad)).alias("m0"))
    fitted = lambda level: level.withColumn("strength", _strength(level.where("n > 0")).scalar())
    suffix = fitted(suffix).withColumn("m0", total.scalar()).select("suffix", _shrunk(F.col("m0")).alias("m1"))
    domain = fitted(domain).join(suffix, "suffix").select("domain", "suffix", _shrunk(F.col("m1")).alias("m2"))
    out = fitted(host).join(domain, ["domain", "suffix"])
    a, b = F.col("bad") + F.col("strength") * F.col("m2"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("m2"))
    mean = a / (a + b)
    bound = mean - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select(
        "host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean.alias("bad_mean"), bound.alias("bad_bound"), F.when(bound > max_bad, "block").otherwise("allow").alias("host_verdict")
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", **reputation) -> DataFrame:
    """pages with host, path, rule, verdict, bad_mean and bad_bound. Hosts are joined back by a join that Spark may split on skew."""
    added = ["host", "path", "rule", "verdict", "bad_mean", "bad_bound", "n_labelled", "n_bad", "host_verdict", "_hit"]
    rep = host_reputation(pages.select(page_id, url), labels, page_id, url, **reputation)
    rows = pages.drop(*added).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rows = rows.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules)).join(rep, "host", "left")
    return rows.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce(F.col("_hit.verdict"), F.col("host_verdict"))}).drop("_hit")


def filter_urls(pages: DataFrame, labels: DataFrame, **kwargs) -> DataFrame:
    """The rows of pages that are allowed, with their own columns only."""
    return judge_urls(pages, labels, **kwargs).where("verdict = 'allow'").select(*[F.col(f"`{c}`") for c in pages.columns])
