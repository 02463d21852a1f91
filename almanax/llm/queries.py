"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.llm import filter_audit, line_dedup, ngram_join, packing, pq_dedup, prefix_trie, quality, secrets, sentencepiece, substring_dedup, toxicity, url_filter, warc
from almanax.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url judged; a page's labelled outcome is that of the document with its number: bad if toxic or of low quality."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    posterior = [F.round(c, 6).alias(c) for c in ("bad_mean", "bad_bound")]
    return url_filter.judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", *posterior)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    return line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's metrics, the base rules' verdict, the words that are left and if it is kept."""
    return quality.judge_documents(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of spans of each base kind, a digest of the base spans, and all spans."""
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*secrets.BASE))
    number = {f"n_{k}": F.size(F.filter(F.col("secret_spans")["kind"], F.lit(k).__eq__)).cast("long") for k in secrets.BASE}
    digest = F.sha2(secrets.spans_text(base).cast("binary"), 256)
    return found.select("doc_id", *[c.alias(k) for k, c in number.items()], digest.alias("base_sha256"), secrets.spans_text(F.col("secret_spans")).alias("spans"))


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the smallest document that links reach."""
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op4_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links and the smallest vector that they reach."""
    return pq_dedup.cosine_components(_read(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: numbers of words and ids, digests of the ids and of the text that they decode to."""
    return sentencepiece.digests(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by a chain of the labelled categories: low quality, then toxic."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
    return toxicity.score_documents(docs, labels, ("low_quality", "toxic"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the record that is read back of it."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per distinct prefix of rebuilt conversations its members, children, leaves and the bytes that sharing saves."""
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, order of five filters and step, what the step keeps, removes and costs."""
    return filter_audit.audit_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words that repeat a window of a smaller document, and a digest of the others."""
    found = substring_dedup.repeated_words(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.lower(F.hex("kept_digest")).alias("kept_sha256"))


_ALL = (op1_url_reputation, op2_best_fit_packing, op3_ngram_jaccard, op4_pq_near_dedup, op5_secret_scan, op6_sentencepiece, op7_line_dedup, op8_quality_rules, op9_toxicity, op10_warc, op11_prefix_trie, op12_filter_audit, op13_substring_dedup)
QUERIES = {f.__name__: f for f in _ALL}
