"""The corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (collocations, decontaminate, fingerprint, language_id, mixing, ngram_join, quality, secret_scan, spelling, suffix_dedup,
                           token_files, toxicity, url_filter)
from plumbline.llm.common import documents, fold
from plumbline.llm.twins import TWINS


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = decontaminate.find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select(
        F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a 5:2:1 mixture of the sources takes from every document."""
    plan = mixing.schedule(documents(spark, sf_dir))
    return plan.select(
        F.col("doc").alias("doc_id"), "size", F.col("source_words").alias("source_size"), "target",
        (F.col("size") * F.size("finishes")).cast("long").alias("taken"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in order of doc_id and read back from the files."""
    path = token_files.write(documents(spark, sf_dir))
    return token_files.read_facts(spark, path)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sampling fingerprints of every document and its edited text."""
    return fingerprint.fingerprint_edits(documents(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of passages of 200 bytes that occur more than once."""
    found = suffix_dedup.find_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from two thirds of the labels."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.train(docs, labels, fold(F.col("doc_id"), 3) != 1).score(docs, docs["doc_id"])
    return _judged(scored, 0.5)


def _judged(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    return scored.select(
        F.col("doc").alias("doc_id"), (fold(F.col("doc"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.link(documents(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and what the threshold of its language flags; learned from two thirds of the labels."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return _judged(model.score(docs, lang_col="lang"), 0.7, "flagged")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from three quarters of the documents."""
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.train(docs, fold(F.col("doc_id"), 4) != 2))
    return found.select(F.col("doc").alias("doc_id"), (fold(F.col("doc"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words."""
    return collocations.mine(documents(spark, sf_dir)).drop("words")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.group(spelling.count_words(documents(spark, sf_dir)))


#: Rules of ``op13_url_filter``: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by rules, else by boosted trees that learned from the URLs with a rule."""
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_secrets, op3_mix, op4_fingerprint, op5_suffix_dedup, op6_quality, op7_token_files, op8_ngram_join, op9_toxicity, op10_language,
        op11_collocations, op12_spelling, op13_url_filter, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
