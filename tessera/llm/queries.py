"""The queries of this subpackage: operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, vocabulary


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.digest(substrings.dedup(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.entities(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import forest

    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pages

    return pages.digest(pages.extract(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_ngram_jaccard_join, op4_token_files, op5_toxicity, op6_token_counts, op7_embedding_near_dedup, op8_decontamination, op9_packing, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {}
