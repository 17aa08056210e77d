"""A cleaning pipeline over documents: every stage reads what the stage before it wrote.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Every stage works on all rows that it is
given and bears nulls in any column, empty and very long texts, repeated rows, columns of any other name and an empty table:
null and empty texts score as texts without matches, are near duplicates of nothing, have no contamination and no personal
data, and are packed as the end id alone; of rows that share a doc_id the join keeps one; a null doc_id is an id of
its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, packing, pii, toxicity
from tessera.llm.common import table, vocabulary, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is in benchmark passages go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; workers keep little, as they live on in the next stage."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), cache=200_000)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

#: Learned scores, tokens and the field's spans are beyond SQL; tests hold run() against the stages worked out row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
