"""Token counts from an exact histogram of encoded lengths.

The corpus is encoded once and reduced to (length, documents). Suffix sums over that histogram then answer
totals, quantiles and totals under truncation for every context limit, exactly and without another scan.
The sums run in two levels (blocks of lengths, then lengths within a block), so no task needs all lengths.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives an
empty histogram and null quantiles; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, texts, written
from .tokens import encoder

BLOCK = 1024


def histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        size = enc.dtype.itemsize
        for whole in stream:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode(t)) // size for t in batch.column(1).to_pylist()], pa.int64())], ["n_tokens"])

    # written, as what is asked of a histogram reads it more than once
    return written(texts(docs).mapInArrow(run, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens of at least it, and the corpus's tokens if truncated to it."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    above = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"), F.sum("t").over(W.partitionBy()).alias("all_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    at_least = (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_at_least")
    tokens_at_least = (F.sum(F.col("n_tokens") * F.col("n_docs")).over(inside) + F.col("t_above")).alias("tokens_at_least")
    out = h.join(above, "block").select("n_tokens", "n_docs", at_least, tokens_at_least, "all_tokens")
    return out.withColumn("truncated_tokens", F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, total_tokens: what is left of the corpus under a context limit; null for an empty histogram."""
    over = sums.filter(F.col("n_tokens") >= limit).agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t"))
    everything = sums.agg(F.max("all_tokens").alias("a"))
    return over.join(everything).select((F.col("a") - F.coalesce("t", F.lit(0)) + limit * F.coalesce("d", F.lit(0))).alias("total_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length that at least a share q of the documents does not exceed."""
    total = sums.agg(F.max("docs_at_least").alias("n"))
    below = F.col("n") - F.col("docs_at_least") + F.col("n_docs")
    return sums.join(total).filter(below >= F.ceil(q * F.col("n"))).agg(F.min("n_tokens").alias("n_tokens"))
