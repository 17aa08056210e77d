"""Merging of records that share an id, in the order of sources and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_merge(df: DataFrame, key: str, order: str, text: str, carried: list[str], filled: list[str], united: list[str], kept: list[str] = ()) -> DataFrame:
    """One record for each key.

    The longest text wins (the earliest of equals) and brings the `carried` columns; `filled` columns take their first
    non-empty value; `united` arrays become sorted unions; `kept` columns are the first record's.
    """
    longest = F.struct(F.length(text), -F.col(order))

    def first_non_empty(c: str) -> Column:
        return F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))), F.lit("")).alias(c)

    return df.groupBy(key).agg(
        *(F.max_by(c, longest).alias(c) for c in (text, *carried)),
        *(first_non_empty(c) for c in filled),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in united),
        *(F.min_by(c, order).alias(c) for c in kept),
        F.count("*").alias("n_records"),
    )
