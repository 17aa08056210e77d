"""Ordered aggregates, modes, top-k, samples and distributions; ties are always broken by a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def pinned_top_k(df: DataFrame, by: Sequence[str], pinned: Column, pinned_order: Column, order: Sequence[Column], k: int) -> DataFrame:
    """Pinned rows first and never cut, in their own order; others fill up to k."""
    w = W.partitionBy(*by).orderBy(pinned.desc(), F.when(pinned, pinned_order).asc_nulls_last(), *order)
    return df.withColumn("rank", F.row_number().over(w)).filter(pinned | (F.col("rank") <= k))


def mode_first(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group (of equals the one seen first), its share, and the group's size."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_c"), F.col("_o"))).alias("mode"), F.max("_c").alias("mode_count"), F.sum("_c").alias("n"))


def plurality(df: DataFrame, by: Sequence[str], pick: str, hypotheses: Sequence[str], every: bool = False) -> DataFrame:
    """The choice with most votes, of equals the earlier hypothesis; votes for anything else don't count. Groups without a vote are left out, or with `every` have no choice."""
    counts = (df if every else df.filter(F.col(pick).isin(*hypotheses))).groupBy(*by).agg(*(F.count_if(F.col(pick) == h).alias(f"_v{i}") for i, h in enumerate(hypotheses)))
    votes = F.array(*(F.col(f"_v{i}") for i in range(len(hypotheses))))
    choice = F.when(F.array_max(votes) > 0, F.element_at(F.array(*map(F.lit, hypotheses)), F.array_position(votes, F.array_max(votes)).cast("int")))
    return counts.select(*by, choice.alias("choice"), F.aggregate(votes, F.lit(0).cast("long"), lambda s, v: s + v).alias("votes"))


def _counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A row for each group and value, with how many rows have it and how many of the group's have a smaller one: no group is ever sorted row by row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    return counts.withColumn("_below", F.coalesce(below, F.lit(0)))


def gini(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Of non-negative values; 0 for an empty sum."""
    v, c = F.col(value), F.col("_c")
    n, total = F.sum(c), F.sum(v * c)
    weighed = F.sum(v * (c * F.col("_below") + c * (c + 1) / 2))  # the sum of rank times value
    return _counted(df, by, value).groupBy(*by).agg(F.when(total == 0, 0.0).otherwise(2 * weighed / (n * total) - (n + 1) / n).alias("gini"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """The value at position floor(q n) of the sorted group."""
    rows = _counted(df, by, value).withColumn("_at", F.floor(F.sum("_c").over(W.partitionBy(*by)) * q))
    return rows.filter((F.col("_at") >= F.col("_below")) & (F.col("_at") < F.col("_below") + F.col("_c"))).select(*by, F.col(value).alias(name))


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """'<e' for the first edge above the value, '>=last' beyond."""
    out = F
    for e in edges:
        out = out.when(value < e, f"<{e}")
    return out.otherwise(f">={edges[-1]}")


def first_seen_ids(df: DataFrame, value: str, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """value and a dense id by first appearance.

    Values are dealt to ranges of their first appearance and numbered within them; the ranges' offsets, a row for each, are added.
    """
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    sorted_ = first.repartitionByRange("_first", value).sortWithinPartitions("_first", value)
    rows = written(sorted_.select(value, F.monotonically_increasing_id().alias("_n")), "numbered")
    part = F.shiftright("_n", 33)  # the upper bits are the range, the lower ones the place in it
    sizes = rows.groupBy(part.alias("_range")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), part == F.col("_range")).select(value, (F.col("_before") + F.col("_n").bitwiseAND((1 << 33) - 1) + start).alias(name))


def stratified_sample(df: DataFrame, strata: Sequence[str], ident: str, quota: int, seed: str = "") -> DataFrame:
    """Up to `quota` rows of each stratum in the order of a hash of id and seed."""
    return top_k(df, strata, [F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed)).cast("binary")), F.col(ident)], quota)
