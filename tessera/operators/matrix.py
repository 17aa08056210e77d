"""Evidence matrices in long form: A(query, row, ind, val), I(query, ind, hyp, val), phi(query, ind, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diagnosticity(influence: DataFrame) -> DataFrame:
    """Share of each indicator's variance over hypotheses; even shares where nothing varies."""
    var = influence.groupBy("query_id", "ind").agg(F.var_pop("val").alias("v"))
    w = W.partitionBy("query_id")
    return var.select("query_id", "ind", F.when(F.sum("v").over(w) < 1e-10, 1 / F.count("*").over(w)).otherwise(F.col("v") / F.sum("v").over(w)).alias("d"))


def with_absence(presence: DataFrame, phi: DataFrame) -> DataFrame:
    """A row more for each query (-1): how far each indicator is absent from the background."""
    return presence.unionByName(phi.select("query_id", F.lit(-1).alias("row"), "ind", (1 - F.col("val")).alias("val")))


def aggregate(presence: DataFrame, influence: DataFrame, weighted: bool = True) -> DataFrame:
    """query_id, hyp, score (mean over rows of A diag(d) I), prob (softmax), rank."""
    n = presence.groupBy("query_id").agg(F.countDistinct("row").alias("n_rows"))
    column = presence.groupBy("query_id", "ind").agg(F.sum("val").alias("a"))  # rows add up before the join
    joined = column.join(influence.withColumnRenamed("val", "i"), ["query_id", "ind"])
    if weighted:
        joined = joined.join(diagnosticity(influence), ["query_id", "ind"])
    else:
        joined = joined.withColumn("d", F.lit(1.0))
    scores = joined.groupBy("query_id", "hyp").agg(F.sum(F.col("a") * F.col("d") * F.col("i")).alias("s")).join(n, "query_id").select("query_id", "hyp", (F.col("s") / F.col("n_rows")).alias("score"))
    w = W.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("e", e).select("query_id", "hyp", "score", (F.col("e") / F.sum("e").over(w)).alias("prob"), F.row_number().over(w.orderBy(F.desc("score"), "hyp")).alias("rank"))


def swap_top(ranking: DataFrame, contested: str) -> DataFrame:
    """Ranks 1 and 2 change places where a query is contested."""
    return ranking.withColumn("rank", F.when(F.col(contested) & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank")))
