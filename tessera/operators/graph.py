"""Connected components and cluster representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import read_from, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """From columns a and b: node, component (the smallest node reachable); only nodes that have edges.

    Every node joins its smallest neighbour, edges move to what was joined, until none is left. Rounds are few, and
    every table is written, so lineage stays short and joins on a hub can be split.
    """
    with scratch() as keep:
        return keep(_labels(edges))


def _labels(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    e = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, first = spark.createDataFrame([], f"node {kind}, component {kind}"), True
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).union(e.select("b", "a"))
        parent = written(both.groupBy("node").agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("p")), "parents")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "grandparents")
        if first:
            labels, first = read_from(parent.withColumnRenamed("p", "component"), *parent.written_to), False
        else:
            step = parent.select(F.col("node").alias("component"), "p")
            labels = written(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        e = written(e.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels


def canonical(members: DataFrame, cluster: str, ident: str, order: Sequence[Column]) -> DataFrame:
    """canonical_id of each member, its place in the cluster, and the cluster's size."""
    w = W.partitionBy(cluster)
    ranked = members.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("cluster_size", F.count("*").over(w))
    heads = ranked.filter("place = 1").select(cluster, F.col(ident).alias("canonical_id"))
    return ranked.join(heads, cluster)
