"""Joins of questions with evidence: by id arrays, intervals, unordered pairs, text and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exploded(df: DataFrame, ids: str, *keep: str) -> DataFrame:
    """One row for each member of an id array, with its position from 0."""
    return df.select(*keep, F.posexplode(ids).alias("pos", "id"))


def collected(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The values of each group as an array in the order of a column."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))


def interval_top_k(left: DataFrame, right: DataFrame, on: Column, day: str, start: Column, stop: Column, by: list[str], order: list[Column], k: int) -> DataFrame:
    """For each left row the k first of the right rows that share its key and lie in its closed interval."""
    hit = left.join(right, on & F.col(day).between(start, stop))
    return hit.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def pair(a: Column, b: Column) -> Column:
    """One key for (a, b) and (b, a)."""
    return F.array_sort(F.array(a, b))


def mentions(articles: DataFrame, entities: DataFrame, article: str, text: str, entity: str, context: Sequence[str]) -> DataFrame:
    """Articles by entities (name in lower case, ticker) that they mention, each pair once: by the name anywhere, or by the ticker as a word where a word of the context is there too.

    Tickers are met by the words of a text and an equi-join; names by a broadcast of the entities, a dimension of which the caller knows the size.
    """
    a, b = [c for c in articles.columns if c != text], [c for c in entities.columns if c not in ("name", "ticker")]
    named = articles.join(F.broadcast(entities), F.contains(F.lower(text), F.col("name"))).select(*a, *b)
    words = articles.filter(F.lower(text).rlike("|".join(context))).withColumn("ticker", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]+\b"), F.lit(0)))))
    return named.unionByName(words.join(entities, "ticker").select(*a, *b)).dropDuplicates([article, entity])


def relinked(questions: DataFrame, ident: str, ids: str, articles: DataFrame, keep: Column) -> DataFrame:
    """The questions with their id array rewritten: ids of which `keep` holds (over the question's columns and the article's, null where there is none), in their order."""
    other = [c for c in questions.columns if c != ids]
    rows = questions.select(*other, F.posexplode_outer(ids).alias("pos", "id")).join(articles, "id", "left")
    hit = F.when(F.col("id").isNotNull() & F.coalesce(keep, F.lit(False)), F.struct("pos", "id"))
    links = rows.groupBy(ident).agg(F.transform(F.sort_array(F.array_compact(F.collect_list(hit))), lambda s: s["id"]).alias(ids))
    return questions.drop(ids).join(links, ident)


def resolved(resolutions: DataFrame, ident: str, settled: str, order: Sequence[Column]) -> DataFrame:
    """One resolution for each id: a settled one before others, then the last in the order."""
    from .ranking import keep_first

    return keep_first(resolutions, [ident], [F.col(settled).desc(), *order])
