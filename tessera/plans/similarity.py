"""Vectors and shingles: nearest items, blended relevance, day bands, clusters, overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import texts, vectors
from ..operators import graph, ranking, similarity
from .registry import query, table

_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))))"


@query(f"""SELECT query_id, item, round(s, 4) AS similarity, rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item, {_DOT} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 12) DESC, i.vec_id) AS rank
 FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """A stated query set (every fiftieth id) against all rows."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return similarity.cosine_top_k(e, q, 10).select("query_id", "item", F.round("similarity", 4).alias("similarity"), "rank")


@query(f"""WITH c AS (SELECT q.vec_id AS query_id, i.vec_id AS item, (q.vec_id - i.vec_id) % 90 AS age, {_DOT} AS s FROM embeddings q JOIN embeddings i ON i.vec_id < q.vec_id AND i.label = q.label AND q.vec_id % 25 = 0),
 r AS (SELECT query_id, item, round(0.3 * (1 - age / 60) + 0.7 * s, 6) AS score, item % 97 = 0 AS pinned FROM c WHERE age <= 60 AND s >= 0.05 OR item % 97 = 0)
 SELECT query_id, item, rank FROM (SELECT query_id, item, pinned, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, CASE WHEN pinned THEN item END, score DESC, item DESC) AS rank FROM r) WHERE pinned OR rank <= 8""")
def relevance_blend_topk(spark, sf_dir):
    """Recency and similarity blended; links that were there stay in front and are never cut."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    q, i = e.filter("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "item")

    def blended(s, q, i):
        age = (q["query_id"] - i["item"]) % 90
        ok = (q["label"] == i["label"]) & (i["item"] < q["query_id"]) & (age <= 60) & (s >= 0.05) & (i["item"] % 97 != 0)
        return np.where(ok, 0.3 * (1 - age / 60) + 0.7 * s, -np.inf)

    pinned = q.select("query_id", "label").join(i.filter("item % 97 = 0").select("item", "label"), "label").filter("item < query_id").select("query_id", "item", F.lit(0.0).alias("score"), F.lit(True).alias("pinned"))
    c = similarity.block_top_k(i, q, 8, blended, digits=6, last_first=True).select("query_id", "item", "score", F.lit(False).alias("pinned")).unionByName(pinned)
    return ranking.pinned_top_k(c, ["query_id"], F.col("pinned"), F.col("item"), [F.desc("score"), F.desc("item")], 8).select("query_id", "item", "rank")


_RELATED = f"""c AS (SELECT q.vec_id AS query_id, i.vec_id AS item, (q.vec_id - i.vec_id) AS age, {_DOT} AS s, q.vec_id % 2 AS source FROM embeddings q JOIN embeddings i ON q.vec_id % 100 = 0 AND i.vec_id < q.vec_id),
 k AS (SELECT query_id, item, round(CASE source WHEN 0 THEN 0.3 ELSE 0.5 END * (1 - age / 400) + (1 - CASE source WHEN 0 THEN 0.3 ELSE 0.5 END) * s, 6) AS score FROM c WHERE age <= 400 AND s >= 0.02 AND (item % 3 = query_id % 3 OR item % 4 = query_id // 100 % 4) AND (source = 0 OR item % 5 = query_id // 100 % 5)),
 o AS (SELECT DISTINCT q.vec_id AS query_id, q.vec_id * x % 977 AS item, x AS place FROM embeddings q, (SELECT unnest([3, 7]) AS x) WHERE q.vec_id % 100 = 0 AND q.vec_id * x % 977 > 0),
 f AS (SELECT query_id, item, min(place) AS place, NULL AS score FROM o GROUP BY ALL UNION ALL SELECT query_id, item, NULL, score FROM k WHERE (query_id, item) NOT IN (SELECT (query_id, item) FROM o))"""


@query(f"WITH {_RELATED} SELECT query_id, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, score DESC, item DESC) AS rank FROM f) WHERE place IS NOT NULL OR rank <= 6")
def relevance_links(spark, sf_dir):
    """Links that a question has stay in their order; the most relevant others fill up to six, under the conditions and weights of the question's source: age, similarity, shared terms and shared actors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", (F.col("vec_id") % 2).alias("source"))
    original = q.select("query_id", F.explode(F.array(F.lit(3), F.lit(7))).alias("place")).withColumn("item", F.col("query_id") * F.col("place") % 977).filter("item > 0").groupBy("query_id", "item").agg(F.min("place").alias("place"))
    weight = (0.3, 0.5)  # of recency, by source

    def relevant(s, q, i):
        age, w = q["query_id"] - i["item"], np.where(q["source"] == 0, *weight)
        terms = (i["item"] % 3 == q["query_id"] % 3).astype(int) + (i["item"] % 4 == q["query_id"] // 100 % 4)
        actors = i["item"] % 5 == q["query_id"] // 100 % 5
        ok = (age > 0) & (age <= 400) & (s >= 0.02) & (terms >= 1) & ((q["source"] == 0) | actors)
        return np.where(ok, w * (1 - age / 400) + (1 - w) * s, -np.inf)

    # originals take places of their own, so six and as many as there are originals are enough
    c = similarity.block_top_k(e.withColumnRenamed("vec_id", "item"), q, 8, relevant, digits=6, last_first=True).select("query_id", "item", "score")
    c = c.join(original.select("query_id", "item"), ["query_id", "item"], "left_anti").select("query_id", "item", "score", F.lit(None).cast("int").alias("place"))
    both = c.unionByName(original.select("query_id", "item", F.lit(None).cast("double").alias("score"), "place"))
    return ranking.pinned_top_k(both, ["query_id"], F.col("place").isNotNull(), F.col("place"), [F.desc("score"), F.desc("item")], 6).select("query_id", "item", "rank")


@query(f"""SELECT query_id, item, rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 12) DESC, i.vec_id) AS rank
 FROM embeddings q JOIN embeddings i ON q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id AND i.vec_id // 100 % 12 BETWEEN q.vec_id // 100 % 12 - 2 AND q.vec_id // 100 % 12) WHERE rank <= 5""")
def month_shards_topk(spark, sf_dir):
    """The nearest items over the monthly shards that meet the question's window, pooled."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), (F.floor(F.col("vec_id") / 100) % 12).alias("month"))

    def in_window(s, q, i):
        return np.where((i["item"] != q["query_id"]) & (i["month"] >= q["month"] - 2) & (i["month"] <= q["month"]), s, -np.inf)

    return similarity.block_top_k(e.withColumnRenamed("vec_id", "item"), e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5, in_window).select("query_id", "item", "rank")


_BAND = """v AS (SELECT vec_id, label, CASE WHEN vec_id % 11 <> 0 THEN DATE '2026-01-01' + CAST(vec_id % 60 AS INT) END AS day, embedding FROM embeddings),
 pairs AS (SELECT q.vec_id AS a, i.vec_id AS b FROM v q JOIN v i ON q.vec_id < i.vec_id AND abs(q.day - i.day) <= 3 AND {dot} >= 0.3)""".replace("{dot}", _DOT)


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("day", F.when(F.col("vec_id") % 11 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("vec_id") % 60).cast("int"))))


def _banded(spark, sf_dir):
    return similarity.banded_pairs(_dated(spark, sf_dir), 3, 0.3)


@query(f"WITH {_BAND} SELECT a, b FROM pairs")
def banded_knn_pairs(spark, sf_dir):
    """Similar pairs within three days, by products of blocks of neighbouring days."""
    return _banded(spark, sf_dir).select("a", "b")


@query(f"""WITH {_BAND}, d AS (SELECT q.vec_id AS x, i.vec_id AS y, round({_DOT}, 12) AS s FROM v q JOIN v i ON q.vec_id <> i.vec_id AND abs(q.day - i.day) <= 3 AND {_DOT} >= 0.3), t AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS n FROM d) WHERE n <= 2)
 SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM t""")
def banded_nearest(spark, sf_dir):
    """The two nearest of each item within three days, as pairs."""
    return similarity.banded_top_k(_dated(spark, sf_dir), 3, 0.3, 2).select("a", "b")


@query(f"""WITH RECURSIVE {_BAND}, n AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.c),
 k AS (SELECT node, min(c) AS cluster FROM r GROUP BY 1)
 SELECT node AS vec_id, cluster, arg_min(node, (-label, node)) OVER (PARTITION BY cluster) AS canonical_id, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM k JOIN v ON vec_id = node""")
def dup_clusters(spark, sf_dir):
    """Clusters chain over pairs; their canonical member has the highest rank, then the smallest id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    c = graph.components(_banded(spark, sf_dir).select("a", "b")).withColumnRenamed("node", "vec_id")
    m = e.join(c, "vec_id", "left").withColumn("cluster", F.coalesce("component", "vec_id"))
    return graph.canonical(m, "cluster", "vec_id", [F.desc("label"), F.col("vec_id")]).select("vec_id", "cluster", "canonical_id", "cluster_size")


_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_-]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9-]+') AND length(x) > 2 AND x NOT IN ('will', 'the', 'a', 'of', 'to', 'in', 'on', 'for', 'at', 'by', 'an', 'from', 'and', 'or', 'when', 'with', 'which', 'be', 'is', 'are', 'was', 'were', 'have', 'has', 'had', 'that', 'this'))"


@query(f"""WITH d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), b AS (SELECT item_id, unnest({_GRAMS}) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))
 SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY ALL HAVING count(*) >= 5""")
def bigram_overlap_join(spark, sf_dir):
    """Documents of every language and passages with five common bigrams of content words."""
    return _bigram_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _bigram_overlap(documents, items):
    d = documents.select("doc_id", texts.ngrams(F.col("text")).alias("g"))
    b = items.select("item_id", texts.ngrams(F.col("text")).alias("g"))
    return similarity.set_overlap(d, b, "doc_id", "item_id", "g").filter("shared >= 5").select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"), "shared")


@query("""WITH s AS (SELECT p_name AS name, list_distinct(list_transform(range(1, length(p_name) - 3), lambda i: substr(lower(p_name), i, 5))) AS g, count(*) AS copies FROM part GROUP BY p_name),
 j AS (SELECT a.name AS a, b.name AS b, a.copies * b.copies AS pairs, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS n FROM s a JOIN s b ON a.name < b.name)
 SELECT a, b, round(c / (n - c), 6) AS jaccard, pairs FROM j WHERE c / (n - c) >= 0.4""")
def char_shingle_jaccard(spark, sf_dir):
    """Different names that are nearly equal, by runs of five characters, and how many pairs of parts they stand for."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("copies")).withColumn("g", texts.shingles(F.col("name")))
    j, n = similarity.set_join(names, "name", "g", 40, 100), names.select("name", "copies")
    j = j.join(n.withColumnsRenamed({"name": "a", "copies": "ca"}), "a").join(n.withColumnsRenamed({"name": "b", "copies": "cb"}), "b")
    return j.select("a", "b", F.round("jaccard", 6).alias("jaccard"), (F.col("ca") * F.col("cb")).alias("pairs"))


@query(f"""WITH c AS (SELECT q.vec_id AS query_id, i.vec_id AS item, {_DOT} AS s FROM embeddings q JOIN embeddings i ON i.vec_id <> q.vec_id AND q.vec_id % 100 = 0),
 d AS (SELECT query_id, item, round(s * exp(-0.02 * abs(query_id - item) / 10.0), 6) AS score FROM c) SELECT query_id, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM d) WHERE rank <= 5""")
def time_decay_topk(spark, sf_dir):
    """Similarity with exponential decay in time."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))

    def decayed(s, q, i):
        return np.where(i["item"] != q["query_id"], s * np.exp(-0.02 * np.abs(q["query_id"] - i["item"]) / 10.0), -np.inf)

    return similarity.block_top_k(e.withColumnRenamed("vec_id", "item"), e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5, decayed, digits=6).select("query_id", "item", "rank")


def _greedy(score: str) -> str:
    """Re-ranking of the twenty best by a score to eight, in SQL."""
    return f"""WITH RECURSIVE c AS (SELECT q.vec_id AS q, i.vec_id AS i, i.embedding AS e, {score} AS s FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) <= 20),
 n AS (SELECT q.q AS q, q.i AS a, i.i AS b, {_DOT.replace("embedding", "e")} AS near FROM t q JOIN t i ON q.q = i.q),
 r AS (SELECT q, 1 AS place, i AS item, [i] AS chosen FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) = 1
  UNION ALL SELECT q, place + 1, pick, list_append(chosen, pick) FROM (SELECT r.q, r.place, r.chosen, arg_max(x.i, (round(0.7 * x.s - 0.3 * x.near, 9), x.s, -x.i)) AS pick
   FROM r JOIN (SELECT r.q, t.i, any_value(t.s) AS s, max(n.near) AS near FROM r JOIN t ON t.q = r.q AND NOT list_contains(r.chosen, t.i) JOIN n ON n.q = t.q AND n.a = t.i AND list_contains(r.chosen, n.b) GROUP BY ALL) x ON x.q = r.q WHERE r.place < 8 GROUP BY ALL))
 SELECT q AS query_id, item, place FROM r"""


@query(_greedy(f"round((0.6 * {_DOT} + 0.4 * CASE WHEN i.vec_id % 7 = q.vec_id % 7 THEN 1 ELSE 0 END) * exp(-0.01 * abs(q.vec_id - i.vec_id) / 10.0), 9)"))
def hybrid_search(spark, sf_dir):
    """Similarity and shared terms in one score that decays in time, then re-ranked for variety."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))

    def hybrid(s, q, i):
        return (0.6 * s + 0.4 * (i["item"] % 7 == q["query_id"] % 7)) * np.exp(-0.01 * np.abs(q["query_id"] - i["item"]) / 10.0)

    top = similarity.block_top_k(e.withColumnRenamed("vec_id", "item"), e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 20, hybrid, digits=9)
    return similarity.mmr(top.join(e.withColumnRenamed("vec_id", "item"), "item"), "query_id", "item", "score", "vector", 8)


@query(_greedy(f"round({_DOT}, 12)"))
def mmr_rerank(spark, sf_dir):
    """Twenty nearest of each query, re-ranked to eight by relevance less likeness to what is chosen."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = similarity.cosine_top_k(e, q, 20).join(e.select(F.col("vec_id").alias("item"), "embedding"), "item")
    return similarity.mmr(top, "query_id", "item", "similarity", "embedding", 8)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS first FROM embeddings""")
def unit_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.unit(F.col("embedding"))[0], 5).alias("first"))
