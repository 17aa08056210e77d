"""Vector and set similarity: top-k against queries, pairs within day bands, shingle joins, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Bytes of query vectors that one broadcast may hold; more queries are searched in blocks of this size.
BROADCAST = 32 << 20


def cosine_top_k(items: DataFrame, queries: DataFrame, k: int, item_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, item, similarity, rank: the k nearest items of each query, exactly."""
    found = block_top_k(items.select(F.col(item_id).alias("item"), F.col(vector).alias("vector")), queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")), k, lambda s, q, i: s)
    return found.withColumnRenamed("score", "similarity")


#: Scores that a task holds at once.
CELLS = 4_000_000


def block_top_k(items: DataFrame, queries: DataFrame, k: int, score: Callable, digits: int = 12, last_first: bool = False) -> DataFrame:
    """query_id, item, score, rank: the k best items of each query by score(similarities, queries, items), exactly.

    items has the columns item and vector, queries has query_id and vector, and both any numbers that the score takes, as arrays by
    name; -inf excludes a pair. Scores are compared to so many digits; of equals the smaller item comes first, or the larger.
    Every task keeps its own k best for each query, so what meets in the end is queries times tasks times k. Queries come in
    blocks of a checked size; items are scanned once for each block, in slices that bound queries times items, and never leave their task.
    """
    spark = items.sparkSession
    rows = queries.select("query_id", "vector", *(c for c in queries.columns if c not in ("query_id", "vector"))).toLocalIterator()
    blocks: list[list] = [[]]
    size = 0
    for r in rows:
        n = 8 * (len(r[1] or ()) + len(r))
        if size + n > BROADCAST and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(tuple(r))
        size += n
    names = [c for c in queries.columns if c not in ("query_id", "vector")]
    items = items.select(F.col("item").cast("long"), "vector", *(c for c in items.columns if c not in ("item", "vector")))
    sign, out = -1 if last_first else 1, None
    for block in blocks:
        columns = {c: np.array([r[j + 2] for r in block]) for j, c in enumerate(names)}
        held = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), _units([r[1] for r in block]), columns))

        def search(stream: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, own = held.value
            own = {"query_id": ids, **own}
            best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for whole in stream:
                step = max(1, CELLS // max(1, len(ids)))
                for at in range(0, whole.num_rows if len(ids) else 0, step):
                    b = whole.slice(at, step)
                    item = b.column(0).to_numpy()
                    other = {"item": item, **{c: b.column(j).to_numpy(zero_copy_only=False) for j, c in enumerate(b.schema.names) if j > 1}}
                    s = score(q @ _units(b.column(1).to_pylist()).T, {c: v[:, None] for c, v in own.items()}, {c: v[None, :] for c, v in other.items()})
                    s = np.concatenate([best_s, np.round(s, digits)], axis=1)
                    i = np.concatenate([best_i, np.broadcast_to(item, (len(ids), len(item)))], axis=1)
                    if s.shape[1] > k:
                        order = np.lexsort((sign * i, -s), axis=1)[:, :k]
                        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                    best_s, best_i = s, i
            there = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best_s.shape)[there], pa.int64()), pa.array(best_i[there], pa.int64()), pa.array(best_s[there], pa.float64())], ["query_id", "item", "score"])

        part = items.mapInArrow(search, "query_id long, item long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["query_id"], [F.col("score").desc(), F.col("item").desc() if last_first else F.col("item")], k)


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def banded_pairs(items: DataFrame, width: int, threshold: float, ident: str = "vec_id", day: str = "day", vector: str = "embedding") -> DataFrame:
    """a < b within `width` days of each other and a cosine of at least the threshold; undated items pair with nothing."""
    return _banded(items, width, threshold, None, ident, day, vector)


def banded_top_k(items: DataFrame, width: int, threshold: float, k: int, ident: str = "vec_id", day: str = "day", vector: str = "embedding") -> DataFrame:
    """a < b where one is among the k nearest of the other within `width` days, with a cosine of at least the threshold."""
    near = top_k(_banded(items, width, threshold, k, ident, day, vector), ["a"], [F.col("similarity").desc(), F.col("b")], k)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def _banded(items: DataFrame, width: int, threshold: float, k: int | None, ident: str, day: str, vector: str, block: int = 2000) -> DataFrame:
    """a, b, similarity: pairs with a < b, or with k the k nearest b of each a in each block.

    Days fall into buckets of `width`, so partners lie in the same or a neighbouring bucket. A bucket and its neighbours are cut
    into blocks of about `block` items, and every two blocks meet in one product of matrices.
    """
    number = F.floor(F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")) / width)
    rows = items.filter(F.col(day).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col(vector).cast("array<float>").alias("v"), number.alias("own"))
    near = F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bucket")
    # a row for each bucket that has items
    parts = rows.select("own", near).groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = rows.withColumn("bucket", F.col("own")).join(F.broadcast(parts), "bucket").select("bucket", mine.alias("x"), others.alias("y"), F.lit(0).alias("side"), "id", "day", "v")
    right = rows.select("id", "day", "v", "own", near).join(F.broadcast(parts), "bucket").select("bucket", others.alias("x"), mine.alias("y"), F.lit(1).alias("side"), "id", "day", "v")

    def meet(table: pa.Table) -> pa.Table:
        side, ids, days = (table.column(c).to_numpy() for c in ("side", "id", "day"))
        u, (a, b) = _units(table.column("v").to_pylist()), (np.flatnonzero(side == s) for s in (0, 1))
        out: list[tuple] = []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            s = np.round(u[part] @ u[b].T, 12)
            hit = (s >= threshold) & (np.abs(days[part][:, None] - days[b]) <= width) & (ids[part][:, None] != ids[b])
            if k is None:
                hit &= ids[part][:, None] < ids[b]
            elif hit.shape[1] > k:
                first = np.lexsort((np.broadcast_to(ids[b], s.shape), -np.where(hit, s, -np.inf)), axis=1)[:, :k]
                chosen = np.zeros_like(hit)
                np.put_along_axis(chosen, first, True, 1)
                hit &= chosen
            i, j = np.nonzero(hit)
            out.append((ids[part[i]], ids[b[j]], s[i, j]))
        return pa.table({c: pa.array(np.concatenate([x[n] for x in out]) if out else [], t) for n, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    return left.unionByName(right).groupBy("bucket", "x", "y").applyInArrow(meet, "a long, b long, similarity double")


def set_overlap(sets: DataFrame, others: DataFrame, left_id: str, right_id: str, elements: str) -> DataFrame:
    """left, right, shared, jaccard for pairs with a common element, by an equi-join on elements."""
    a = sets.select(F.col(left_id).alias("left"), F.size(elements).alias("n"), F.explode(elements).alias("x"))
    b = others.select(F.col(right_id).alias("right"), F.size(elements).alias("m"), F.explode(elements).alias("x"))
    shared = a.join(b, "x").groupBy("left", "right", "n", "m").agg(F.count("*").alias("shared"))
    return shared.select("left", "right", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard"))


def set_join(sets: DataFrame, ident: str, elements: str, num: int, den: int) -> DataFrame:
    """a < b, jaccard for pairs of sets with a similarity of num / den or more.

    Elements are ordered by how many sets have them, rare ones first; similar sets share one among the first n - ceil(t n) + 1, so
    only these are joined, and whole sets are compared for the pairs that are found. Equal sets should be one row.
    """
    rows = sets.select(F.col(ident).alias("id"), F.array_distinct(elements).alias("e")).filter(F.size("e") > 0)
    often = rows.select(F.explode("e").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    each = rows.select("id", F.size("e").alias("n"), F.explode("e").alias("x")).join(often, "x")
    ranked = each.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    prefix = ranked.select("id", "n", F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1)).alias("p")).select("id", "n", "p.x")
    pairs = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "x").join(prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "x"), "x")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)).select("a", "b").distinct()
    both = pairs.join(rows.withColumnsRenamed({"id": "a", "e": "ea"}), "a").join(rows.withColumnsRenamed({"id": "b", "e": "eb"}), "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", (shared / (F.size("ea") + F.size("eb") - shared)).alias("jaccard")).filter(F.col("jaccard") * den >= num)


def mmr(cands: DataFrame, by: str, ident: str, score: str, vector: str, k: int, trade: float = 0.7) -> DataFrame:
    """Greedy re-ranking by relevance less similarity to what is chosen; candidates of a query are its bounded top list."""

    def rerank(table: pa.Table) -> pa.Table:
        s = table.column(score).to_numpy().astype(float)
        ids = table.column(ident).to_pylist()
        x = _units(table.column(vector).to_pylist())
        left, chosen, near = list(np.lexsort((ids, -s))), [], np.zeros(len(ids))
        while left and len(chosen) < k:
            gains = [round(trade * s[i] - (1 - trade) * near[i], 9) for i in left]
            i = left.pop(int(np.argmax(gains)))
            near = np.maximum(near, x @ x[i]) if chosen else x @ x[i]
            chosen.append(i)
        return pa.table({by: pa.array([table.column(by)[0].as_py()] * len(chosen), pa.int64()), ident: pa.array([ids[i] for i in chosen], pa.int64()), "place": pa.array(range(1, len(chosen) + 1), pa.int32())})

    return cands.select(F.col(by).cast("long"), F.col(ident).cast("long"), F.col(score).cast("double"), vector).groupBy(by).applyInArrow(rerank, f"{by} long, {ident} long, place int")
