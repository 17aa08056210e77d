"""Near-duplicate vectors by a forest of random-projection trees.

Each label's vectors are split again and again by a random direction at the median of a sample; vectors within
`spill` of a split go to both sides, so that near pairs seldom part. Over many trees vectors are compared within
leaves only, by cosine in double precision. The trees are fit on at most `sample` vectors (the first
by a hash of the id); every vector is put into leaves, whether sampled or not.

Equal vectors are one representative with a weight, so copies cost one comparison. A leaf larger than `block`
(a dense cluster that no split parts) is compared block against block in tasks of their own; nothing in it is
left out. A pair counts only in the first of its common leaves, so leaves give sums of links for each vector and a
spanning forest of their links, never lists of pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with null labels,
link with nothing; vectors of different lengths are not compared; each row of a repeated id is a vector;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import scratch, written


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.93
    trees: int = 6
    leaf: int = 256
    spill: float = 0.02
    sample: int = 40_000
    block: int = 2_000
    seed: int = 7


#: A node is (direction, threshold, left, right); a leaf is its number.
Node = tuple | int


def _grow(x: np.ndarray, size: float, f: Forest, rng: np.random.Generator, leaves: list[int]) -> Node:
    """x: the sample in this node; size: how many vectors of the whole are expected here."""
    if size > f.leaf and len(x) >= 3:
        for _ in range(3):  # another direction, if most vectors would go to both sides
            d = rng.standard_normal(x.shape[1])
            d /= np.linalg.norm(d)
            p = x @ d
            t = float(np.median(p))
            left, right = p <= t + f.spill, p > t - f.spill
            if max(left.mean(), right.mean()) <= 0.8:
                return d, t, _grow(x[left], size * left.mean(), f, rng, leaves), _grow(x[right], size * right.mean(), f, rng, leaves)
    leaves[0] += 1
    return leaves[0] - 1


def _descend(node: Node, x: np.ndarray, rows: np.ndarray, spill: float, out: list[tuple[np.ndarray, int]]) -> None:
    if isinstance(node, int):
        out.append((rows, node))
        return
    d, t, left, right = node
    p = x[rows] @ d
    for side, mask in ((left, p <= t + spill), (right, p > t - spill)):
        if mask.any():
            _descend(side, x, rows[mask], spill, out)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of one dimension as doubles."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, group (label and length; null for vectors that link with nothing), embedding."""
    e = F.col("embedding").cast("array<float>")
    sound = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.concat_ws(":", F.col("label").cast("string"), F.size(e))).alias("group"), e.alias("embedding"))


def fit(reps: DataFrame, f: Forest) -> dict[str, list[Node]]:
    """Trees for each group that is larger than a leaf and has enough of the sample."""
    total = dict(reps.groupBy("group").count().filter(F.col("count") > f.leaf).orderBy(F.desc("count"), "group").limit(f.sample).collect())
    rows = reps.orderBy(F.xxhash64("vec_id", F.lit(f.seed)), "vec_id").limit(f.sample).select("group", "embedding").toArrow()
    by: dict[str, list] = {}
    for g, e in zip(rows.column("group").to_pylist(), rows.column("embedding").to_pylist(), strict=True):
        if g in total:
            by.setdefault(g, []).append(e)
    out = {}
    for k, g in enumerate(sorted(by)):
        x = _unit(np.array(by[g], np.float64))
        out[g] = [_grow(x, float(total[g]), f, np.random.default_rng([f.seed, k, t]), [0]) for t in range(f.trees)]
    return out


def _leaves(stream: Iterator[pa.RecordBatch], forest: dict[str, list[Node]], f: Forest) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Batches of one group with the leaves of each row, as tree << 20 | leaf."""
    for whole in stream:
        groups = np.array(whole.column("group").to_pylist(), dtype=object)
        for g in dict.fromkeys(groups):
            batch = whole.take(pa.array(np.flatnonzero(groups == g)))
            codes: list[list[int]] = [[] for _ in range(batch.num_rows)]
            if g not in forest:
                codes = [[0] for _ in codes]
            else:
                x = _unit(_matrix(batch))
                for t, tree in enumerate(forest[g]):
                    found: list[tuple[np.ndarray, int]] = []
                    _descend(tree, x, np.arange(len(x)), f.spill, found)
                    for rows, leaf in found:
                        for r in rows.tolist():
                            codes[r].append(t << 20 | leaf)
            yield batch, codes


def _earlier(codes: list[list[int]], here: int) -> np.ndarray:
    """For each row, as bits, the leaves before `here` that it shares with another row."""
    flat = np.array([c for row in codes for c in row], np.int64)
    rows = np.repeat(np.arange(len(codes)), [len(row) for row in codes])
    before = flat < here
    _, which, size = np.unique(flat[before], return_inverse=True, return_counts=True)
    number = np.cumsum(size > 1) - 1
    shared = size[which] > 1
    out = np.zeros((len(codes), int((size > 1).sum())), bool)
    out[rows[before][shared], number[which[shared]]] = True
    return out


def _new(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hits of rows by columns that have no common leaf before: by products of the bits where hits are dense, else one by one."""
    if not left.shape[1] or not hit.any():
        return hit
    out, rows, columns = hit.copy(), np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if 8 * hit.sum() > len(rows) * len(columns):
        a, b = left[rows], right[columns]
        both = a.any(axis=0) & b.any(axis=0)
        out[np.ix_(rows, columns)] &= (a[:, both].astype(np.float32) @ b[:, both].T.astype(np.float32)) == 0
        return out
    a, b = np.packbits(left, axis=1), np.packbits(right, axis=1)
    i, j = np.nonzero(hit)
    step = max(1, (8 << 20) // a.shape[1])
    for s in range(0, len(i), step):
        x, y = i[s : s + step], j[s : s + step]
        out[x, y] = ~(a[x] & b[y]).any(axis=1)
    return out


def compare(x: np.ndarray, keys: np.ndarray, weight: np.ndarray, codes: list[list[int]], side: np.ndarray, here: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links found for each row (by weight of the others), and each row's smallest key that its links here lead to."""
    norm, bits, mass = np.linalg.norm(x, axis=1), _earlier(codes, here), weight.astype(np.float64)
    left, right = (np.flatnonzero(side <= 0), np.flatnonzero(side >= 0))
    same = len(left) == len(x)  # one block against itself
    links, found = np.zeros(len(x)), []
    for s in range(0, len(left), 512):
        part = left[s : s + 512]
        hit = (x[part] @ x[right].T) / np.outer(norm[part], norm[right]) >= threshold
        if same:
            hit &= keys[part][:, None] < keys[right]
        if not hit.any():
            continue
        new = _new(hit, bits[part], bits[right]).astype(np.float64)
        links[part] += new @ mass[right]
        links[right] += mass[part] @ new
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        found.append((part[rows], right[columns], np.packbits(hit[np.ix_(rows, columns)], axis=1)))
    root, far = keys.copy(), np.iinfo(np.int64).max
    while found:
        before = root.copy()
        for i, j, packed in found:
            hit = np.unpackbits(packed, axis=1, count=len(j)).view(bool)
            root[i] = np.minimum(root[i], np.where(hit, root[j], far).min(axis=1))
            root[j] = np.minimum(root[j], np.where(hit, root[i][:, None], far).min(axis=0))
        if (root == before).all():
            break
    return np.rint(links).astype(np.int64), root


def near_duplicates(table: DataFrame, f: Forest = Forest()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table."""
    with scratch() as keep:
        rows, known = vectors(table), keep(_linked(vectors(table), f))
    out = rows.withColumn("h", F.xxhash64("embedding")).join(known, ["group", "h", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _linked(rows: DataFrame, f: Forest) -> DataFrame:
    """group, h, embedding, n_links, component_id: one row for each different vector."""
    spark = rows.sparkSession
    sound = rows.filter("group is not null").withColumn("h", F.xxhash64("embedding"))
    reps = sound.groupBy("group", "h", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    # ids may repeat, so each different vector has a key of its own
    reps = written(reps.withColumn("key", F.monotonically_increasing_id()), "vectors")
    forest = spark.sparkContext.broadcast(fit(reps, f))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in _leaves(stream, forest.value, f):
            sizes: dict[int, int] = {}
            for c in codes:
                for leaf in c:
                    sizes[leaf] = sizes.get(leaf, 0) + 1
            g = batch.column("group")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(sizes)), pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["group", "leaf", "size"])

    sizes = reps.select("group", "embedding").mapInArrow(count, "group string, leaf long, size long").groupBy("group", "leaf").agg(F.sum("size").alias("size"))
    # leaves over a block are few: at most (trees times the spilled rows) / block, taken largest first within the bound
    large = spark.sparkContext.broadcast({(r["group"], r["leaf"]): -(-r["size"] * 2 // f.block) for r in sizes.filter(F.col("size") > f.block).toLocalIterator()})

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in _leaves(stream, forest.value, f):
            g = batch.column("group")[0].as_py()
            take, leaf, x, y, side = [], [], [], [], []
            for r, (c, v) in enumerate(zip(codes, batch.column("key").to_pylist(), strict=True)):
                for k in c:
                    blocks = large.value.get((g, k), 1)
                    mine = (v * 0x9E3779B97F4A7C15 >> 17) % blocks
                    for other in range(blocks):
                        take.append(r)
                        leaf.append(k)
                        x.append(min(mine, other))
                        y.append(max(mine, other))
                        side.append(0 if mine == other else -1 if mine < other else 1)
            for s in range(0, len(take), 8192):
                cut = slice(s, s + 8192)
                part = batch.take(pa.array(take[cut], pa.int64()))
                arrays = [pa.array([g] * part.num_rows), *(pa.array(v[cut], pa.int64()) for v in (leaf, x, y, side)), part.column("key"), part.column("weight"), part.column("embedding"), pa.array([codes[r] for r in take[cut]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["group", "leaf", "x", "y", "side", "key", "weight", "embedding", "codes"])

    def leaf(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        keys, weight, side = (batch.column(c).to_numpy() for c in ("key", "weight", "side"))
        links, root = compare(_matrix(batch), keys, weight, batch.column("codes").to_pylist(), side, batch.column("leaf")[0].as_py(), f.threshold)
        hit = (links > 0) | (root != keys)
        return pa.table({"key": pa.array(keys[hit]), "links": pa.array(links[hit]), "root": pa.array(root[hit])})

    dealt = reps.select("group", "key", "weight", "embedding").mapInArrow(deal, "group string, leaf long, x long, y long, side long, key long, weight long, embedding array<float>, codes array<long>")
    found = written(dealt.groupBy("group", "leaf", "x", "y").applyInArrow(leaf, "key long, links long, root long"), "links")
    sums = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    least = labels.join(reps.select("key", "vec_id"), "key").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = reps.join(sums, "key", "left").join(labels, "key", "left").join(least, "component", "left")
    return written(known.select("group", "h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "known")
