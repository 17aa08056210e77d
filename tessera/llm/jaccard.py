"""N-gram Jaccard self-join with prefix filters under several global orders of the shingles.

In any global order, two sets with Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each. The prefixes of all orders are dealt, and a pair is compared only if the shingles it shares
among the prefixes of every order, one order after another, still allow that similarity. All orders place
frequent shingles last: shingles of many documents are counted over the whole corpus, and the commonest of them (a
bounded number, which sets the orders and never drops a pair) are broadcast.

Equal sets are one representative. A prefix shingle with few representatives gives all their pairs; one with
many gives the pairs with a pivot, and its members are kept. Two members whose places in their prefixes leave too few shingles
for a link (what stands before a first common shingle is not shared) are no pair, so members that differ from all others by
too much leave the group. What is not in one class after the pairs with pivots gets other pivots for some rounds, and
then whatever pairs across classes are left, so no link between classes is lost. A group of copies of a text costs
as many comparisons as it has members; one of copies that are all about as far from each other as the threshold, and have no
member in the middle, costs more.

A shingle's rows of one task are met by a pivot in that task where they are many (more than `hot`), and only the pivot
goes on to the bucket, so that a shingle of a third of all documents is never gathered.

Defined results: null texts and texts without words have an empty set, linked with nothing; with fewer words than a
shingle the whole text is one; rows of one doc_id share its links; null doc_ids count as one document that comes before
all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import components
from . import buckets, hashing
from .common import FEW, NONE, ids, partitions, pick, pieces, runs_of, scratch, texts, trimmed, written

#: A shingle of this many documents is frequent; so many of the most frequent are told apart, 8 bytes each.
FREQUENT, TOLD_APART = 16, 1_000_000
#: Up to so many members a prefix shingle gives all pairs.
SMALL = 16
#: Rounds with other pivots before the rest is paired.
ROUNDS = 2
#: Sets told apart by a task, so that it deals equal ones once; then it starts anew.
SEEN = 200_000
#: Bytes of text that are hashed at once.
BATCH = 256 << 10


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least num / den, on shingles of k words; orders: how many prefix filters a pair must pass.

    hot: with more rows of a shingle than this, a task lets them meet their pivot itself.
    """

    num: int = 75
    den: int = 100
    k: int = 5
    orders: int = 3
    hot: int = 256

    def prefix(self, n):
        return n - -(-n * self.num // self.den) + 1

    def rest(self, n):
        """How many shingles of a set of n lie beyond its prefix."""
        return n - self.prefix(n)

    def least(self, n, m):
        """What two sets must share, times den + num."""
        return self.num * (n + m)

    def holds(self, both: int, n: int, m: int) -> bool:
        return self.den * both >= self.num * (n + m - both)


def _sums(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of the hashes of each set, which tell sets apart."""
    out = []
    for seed in (101, 102):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashing.mix(hashes, seed), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).astype(np.int64))
    return out[0], out[1]


class Orders:
    """Global orders of shingles: order 0 by their hash, others by another mix of it; frequent ones last in each."""

    def __init__(self, frequent: np.ndarray, n_buckets: int):
        self.frequent, self.n_buckets = frequent, np.uint64(n_buckets)

    def key(self, tokens: np.ndarray) -> np.ndarray:
        """What buckets know of a shingle: bucket and token."""
        return ((tokens >> np.uint64(32)) % self.n_buckets) << np.uint64(32) | (tokens & np.uint64(0xFFFFFFFF))

    def late(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(tokens), bool)
        key = self.key(tokens)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)] == key

    def prefixes(self, tokens: np.ndarray, at: np.ndarray, size: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first `size` of each set in an order: tokens, the number of their set, and their places."""
        which = np.repeat(np.arange(len(at) - 1), np.diff(at))
        rank = which * 2 + self.late(tokens)
        by = np.lexsort((hashing.mix(tokens, order), rank)) if order else np.argsort(rank, kind="stable")
        place = np.arange(len(tokens)) - at[which]
        chosen = place < size[which]
        return tokens[by][chosen], which[chosen], place[chosen]


def _scan(docs: DataFrame, sim: Similarity) -> DataFrame:
    """One row for each document (doc_id, n, s1, s2: the set's size and two sums of its hashes), and all shingles dealt."""
    n_buckets = buckets.count(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("runs", pa.binary()), *((c, pa.int64()) for c in ("doc_id", "n", "s1", "s2"))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = buckets.Dealer(n_buckets)

        def dealt() -> Iterator[pa.RecordBatch]:
            for b in dealer.counted():
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(1, pa.int64())] * 4], schema=schema)

        for whole in stream:
            for b in pieces(whole, "text", BATCH):
                tokens, at = hashing.sets(b.column("text").to_pylist(), sim.k, lower=True)
                if dealer.add(tokens):
                    yield from dealt()
                yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary()), *(pa.array(c, pa.int64()) for c in (ids(b), np.diff(at), *_sums(tokens, at)))], schema=schema)
        yield from dealt()

    return docs.mapInArrow(trimmed(run), "bucket long, runs binary, doc_id long, n long, s1 long, s2 long")


def _frequent(dealt: DataFrame) -> np.ndarray:
    """Keys of the most frequent shingles: at most TOLD_APART numbers."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        parts = [buckets.unpack(x, "<u4", "<u4") for x in table.column("runs").to_pylist()]
        tokens, n = np.concatenate([np.cumsum(x, dtype=np.uint64).astype(np.uint32) for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, n = tokens[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        n, tokens = np.add.reduceat(n, new), tokens[new].astype(np.int64) | key[0].as_py() << 32
        return pa.table({"key": tokens[n >= FREQUENT], "n": n[n >= FREQUENT]})

    top = dealt.groupBy("bucket").applyInArrow(work, "key long, n long").orderBy(F.desc("n"), "key").limit(TOLD_APART)
    return np.sort(np.array([r[0] for r in top.select("key").toLocalIterator()], dtype=np.uint64))


KINDS = ("<i8", "<u4", "<u4")  # of a prefix shingle: its document, the set's size, how many shingles stand before it
SETTLED = np.uint32(1 << 31)  # in a set's size: the shingle's other rows of the task have met this one
#: What a row of the candidates holds: pairs with counts by order, members of groups, counts of grouped shingles by order, shingles.
PAIRS, MEMBERS, OPEN, DEALT = range(4)


def _candidates(docs: DataFrame, sim: Similarity, frequent) -> DataFrame:
    """kind, bucket, runs: packed PAIRS (a, b, shared prefix shingles by order), MEMBERS (group, a, n, before) of groups of the
    first order of which only pairs with pivots are given, and for every order how many shingles of a document are in such groups (OPEN)."""
    n_buckets, orders = buckets.count(docs.sparkSession), sim.orders
    n_cells = max(1, partitions(docs.sparkSession) // 4)  # fewer than buckets, as every bucket deals to every cell

    def packed(kind: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array([b for b, _ in blobs], pa.int64()), pa.array([x for _, x in blobs], pa.binary())], ["kind", "bucket", "runs"])

    def paired(order: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = a[a != b], b[a != b]
        counts = [np.full(len(a), int(k == order), "<i8") for k in range(orders)]
        for x in _merge(n_cells, a, b, counts):
            yield packed(PAIRS, list(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)))

    def met(order: int, group: np.ndarray, doc: np.ndarray, n: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Members of large groups: in the first order they are kept; their shingles count as open in every order."""
        if len(group):
            if not order:
                place = int(doc[0]) % n_buckets
                yield packed(MEMBERS, [(place, buckets.pack(group.astype("<i8"), doc.astype("<i8"), n.astype("<i8"), before.astype("<i8")))])
            own, size = np.unique(doc.astype("<i8"), return_counts=True)
            dealer = buckets.Dealer(n_cells)
            dealer.add(hashing.mix(own.view(np.uint64), 1), own, *(size.astype("<i8") * int(k == order) for k in range(orders)))
            for x in dealer.rows():
                yield packed(OPEN, list(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)))

    def pivots(key: np.ndarray, columns: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by key, then by the share of what stands before, then by document; where keys begin; which rows are of large groups.

        The first of a group has the largest share of frequent shingles: of near copies that is what they are copies of.
        """
        doc, n, before = columns
        by = np.lexsort((doc, before / np.maximum(n, 1), key))
        new = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(key) else np.zeros(0, int)
        size = np.diff(np.r_[new, len(key)])
        return by, new, np.repeat(size > most, size)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealers, places, seen = [buckets.Dealer(n_buckets, 400_000) for _ in range(orders)], Orders(frequent.value, n_buckets), set()

        def dealt(k: int) -> Iterator[pa.RecordBatch]:
            if not dealers[k].held:
                return
            key, columns = dealers[k].sorted()
            by, new, many = pivots(key, columns, sim.hot)
            if many.any():
                key, columns = key[by], [c[by] for c in columns]
                lead = np.repeat(new, np.diff(np.r_[new, len(key)]))
                yield from paired(k, columns[0][lead][many], columns[0][many])
                # the pivot goes on as a member of the group that the bucket sees, so it is one there only
                rest = many & (lead != np.arange(len(key)))
                yield from met(k, key[rest].astype("<i8"), *(c[rest] for c in columns))
                columns[1] = np.where(many, columns[1] | SETTLED, columns[1])
                key, columns = key[~rest], [c[~rest] for c in columns]
            for x in dealers[k].packed(key, columns):
                yield packed(DEALT, [(k * n_buckets + x.column(0)[0].as_py(), x.column(1)[0].as_py())])

        for whole in stream:
            for b in pieces(whole, "text", BATCH):
                tokens, at = hashing.sets(b.column("text").to_pylist(), sim.k, lower=True)
                n, doc = np.diff(at), np.array(ids(b), "<i8")
                fresh = np.ones(len(n), bool)
                for i, same in enumerate(zip(n.tolist(), *(x.tolist() for x in _sums(tokens, at)), strict=True)):
                    fresh[i] = same not in seen  # an equal set has been dealt by this task; equal sets are joined elsewhere
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(same)
                for k, dealer in enumerate(dealers):
                    p, which, place = places.prefixes(tokens, at, np.where(fresh & (n > 0), sim.prefix(n), 0), k)
                    if dealer.add(hashing.mix(p, 50 + k) if k else p, doc[which], n[which].astype("<u4"), place.astype("<u4")):
                        yield from dealt(k)
        for k in range(orders):
            yield from dealt(k)

    def pair(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        out = [b for b in table.select(["kind", "bucket", "runs"]).filter(pa.array([k != DEALT for k in kinds])).to_batches() if b.num_rows]
        blobs = [x for k, x in zip(kinds, table.column("runs").to_pylist(), strict=True) if k == DEALT]
        if blobs:
            parts = [(np.cumsum(step, dtype=np.uint64), *columns) for step, *columns in (buckets.unpack(x, "<u4", *KINDS) for x in blobs)]
            tokens, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
            settled, columns[1] = columns[1] >= SETTLED, columns[1] & (SETTLED - np.uint32(1))
            by, new, many = pivots(tokens, columns, SMALL)
            # a group of which a task has settled a part is a large one, however few of it are here
            many |= np.repeat(np.logical_or.reduceat(settled[by], new), np.diff(np.r_[new, len(tokens)]))
            tokens, (doc, n, before) = tokens[by], [c[by] for c in columns]
            order = key[0].as_py() // n_buckets
            a, b = [], []
            for k in range(1, SMALL):
                same = np.flatnonzero((tokens[k:] == tokens[:-k]) & ~many[k:])
                a.append(doc[same])
                b.append(doc[same + k])
            lead = np.repeat(new, np.diff(np.r_[new, len(tokens)]))
            out += paired(order, np.concatenate([*a, doc[lead][many]]), np.concatenate([*b, doc[many]]))
            group = tokens.astype("<i8") | (key[0].as_py() % n_buckets) << 32
            out += met(order, group[many], doc[many], n[many], before[many])
        return pa.Table.from_batches(out, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("runs", pa.binary())]))

    return docs.mapInArrow(trimmed(deal), "kind int, bucket long, runs binary").groupBy("bucket").applyInArrow(pair, "kind int, bucket long, runs binary")


def _spread(found: DataFrame, kind: int, columns: str) -> DataFrame:
    """The packed rows of a kind, as rows."""
    names = columns.split(", ")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in buckets.unpack(blob, *["<i8"] * len(names))], names)

    return found.filter(F.col("kind") == kind).select("runs").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in names))


def _merge(n_cells: int, a: np.ndarray, b: np.ndarray, counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums for each pair, dealt by it."""
    if len(a):
        a, b = np.minimum(a, b), np.maximum(a, b)
        order, edge = runs_of(a, b)
        dealer = buckets.Dealer(n_cells)
        a, b, counts = a[order][edge], b[order][edge], [np.add.reduceat(n[order], edge) for n in counts]
        dealer.add(hashing.mix(a.view(np.uint64), 1) ^ hashing.mix(b.view(np.uint64), 2), a, b, *counts)
        yield from dealer.rows()


def _summed(found: DataFrame, kind: int, keys: list[str], counts: list[str]) -> DataFrame:
    """The counts of a kind, summed where they are packed: one row for each key, however many buckets have counted it."""
    names = [*keys, *counts]

    def total(_, *columns) -> Iterator[pa.RecordBatch]:
        own, counted = columns[: len(keys)], columns[len(keys) :]
        order, edge = runs_of(*own)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*(c[order][edge] for c in own), *(np.add.reduceat(n[order], edge) for n in counted))], names)

    return buckets.groups(found.filter(F.col("kind") == kind).select("bucket", "runs"), ("<i8",) * len(names), total, ", ".join(f"{c} long" for c in names))


def _compare(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """a, b, linked for pairs of representatives that the filters of all orders have passed, by their whole sets."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in pieces(whole, "tb"):
                linked, last, t = [], None, None
                for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                    if x != last:
                        last, t = x, np.frombuffer(x, "<u8")
                    u = np.frombuffer(y, "<u8")
                    linked.append(sim.holds(len(np.intersect1d(t, u, assume_unique=True)), len(t), len(u)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long, linked boolean")


def _sets(docs: DataFrame, pairs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, tokens of the documents in pairs."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in pieces(whole, "text", BATCH):
                tokens, at = hashing.sets(b.column("text").to_pylist(), sim.k, lower=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([tokens[x:y].astype("<u8").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "tokens"])

    return pick(docs, wanted, "left_semi").mapInArrow(trimmed(run), "doc_id long, tokens binary")


def join(docs: DataFrame, sim: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, representative, component_id: one row for each input row) and tested pairs (a, b, linked)."""
    with scratch() as keep:
        nodes, labels, tested = _classes(texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NONE))), sim)
        keep(nodes), keep(labels), keep(tested)
    out = nodes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    null = lambda c: F.when(c != NONE, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.col("rep")).alias("representative"), null(F.coalesce("component", "rep")).alias("component_id")), tested


def _classes(docs: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their representatives, the classes of linked representatives, and the pairs that were tested."""
    both, orders = sim.den + sim.num, range(sim.orders)
    scanned = written(_scan(docs, sim), "scan")
    rows = scanned.filter("bucket is null").select("doc_id", "n", "s1", "s2")
    same = written(rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "equal-sets")
    nodes = written(rows.join(same, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "nodes")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(scanned.filter("bucket is not null").select("bucket", "runs")))
    found = written(_candidates(docs, sim, frequent), "candidates")
    # how many prefix shingles of a document are, by order, in groups whose pairs were not all counted
    open_ = _summed(found, OPEN, ["doc_id"], [f"o{k}" for k in orders])
    known = written(nodes.join(open_, "doc_id", "left").na.fill(0, [f"o{k}" for k in orders]), "known")

    def represented(t: DataFrame, column: str) -> DataFrame:
        """The column's documents by their representatives, with n_<column> and o0_<column> and so on."""
        own = known.select(F.col("doc_id").alias(column), F.col("rep").alias(f"r_{column}"), F.col("n").alias(f"n_{column}"), *(F.col(f"o{k}").alias(f"o{k}_{column}") for k in orders))
        return t.join(own, column).drop(column).withColumnRenamed(f"r_{column}", column)

    def rest(n: Column) -> Column:
        return F.ceil(n * sim.num / sim.den) - 1

    def passes(shared: list[Column]) -> Column:
        """Sizes and the prefixes of every order allow a link; at most min(open) of the shared shingles were not counted."""
        n, m = F.col("n_a"), F.col("n_b")
        out = (F.col("a") != F.col("b")) & (F.least(n, m) * sim.den >= F.greatest(n, m) * sim.num)
        for k, s in zip(orders, shared, strict=True):
            most = s + F.least(f"o{k}_a", f"o{k}_b")
            out &= (most > 0) & ((most + F.greatest(rest(n), rest(m))) * both >= sim.least(n, m))
        return out

    def ordered(t: DataFrame) -> DataFrame:
        return t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # a, b, s0, s1 and so on: how many shingles the pair was seen to share among its prefixes, by order
    pairs = represented(represented(_summed(found, PAIRS, ["a", "b"], [f"s{k}" for k in orders]), "a"), "b").filter(passes([F.col(f"s{k}") for k in orders]))
    pairs = written(ordered(pairs), "pairs")
    members = represented(_spread(found, MEMBERS, "group, a, n, before").drop("n"), "a")
    members = members.groupBy("group", "a").agg(*(F.max(c).alias(c) for c in ("n_a", "before", *(f"o{k}_a" for k in orders))))
    # the largest partner that a member's place leaves room for
    members = written(members.withColumn("room_a", F.floor((F.col("n_a") - F.col("before")) * both / sim.num) - F.col("n_a")).drop("before"), "members")
    bounds = members.groupBy("group").agg(F.min("n_a").alias("low"), F.max("room_a").alias("room"))
    members = written(members.join(bounds, "group").filter("room_a >= low and n_a <= room").drop("low", "room"), "members")
    sets = written(_sets(docs, pairs.union(members.select("a", F.col("a").alias("b"))), sim), "sets")
    tested = written(_compare(pairs, sets, sim), "tested")
    labels = components(tested.filter("linked").select("a", "b"))
    own = ["n_a", "room_a", *(f"o{k}_a" for k in orders)]
    for k in range(ROUNDS + 1):
        placed = members.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        other = [F.col(c).alias(d) for c, d in (("a", "b"), ("component", "cb"), *((c, f"{c[:-1]}b") for c in own))]
        middle = F.struct((-F.col("o0_a") / F.col("n_a")).alias("own"), F.xxhash64("a", F.lit(k)), *other)
        sizes = placed.groupBy("group", "component").agg(F.count("*").alias("n"), F.min(middle).alias("pivot"))
        # the first round takes the member in the middle, later ones that of the second largest class, and so on
        by = F.struct(F.col("n").alias("n"), F.col("component").alias("c"))
        open_ = sizes.groupBy("group").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(by).alias("main"), F.min("pivot").alias("pivot")).filter("c0 < c1")
        if k:
            open_ = sizes.join(open_.select("group", "main.c"), "group").filter("component <> c").groupBy("group").agg(F.max(F.struct("n", F.xxhash64("component", F.lit(k)), "pivot")).alias("m")).select("group", F.col("m.pivot").alias("pivot"))
        open_ = written(open_.select("group", "pivot"), "open")
        if open_.isEmpty():
            break
        if k < ROUNDS:
            pivot = open_.select("group", *(f"pivot.{c}" for c in ("b", "cb", *(f"{c[:-1]}b" for c in own))))
            more = placed.join(pivot, (placed["group"] == pivot["group"]) & (placed["component"] != pivot["cb"])).drop(pivot["group"])
        else:
            left = written(placed.join(open_.select("group"), "group"), "rest")
            right = left.select(F.col("group").alias("g"), *other)
            more = left.join(right, (F.col("group") == F.col("g")) & (F.col("component") < F.col("cb")) & (F.col("n_b") <= F.col("room_a")) & (F.col("n_a") <= F.col("room_b")) & (F.least("n_a", "n_b") * sim.den >= F.greatest("n_a", "n_b") * sim.num))
        more = ordered(more.filter(passes([F.lit(0)] * sim.orders) & (F.col("n_b") <= F.col("room_a")) & (F.col("n_a") <= F.col("room_b")))).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = written(more, "more")
        if more.isEmpty():
            continue
        more = written(_compare(more, sets, sim), "tested")
        if not more.filter("linked").isEmpty():
            labels = components(tested.unionByName(more).filter("linked").select("a", "b"))
        tested = written(tested.unionByName(more), "tested")
    return nodes, labels, tested


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The documents, with all their columns, that are the first of their class; of rows that share an id, one."""
    with scratch() as kept:
        member = kept(written(join(docs, sim)[0].select("doc_id", "component_id"), "members"))
    keep = member.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NONE)).alias("kept_id"))
    repeated = keep.groupBy("kept_id").count().filter("count > 1").drop("count")
    keep, repeated = written(keep.distinct(), "keep"), written(repeated, "repeated")
    mark = F.coalesce(docs["doc_id"].cast("long"), F.lit(NONE))
    small = keep.count() <= FEW
    out = docs.join(F.broadcast(keep) if small else keep, mark == F.col("kept_id"), "left_semi")
    if repeated.isEmpty():
        return out
    doubled = out.join(repeated, mark == F.col("kept_id"), "left_semi")
    first = W.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`") for c in docs.columns))
    return out.join(repeated, mark == F.col("kept_id"), "left_anti").unionByName(doubled.withColumn("nth_row", F.row_number().over(first)).filter("nth_row = 1").drop("nth_row"))
