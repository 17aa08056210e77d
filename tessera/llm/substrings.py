"""Substring dedup: words of passages that already start in a document with a smaller id are removed.

Documents are streamed through suffix automata of reference shards. At every word the matching statistics give
the longest run of words that ends there and occurs in the shard; where it has `length` words or more
and one of its occurrences is in a document with a smaller id, the words of the run are removed, which
yields maximal spans. States carry the smallest document of their occurrences, so one pass decides.

A shard must not meet every document, or the work grows with the square of the corpus. Reference text is
therefore what others repeat: hashed runs of `length` words are dealt to buckets, and each bucket names, for a
document, the first document of each run and where both lie. Reference pieces (bounded in words) are dealt to
shards of bounded size, and the parts of documents in question to copies of the shard, as many as they need,
so a passage that a third of all documents share is only matched by more tasks. Where many of a task's documents have one run
(more than `HOT`), they are referred to the first of them in the task, and only that one goes on to the bucket: any
document with a smaller id will do, so a hot run is neither gathered in one bucket nor copied from one document. The hashes
merely route: what is removed is decided on words, in the automata.

Defined results: null and empty texts have no words; rows of one doc_id are one document, each row with its own
text; null doc_ids come before all others (as the smallest) and never lose words; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, hashing
from .common import NONE, batches, ids, partitions, pick, pieces, runs_of, scratch, texts, written

BLOCK = 128  # positions are kept to so many words
PIECE = 256 * BLOCK  # words of a reference piece
SHARD = 48  # reference pieces of a shard, on average
STREAM = 512  # documents that one copy of a shard is meant for; a piece with more of them is a shard of its own
HOT = 64  # documents of a task with one run, beyond which they are referred to the first of them there


class SuffixAutomaton:
    """Of several sequences of words; each state knows the smallest document in which its runs end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 63]
        self.ids: dict[bytes, int] = {}

    def _state(self, length: int, follows: dict[int, int], link: int, first: int) -> int:
        self.next.append(follows)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def add(self, words: list[bytes], doc: int) -> None:
        last, ids = 0, self.ids
        for w in words:
            last = self._extend(last, ids.setdefault(w, len(ids)), doc)

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the runs that end here only as suffixes."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, doc: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            at = self._split(last, known, c)
            self.first[at] = min(self.first[at], doc)
            return at
        new, p = self._state(self.length[last] + 1, {}, 0, doc), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def close(self, length: int) -> None:
        """For each state: the smallest document with its run's last `length` words."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        first, link, size = self.first, self.link, self.length
        for s in reversed(order[1:]):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]
        for s in order[1:]:
            if size[link[s]] >= length:
                first[s] = first[link[s]]

    def spans(self, words: list[bytes], doc: int, length: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by runs of `length` or more that a smaller document has."""
        follow, link, size, first, ids = self.next, self.link, self.length, self.first, self.ids
        out: list[tuple[int, int]] = []
        v = n = 0
        for i, w in enumerate(words):
            c = ids.get(w)
            if c is None:
                v = n = 0
                continue
            while v and c not in follow[v]:
                v = link[v]
                n = size[v]
            if c in follow[v]:
                v = follow[v][c]
                n += 1
                if n >= length and first[v] < doc:
                    a = i + 1 - length
                    if out and a <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((a, i + 1))
        return out


def _key(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=12).digest()


def repeats(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """d, f, piece, b0, b1: document d has runs, in its blocks b0 to b1, that start first in document f, in its piece."""
    n_buckets = buckets.count(docs.sparkSession)
    n_cells = max(1, partitions(docs.sparkSession) // 4)  # fewer than buckets, as every bucket deals to every cell
    part = max(1, length // 2 - 1)

    def placed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs; the upper half, which gives the bucket, is the least hash of a part of the run.

        Neighbouring runs mostly share it, so a passage meets in few buckets, and equal runs always in one.
        Then the upper half of the runs' own hashes, which tells apart runs with one token.
        """
        whole, parts = hashing.runs(words, length), hashing.runs(words, part)
        if not len(whole):
            return whole, whole.astype("<u4")
        least = np.lib.stride_tricks.sliding_window_view(parts, length - part + 1).min(axis=1)
        least = hashing.mix(least)  # the least of several is far from even
        return (least & np.uint64(0xFFFFFFFF00000000)) | (whole & np.uint64(0xFFFFFFFF)), (whole >> np.uint64(32)).astype("<u4")

    arrow = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("runs", pa.binary())])

    def dealt(dealer: buckets.Dealer) -> Iterator[pa.RecordBatch]:
        """Rows for buckets, and such as are settled here, with the cell that they are for."""
        if not dealer.held:
            return
        key, (check, doc, block) = dealer.sorted()
        order = np.lexsort((block, doc, check, key))
        key, check, doc, block = key[order], check[order], doc[order], block[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        size = np.diff(np.r_[new, len(key)])
        lead = np.repeat(new, size)
        settled = np.repeat(size > hot, size) & (doc > doc[lead])
        own = block[settled].astype("<i8")
        for b in merge(doc[settled], doc[lead][settled], (block[lead][settled] // (PIECE // BLOCK)).astype("<i8"), own, own):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(1)], schema=arrow)
        for b in dealer.packed(key[~settled], [x[~settled] for x in (check, doc, block)]):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.int64()), b.column(1)], schema=arrow)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = buckets.Dealer(n_buckets)
        for whole in stream:
            for b in pieces(whole, "text"):
                for doc, text in zip(ids(b), b.column("text").to_pylist(), strict=True):
                    h, check = placed(hashing.words(text, lower=False))
                    if dealer.add(h, check, np.full(len(h), doc, "<i8"), (np.arange(len(h)) // BLOCK).astype("<u4")):
                        yield from dealt(dealer)
        yield from dealt(dealer)

    def name(table: pa.Table) -> pa.Table:
        open_ = pc.is_null(table.column("cell"))
        out = [pa.RecordBatch.from_arrays([b.column("cell"), b.column("runs")], ["bucket", "runs"]) for b in table.filter(pc.invert(open_)).to_batches()]
        if blobs := table.filter(open_).column("runs").to_pylist():
            parts = [(np.cumsum(step, dtype=np.uint64).astype(np.uint32), *columns) for step, *columns in (buckets.unpack(x, "<u4", "<u4", "<i8", "<u4") for x in blobs)]
            out += first(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.Table.from_batches(out, schema=pa.schema([("bucket", pa.int64()), ("runs", pa.binary())]))

    def first(tokens: np.ndarray, check: np.ndarray, doc: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = tokens.astype(np.uint64) << np.uint64(32) | check
        order = np.argsort(run)
        run, doc, block = run[order], doc[order], block[order]
        new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(run)]))
        least = np.minimum.reduceat(doc, new)
        again = doc > least[group]
        # the first document may have the run in several pieces; one of them is enough
        where = np.where(doc == least[group], block, np.uint32(0xFFFFFFFF))
        piece = np.minimum.reduceat(where, new) // np.uint32(PIECE // BLOCK)
        d, f, p, b = doc[again], least[group][again], piece[group][again].astype("<i8"), block[again].astype("<i8")
        yield from merge(d, f, p, b, b)

    def merge(d, f, p, low, high) -> Iterator[pa.RecordBatch]:
        """One row for each (d, f, p), dealt anew by it."""
        if len(d):
            order, edge = runs_of(d, f, p)
            d, f, p = (x[order][edge] for x in (d, f, p))
            dealer = buckets.Dealer(n_cells)
            with np.errstate(over="ignore"):
                key = hashing.mix(d.view(np.uint64), 1) ^ hashing.mix(f.view(np.uint64), 2) ^ hashing.mix(p.view(np.uint64), 3)
            dealer.add(key, d, f, p, np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge))
            yield from dealer.rows()

    def total(_, d, f, p, low, high) -> Iterator[pa.RecordBatch]:
        order, edge = runs_of(d, f, p)
        columns = (*(x[order][edge] for x in (d, f, p)), np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["d", "f", "piece", "b0", "b1"])

    named = docs.mapInArrow(deal, "bucket long, cell long, runs binary").groupBy("bucket").applyInArrow(name, "bucket long, runs binary")
    return buckets.groups(named, ("<i8",) * 5, total, "d long, f long, piece long, b0 long, b1 long")


def spans(docs: DataFrame, *, length: int = 13, hot: int = HOT) -> DataFrame:
    """doc_id, key (of the text), spans: maximal spans of words (first, past the last) to remove."""
    spark = docs.sparkSession
    docs = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NONE)))
    pairs = written(repeats(docs, length, hot), "repeats")
    pieces_of = written(pairs.groupBy("f", "piece").agg(F.count("*").alias("n")), "pieces")
    n_shards = max(1, -(-pieces_of.filter(F.col("n") <= STREAM).count() // SHARD))
    own = F.xxhash64("f", "piece")
    pairs = pairs.join(pieces_of, ["f", "piece"]).withColumn("shard", F.when(F.col("n") > STREAM, own).otherwise(F.pmod(own, F.lit(n_shards))))
    stream = pairs.groupBy("shard", "d").agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    copies = stream.groupBy("shard").agg(F.ceil(F.count("*") / STREAM).alias("copies"))
    routes = stream.join(copies, "shard").select(F.col("d").alias("doc_id"), F.struct("shard", F.pmod(F.xxhash64("d"), F.col("copies")).alias("copy"), F.lit(1).alias("kind"), (F.col("b0") * BLOCK).alias("a"), ((F.col("b1") + 1) * BLOCK + length - 1).alias("b")).alias("r"))
    refs = pairs.select("shard", "f", "piece").distinct().join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    refs = refs.select(F.col("f").alias("doc_id"), F.struct("shard", "copy", F.lit(0).alias("kind"), (F.col("piece") * PIECE).alias("a"), ((F.col("piece") + 1) * PIECE + length - 1).alias("b")).alias("r"))
    routes = written(routes.unionByName(refs).groupBy("doc_id").agg(F.collect_list("r").alias("routes")), "routes")
    cut_schema = pa.schema([("shard", pa.int64()), ("copy", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.binary()), ("a", pa.int64()), ("text", pa.binary())])

    def cut(batch_stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch_stream:
            for b in pieces(whole, "text"):
                rows = []
                for r in b.to_pylist():
                    words, key = hashing.words(r["text"], lower=False), _key(r["text"])
                    rows += [{"shard": x["shard"], "copy": x["copy"], "kind": x["kind"], "doc_id": r["doc_id"], "key": key, "a": x["a"], "text": b" ".join(words[x["a"] : x["b"]])} for x in r["routes"] if x["a"] < len(words)]
                    if len(rows) >= 1024:
                        yield from batches(rows, cut_schema)
                        rows = []
                yield from batches(rows, cut_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def match(batch_stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, closed = None, SuffixAutomaton(), False
        for whole in batch_stream:
            rows = []
            for r in whole.to_pylist():
                if (r["shard"], r["copy"]) != now:
                    now, machine, closed = (r["shard"], r["copy"]), SuffixAutomaton(), False
                if r["kind"] == 0:
                    machine.add(r["text"].split(), r["doc_id"])
                    continue
                if not closed:
                    machine.close(length)
                    closed = True
                if found := machine.spans(r["text"].split(), r["doc_id"], length):
                    rows.append({"doc_id": r["doc_id"], "key": r["key"], "a": [r["a"] + x for x, _ in found], "b": [r["a"] + y for _, y in found]})
            yield from batches(rows, out_schema)

    parts = pick(docs, routes, "inner").mapInArrow(cut, "shard long, copy long, kind int, doc_id long, key binary, a long, text binary")
    dealt = parts.repartition(partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    found = dealt.mapInArrow(match, "doc_id long, key binary, a array<long>, b array<long>")
    return found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list(F.arrays_zip("a", "b"))).alias("spans"))


def dedup(docs: DataFrame, *, length: int = 13, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that are left, joined by one space."""
    plain = texts(docs)
    keyed = plain.withColumn("doc_id", F.coalesce("doc_id", F.lit(NONE)))
    with scratch() as keep:
        removed = spans(docs, length=length, hot=hot).groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("texts"))
        removed = keep(written(removed, "removed"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def keep(batch_stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch_stream:
            for b in pieces(whole, "text", 4 << 20):
                rows = []
                for r in b.to_pylist():
                    words = hashing.words(r["text"], lower=False)
                    stay = np.ones(len(words), bool)
                    if r.get("texts"):
                        key = _key(r["text"])
                        for x in r["texts"]:
                            for s in x["spans"] if x["key"] == key else ():
                                stay[s["a"] : s["b"]] = False
                    kept = b" ".join(words if stay.all() else [w for w, k in zip(words, stay.tolist(), strict=True) if k])
                    rows.append({"doc_id": None if r["doc_id"] == NONE else r["doc_id"], "n_words": len(words), "n_removed": int((~stay).sum()), "kept": kept.decode("utf-8", "surrogatepass")})
                yield from batches(rows, schema)

    return pick(keyed, removed, "left").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
