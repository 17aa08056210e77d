"""Token ids in Arrow stream files of fixed-size-list batches.

Each shard is one Arrow IPC stream whose batches hold `ids` (fixed_size_list<uint16 or uint32>[length]) and
`mask` (fixed_size_list<bool>[length]); sequence k of a mapped shard is a slice of its buffers, no copy. A
second stream beside it has doc_id, local start and length of each document. Shards hold ascending
ranges of doc_id; the manifest (Parquet) has each shard's path, counts and the ids before it.

Ranges come from an approximate quantile of doc_id over the whole table, so the encoded ids are
shuffled once and texts never. A shard is written under its attempt's own name; only names in the committed
manifest count, so a lost executor leaves at most an unused file.

Defined results: null and empty texts are the end id alone; null doc_ids come first; rows that repeat a doc_id
stay in the order of their ids; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, partitions, pieces, shared_dir, texts
from .tokens import encoder

MANIFEST = "shard long, path string, sequence_length long, n_tokens long, n_docs long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """One shard: fixed-size-list batches of `rows` sequences; memory is one batch and its documents."""

    def __init__(self, folder: str, shard: int, length: int, dtype: np.dtype, rows: int = 512):
        self.shard, self.length, self.rows, self.dtype = shard, length, rows, dtype
        self.path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.arrows"
        where, path = _place(self.path)
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.files = kind, [where.open_output_stream(path), where.open_output_stream(path + ".docs")]
        self.ids, self.docs = pa.ipc.new_stream(self.files[0], self.schema), pa.ipc.new_stream(self.files[1], DOCS)
        self.held, self.n_held, self.n, self.index, self.n_docs = [], 0, 0, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append({"doc_id": doc_id, "start": self.n, "n_tokens": n})
        self.held.append(ids)
        self.n, self.n_held, self.n_docs = self.n + n, self.n_held + n, self.n_docs + 1
        if self.n_held >= self.rows * self.length:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        full = len(flat) // self.length * self.length
        rest = flat[full:]
        if last and len(rest):
            mask = np.arange(full + self.length) < len(flat)
            flat, full, rest = np.append(flat, np.zeros(full + self.length - len(flat), self.dtype)), full + self.length, rest[:0]
        else:
            mask = np.ones(full, bool)
        if full:
            self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x[:full], t), self.length) for x, t in ((flat, self.kind), (mask, pa.bool_()))], schema=self.schema))
        self.held, self.n_held = [rest.tobytes()], len(rest)
        for b in batches(self.index, DOCS, 1 << 16):
            self.docs.write_batch(b)
        self.index = []

    def close(self) -> dict:
        self._flush(last=True)
        for x in (self.ids, self.docs, *self.files):
            x.close()
        return {"shard": self.shard, "path": self.path, "sequence_length": self.length, "n_tokens": self.n, "n_docs": self.n_docs}


def open_sequences(path: str) -> tuple[pa.RecordBatchReader, bool]:
    """A shard's sequences; local files are memory-mapped, so batches are views of the file."""
    where, plain = _place(path)
    local = isinstance(where, fs.LocalFileSystem)
    return pa.ipc.open_stream(pa.memory_map(plain) if local else where.open_input_stream(plain)), local


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k of a shard: ids are a view of the mapped file where it is local."""
    for batch in open_sequences(path)[0]:
        if k < batch.num_rows:
            ids, mask = (batch.column(i).slice(k, 1).flatten() for i in (0, 1))
            return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)
        k -= batch.num_rows
    raise IndexError(k)


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, *, end_id: int = 2, sequence_length: int = 2048) -> DataFrame:
    """Encode the whole texts and write the shards; returns the manifest, with `base`: the ids of all shards before."""
    spark, docs = docs.sparkSession, texts(docs)
    folder = f"{folder or shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    where, path = _place(folder)
    where.create_dir(f"{path}/shards", recursive=True)
    n = partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col("doc_id") > cuts[0], 1).otherwise(0))) if len(cuts) <= 8 else F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: c < F.col("doc_id"))), F.lit(0))

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for whole in stream:
            for b in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([enc.encode(t) + end for t in b.column(2).to_pylist()], pa.binary())], ["shard", "doc_id", "ids"])

    def store(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, done = encoder(vocabulary), None, []
        for b in stream:
            for s, doc_id, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None or writer.shard != s:
                    done += [writer.close()] if writer else []
                    writer = ShardWriter(f"{folder}/shards", s, sequence_length, enc.dtype)
                writer.add(doc_id, ids)
        done += [writer.close()] if writer else []
        yield from batches(done, pa.schema([("shard", pa.int64()), ("path", pa.string()), *((k, pa.int64()) for k in ("sequence_length", "n_tokens", "n_docs"))]))

    ids = docs.select(shard.cast("long").alias("shard"), "doc_id", "text").mapInArrow(encode, "shard long, doc_id long, ids binary")
    ids.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(store, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # a row for each shard, some tens of MB each: few rows at any size
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _documents(path, base)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.select("path", "base").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, out)


def _documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
    """Walks the two streams of a shard together; holds one batch of sequences at a time."""
    sequences = open_sequences(path)[0]
    where, plain = _place(path + ".docs")
    held, first = np.zeros(0, "<u4"), 0  # ids from local position `first` on
    with where.open_input_stream(plain) as f:
        for index in pa.ipc.open_stream(f):
            out = []
            for doc_id, start, n in zip(*(c.to_pylist() for c in index.columns), strict=True):
                while first + len(held) < start + n:
                    batch = sequences.read_next_batch()
                    ids = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
                    held, first = np.concatenate([held[start - first :], ids.astype("<u4")]), start
                out.append({"doc_id": doc_id, "start": base + start, "n_tokens": n, "ids_crc32": zlib.crc32(held[start - first : start - first + n].tobytes())})
            yield from batches(out, pa.schema([*((k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32"))]))
