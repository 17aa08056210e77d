"""Dealing of hashed runs to buckets as packed arrays, so that a shuffle moves a few large rows, not one for each run.

A 64-bit hash gives its bucket from its upper half and a 32-bit token from its lower half; tokens are equal
within a bucket for equal hashes, and seldom for others, as buckets grow in number with the input. Users of
the groups verify what they find, so a chance meeting costs work and never a wrong result; who takes one member
for all of a group carries the rest of the hash in a column and groups by both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions

CODEC = pa.Codec("zstd", 1)


def count(spark) -> int:
    return 4 * partitions(spark)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as byte planes, compressed."""
    out = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return len(out).to_bytes(8, "little") + CODEC.compress(out, asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size, kinds = int.from_bytes(blob[:8], "little"), [np.dtype(k) for k in kinds]
    flat = np.frombuffer(CODEC.decompress(blob[8:], size, asbytes=True), np.uint8)
    n, at, out = size // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.ascontiguousarray(flat[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out


class Dealer:
    """Holds up to `limit` runs of a task; rows() gives one packed row for each bucket and flush."""

    def __init__(self, n_buckets: int, limit: int = 1_000_000):
        self.n_buckets, self.limit, self.held, self.n = np.uint64(n_buckets), limit, [], 0

    def add(self, hashes: np.ndarray, *columns: np.ndarray) -> bool:
        """True when it is time to take rows()."""
        if len(hashes):
            self.held.append((hashes, *columns))
            self.n += len(hashes)
        return self.n >= self.limit

    def sorted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """What is held, by bucket << 32 | token; nothing is held then."""
        hashes, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.uint64),)
        self.held, self.n = [], 0
        key = ((hashes >> np.uint64(32)) % self.n_buckets) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        return key[order], [c[order] for c in columns]

    def counted(self) -> Iterator[pa.RecordBatch]:
        """As rows(), with each token once and how often it was added, so that a hot token is one entry of a flush."""
        key, _ = self.sorted()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        yield from self.packed(key[new], [np.diff(np.r_[new, len(key)]).astype("<u4")])

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from self.packed(*self.sorted())

    def packed(self, key: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        low = np.uint64(0xFFFFFFFF)
        bucket = (key >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        step = np.diff(key, prepend=key[:1]).astype(np.uint32)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = step[a:b].copy()
            part[0] = np.uint32(key[a] & low)
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int64()), pa.array([pack(part, *(c[a:b] for c in columns))], pa.binary())], ["bucket", "runs"])


def groups(dealt: DataFrame, kinds: tuple[str, ...], work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(tokens, *columns) for each bucket: its runs of all tasks, sorted by token. A bucket has an even share of the runs."""

    arrow = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in schema.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("runs").to_pylist():
            step, *columns = unpack(blob, "<u4", *kinds)
            parts.append((np.cumsum(step, dtype=np.uint64).astype(np.uint32), *columns))
        tokens, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(tokens, kind="stable")
        return pa.Table.from_batches(list(work(tokens[order], *(c[order] for c in columns))), schema=arrow)

    return dealt.groupBy("bucket").applyInArrow(run, schema)
