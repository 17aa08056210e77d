"""Packing of token sequences as vector bin packing with the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens, all at once. Documents longer
than a sequence give full sequences first; what is left of them, and the shorter documents, wait in a
bounded pool. A sequence is filled with the piece whose demand vector has the largest dot product with
what is still free; when nothing fits but tokens are free, a waiting piece is cut to fit, so only the last
sequence of a partition, or one whose segments ran out, is padded. Every partition packs on its own:
no shuffle, no group by key, memory bounded by the pool.

Defined results: null and empty texts are a document of the end id alone; repeated rows are packed once
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pieces, texts, trimmed
from .tokens import KEPT, encoder, release

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


@dataclass(frozen=True)
class Limits:
    """Per sequence; loss defaults to the tokens, so it binds only where it is set lower."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    pool: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("a sequence must have room for a token, a segment and a loss-bearing token")


class Packer:
    """Places pieces; yields a row for each piece of each sequence that is closed."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.next = limits, first
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.items: list[tuple] = []  # doc_id, start, ids, mask of loss, doc_tokens
        self.demand = np.zeros((limits.pool, 3))

    def add(self, doc_id, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[dict]:
        """loss: which ids bear loss; all of them where None."""
        loss = np.ones(len(ids), bool) if loss is None else loss
        full, at = self.limits.tokens, 0
        while len(ids) - at >= full and loss[at : at + full].sum() <= self.limits.loss:
            yield from self._close([(doc_id, at, ids[at : at + full], loss[at : at + full], len(ids))])
            at += full
        while at < len(ids):
            to = min(len(ids), at + full)
            if (over := np.flatnonzero(np.cumsum(loss[at:to]) > self.limits.loss)).size:
                to = at + max(1, int(over[0]))
            self._wait((doc_id, at, ids[at:to], loss[at:to], len(ids)))
            at = to
            if len(self.items) == self.limits.pool:
                while len(self.items) > self.limits.pool // 2:
                    yield from self._fill()

    def _wait(self, item: tuple) -> None:
        self.demand[len(self.items)] = (len(item[2]), 1, item[3].sum())
        self.items.append(item)

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i], self.demand[i] = last, self.demand[len(self.items)]
        return item

    def _fill(self) -> Iterator[dict]:
        free, chosen = self.caps.copy(), []
        while self.items and free[0] >= 1 and free[1] >= 1:
            need = self.demand[: len(self.items)]
            fits = (need <= free).all(axis=1)
            if fits.any():
                # both sides in shares of the limits, so that no unit outweighs another
                score = (need / self.caps) @ (free / self.caps)
                chosen.append(self._take(int(np.where(fits, score, -1).argmax())))
            else:
                i = int(need[:, 0].argmin())
                keep = min(int(free[0]), int(np.searchsorted(np.cumsum(self.items[i][3]), free[2], "right")))
                if keep < 1:
                    break
                doc_id, start, ids, loss, n = self._take(i)
                chosen.append((doc_id, start, ids[:keep], loss[:keep], n))
                self._wait((doc_id, start + keep, ids[keep:], loss[keep:], n))
            free -= (len(chosen[-1][2]), 1, chosen[-1][3].sum())
        yield from self._close(chosen)

    def _close(self, chosen: list[tuple]) -> Iterator[dict]:
        at = 0
        for doc_id, start, ids, loss, n in chosen:
            yield {"doc_id": doc_id, "start": start, "length": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "doc_tokens": n, "loss_tokens": int(loss.sum()), "sequence_id": self.next, "offset": at}
            at += len(ids)
        self.next += bool(chosen)

    def end(self) -> Iterator[dict]:
        while self.items:
            yield from self._fill()


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 1, limits: Limits = Limits(), prompt: str | None = None, cache: int = KEPT) -> DataFrame:
    """Encode the whole texts, end each with end_id, and place every id in exactly one sequence.

    prompt: a column with the number of a text's first ids that bear no loss; all bear loss where it is null or not named.
    cache: chunks of text that a task keeps with their ids; what it keeps is dropped at the end of a task where cache is below KEPT.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, out = encoder(vocabulary, cache), Packer(limits, TaskContext.get().partitionId() << 40), []
        for whole in stream:
            for batch in pieces(whole, "text"):
                free = batch.column(2).to_pylist() if prompt else [None] * batch.num_rows
                for doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), free, strict=True):
                    ids = np.append(np.frombuffer(enc.encode(text), enc.dtype), enc.dtype.type(end_id))
                    out += packer.add(doc_id, ids, None if n is None else np.arange(len(ids)) >= n)
                if len(out) >= 4096:
                    yield from batches(out, ARROW)
                    out = []
        yield from batches(out + list(packer.end()), ARROW)
        if cache < KEPT:
            release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(prompt).cast("long")) if prompt else texts(docs)
    return rows.mapInArrow(trimmed(run), SCHEMA)
