"""Shared helpers: the cluster's shared folder, written tables, and column handling."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, shared_dir, written

# workers live on between stages: freed buffers go back to the system at once
pa.set_memory_pool(pa.system_memory_pool())

__all__ = ["batches", "ids", "narrow", "partitions", "pick", "pieces", "runs_of", "scratch", "shared_dir", "table", "texts", "trimmed", "vocabulary", "written"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
NONE = -(1 << 63)  # stands for a null doc_id
FEW = 1_000_000  # ids (8 MB) up to which a broadcast picks documents; beyond, a shuffled join does


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which its owner sets with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function over a stream of batches whose worker gives back what it has freed when a task ends, as workers live on between stages."""

    @functools.wraps(run)
    def out(stream):
        yield from run(stream)
        give_back()

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def narrow(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which hold ten thousand rows however long their texts, unless the session's owner has."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")


def texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators read; other columns never clash."""
    narrow(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def batches(rows: list[dict], schema: pa.Schema, size: int = 4096):
    """Arrow batches of row dicts."""
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], schema=schema)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of a batch with about limit bytes of a text or binary column, to bound what Python holds."""
    n = batch.num_rows
    if not n:
        return
    size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
    step = max(1, math.floor(n * limit / size)) if size > limit else n
    for i in range(0, n, step):
        yield batch.slice(i, step)


def ids(batch: pa.RecordBatch) -> list[int]:
    return [NONE if x is None else x for x in batch.column("doc_id").to_pylist()]


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each begins."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(change)


def pick(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join by the document's id, which is unique in table. Only ids are broadcast, and only after they were counted."""
    chosen = table.select("doc_id")
    if chosen.count() > FEW:
        return docs.join(table, "doc_id", how)
    found = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    if how == "left_semi":
        return found
    joined = found.join(table, "doc_id")
    return joined if how == "inner" else joined.unionByName(docs.join(F.broadcast(chosen), "doc_id", "left_anti"), allowMissingColumns=True)
