"""Records that arrive: filters, late data, duplicates, windows, deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def admitted(stream: DataFrame, checks: list[Column]) -> DataFrame:
    """Stateless filters, the cheap ones first."""
    for ok in checks:
        stream = stream.filter(ok)
    return stream


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """One record for each key within the watermark; state is dropped beyond it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def not_ahead(stream: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Records that are not dated after the cutoff; undated ones stay."""
    return stream.filter(F.col(time).isNull() | (F.col(time) <= cutoff))


def window_counts(stream: DataFrame, time: str, by: str, length: str, step: str, delay: str) -> DataFrame:
    w = F.window(time, length, step)
    return stream.withWatermark(time, delay).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def deltas(stream: DataFrame, known: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each batch's records whose key is not known yet go to the sink; the checkpoint makes it resume where it was."""

    def batch(df: DataFrame, _: int) -> None:
        sink(df.dropDuplicates([key]).join(known().select(key), key, "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
