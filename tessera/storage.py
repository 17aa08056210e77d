"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets a folder that goes when the program ends; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        where = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # a writer holds a block
    if (made := _made.get()) is not None:
        made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    return read_from(out, path)


def read_from(table: DataFrame, *paths: str) -> DataFrame:
    """Note which written tables a DataFrame needs; scratch() keeps these with it."""
    table.written_to = paths
    return table


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those given to keep(), which an enclosing scratch() may still drop."""
    outer, inner, kept = _made.get(), [], set()
    token = _made.set(inner)

    def keep(table: DataFrame) -> DataFrame:
        kept.update(vars(table).get("written_to", ()))
        return table

    try:
        yield keep
    finally:
        _made.reset(token)
        for spark, path in inner:
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif outer is not None:
                outer.append((spark, path))
