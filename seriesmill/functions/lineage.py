"""Cutting lineage through the shared checkpoint folder of the cluster."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: tables written in the `scratch` blocks that this thread is in
_blocks = threading.local()


def _folder(df: DataFrame) -> str:
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def written(df: DataFrame, *by: str) -> DataFrame:
    """As `stable`, in compressed columns: for many rows, a fraction of the disk, but partitions are not kept.

    Rows of one value of the columns `by`, of which there are few, are read without those of others.
    """
    path = f"{_folder(df).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    if getattr(_blocks, "open", None):
        _blocks.open[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a `written` table that nothing reads any more."""
    spark, path = df.sparkSession, df._written
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables `written` inside are removed at the end, with shuffle files: their readers must be done by then."""
    _blocks.open = [*getattr(_blocks, "open", []), []]
    try:
        yield
    finally:
        for df in _blocks.open.pop():
            forget(df)
        release(spark)


def outlive(df: DataFrame) -> DataFrame:
    """A table written in a `scratch` block, kept to the end of the block around that one."""
    inner = _blocks.open[-1]
    inner[:] = [d for d in inner if d is not df]
    if len(_blocks.open) > 1:
        _blocks.open[-2].append(df)
    return df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no DataFrame refers to any more.

    Its cleaner follows the garbage collectors of both processes, which a driver with little to do seldom runs.
    """
    gc.collect()
    spark._jvm.System.gc()


def stable(df: DataFrame) -> DataFrame:
    """Write `df` once and go on from the written rows.

    Needed before a value that came out of floating sums is used as a join or
    rank key: recomputing such a sum may differ in the last bit.  The folder is
    `spark.checkpoint.dir`; only a local session may do without that setting.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_folder(df))
    return df.checkpoint()
