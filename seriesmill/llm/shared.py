"""Reading tables, cutting lineage and streaming over sorted groups."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: rows of one Arrow batch that a Python function returns
OUT_ROWS = 512
#: rows of one Arrow batch that a Python function gets
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of `BATCH_ROWS`, unless the session asks for fewer.

    Rows hold whole texts and sets, so the default of 10,000 rows can fill what an executor has
    outside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir` of the session.

    Only a local session, whose tasks share one machine, may leave it unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that no DataFrame refers to any more.

    Its cleaner follows the garbage collectors of both processes, which a driver with little to
    do seldom runs; loops call this between their rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if n == 0:
        return
    change = np.zeros(n - 1, dtype=bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    at = np.concatenate(([0], np.flatnonzero(change) + 1, [n]))
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys from batches of a sorted partition, one at a time.

    Null keys are not allowed.  Only the group being read is held.
    """
    held: pa.Table | None = None
    for batch in batches:
        piece = pa.Table.from_batches([batch])
        held = piece if held is None else pa.concat_tables([held, piece])
        columns = [np.asarray(held[k].to_numpy()) for k in keys]
        bounds = list(runs(columns))
        for low, high in bounds[:-1]:
            yield held.slice(low, high - low)
        if bounds:
            held = held.slice(bounds[-1][0])
    if held is not None and held.num_rows:
        yield held
