"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

ASCII_SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_of(column: str) -> Column:
    """CRC-32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Name a checkpoint folder where the cluster has not named one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """``df``; its session hands tasks at most ``rows`` texts at a time, which bounds both sides' buffers."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    return df


@cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def release_memory() -> None:
    """Give freed memory back to the system: a worker keeps it else, also while the next stage needs it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def text_batches(batches: Iterator, column: str, most_bytes: int = 8_000_000, release_every: int = 1) -> Iterator:
    """Record batches cut so that the texts of one take about ``most_bytes``; a longer text stands alone.

    What ``release_every`` batches took is released before the next one.
    """
    import numpy as np
    import pyarrow.compute as pc

    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)
            done += 1
            if done % release_every == 0:
                release_memory()
    if done % release_every:
        release_memory()
