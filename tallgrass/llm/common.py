"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the whole cluster shares.

    The cluster names it in ``spark.checkpoint.dir``. Where the setting is missing, a temporary one is made for a
    session on one machine (tests); any other is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="tallgrass-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and read back from Parquet in the shared folder: columns of it, compressed, where a checkpoint holds whole rows."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    A frame that Python has dropped is let go by the JVM after its next collection only, hence two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted as it ends, and not when the driver happens to collect its garbage.

    It is for queries whose whole result is taken or written at once: not for ``toLocalIterator``.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_mod(column: str, modulus: int) -> "F.Column":
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % modulus


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with about ``max_bytes`` in ``column`` each. A longer value makes a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(upto):
            done = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """``byte_slices`` with their texts in UTF-8 (null: empty). Beside Arrow's own batch only a slice is in memory."""
    for part in byte_slices(batches, column, max_bytes):
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
