"""Shared plumbing of the text operators: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: they bound what a Python worker holds, whatever the table's size and its texts' lengths
#: (a text longer than that is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: the session's settings stay so, as Spark reads them when a plan runs."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``; one of its own only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it again: smaller than a checkpoint for texts."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a few numbers each that may be broadcast: about 50 MB in a task's memory.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """A stored table of rows of a few numbers, marked for broadcast if it is counted small; else Spark plans its joins."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def by_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], done: Callable[[], None] | None = None) -> DataFrame:
    """Apply a function of one Arrow batch to a frame; it keeps no state between batches but caches.

    ``done`` runs at the end of each task and lets go of caches, since Spark keeps its Python workers for later stages; so
    does Arrow of freed memory.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                if b.num_rows and (out := fn(b)) is not None:
                    yield out
        finally:
            if done is not None:
                done()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies: beside ``$SOUNDINGS_TOKENIZERS`` if set, else in the installed package."""
    if folder := os.environ.get("SOUNDINGS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def checksum(expr) -> "F.Column":
    return F.sha2(F.coalesce(expr, F.lit("")), 256)
