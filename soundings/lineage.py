"""Cutting the plan of a loop: what a round has made is written to the shared checkpoint folder and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of its own only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, read from a checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()
