"""Tables that are laid out for their readers, and results that appear all at once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the tables by profile. Tables of one number of buckets meet without an exchange.
BUCKETS = 64
MANIFEST = "MANIFEST"


def save_by_profile(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The frame as a table of a given name, bucketed by ``uid`` and within a bucket in order of ``uid`` and, if there, ``lev``.

    Joins, windows and aggregates by ``uid`` over such tables need no exchange; each bucket is one task, so there should be so many
    that one fits a task's memory. The path lies in a folder that the driver and all executors share. For joins by ``uid`` and level the
    session must accept tables that are divided by ``uid`` alone; that setting is made here and stays.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    order = [c for c in ("uid", "lev") if c in df.columns]
    ready = df.repartition(buckets, "uid")  # a bucket is written by one task, as one file
    ready.write.format("parquet").bucketBy(buckets, "uid").sortBy(*order).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def _hadoop(spark: SparkSession, folder: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, conf, path.getFileSystem(conf)


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """What has been published in a folder, or None: the manifest names the version that counts."""
    jvm, _, fs = _hadoop(spark, folder)
    manifest = jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    if not fs.exists(manifest):
        return None
    return spark.read.parquet(f"{folder}/{spark.read.text(manifest.toString()).first()[0]}")


def publish(df: DataFrame, folder: str, by: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """Write a frame as a version of its own and make it the one that counts, by renaming a manifest into place.

    Readers see a whole version or none, whatever fails on the way. Of several sessions that publish at once the first wins, unless
    ``replace`` is set: the others drop their version and take the winner's. Versions that have been replaced stay for those who
    read them.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{folder}/{version}")
    jvm, conf, fs = _hadoop(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path
    draft, final = path(folder, f".{version}"), path(folder, MANIFEST)
    out = fs.create(draft, False)
    out.write(bytearray(version, "ascii"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), how)
    except Exception:
        fs.delete(draft, False)
        fs.delete(path(folder, version), True)
        if replace or not fs.exists(final):
            raise
    return published(spark, folder)


def write_track_flags(flags: DataFrame, rows: DataFrame, path: str, check: str = "e10_track") -> None:
    """Flags of whole tracks (``uid, flag`` and the header rows with the key of their track), written in one job.

    The results of the check are replaced as a whole, those of other checks in the folder stay. A track's rows lie together, in
    order; ``uid`` and key are those of the header rows.
    """
    key = [c for c in ("country", "cruise", "ocruise") if c in rows.columns]
    order = [c for c in (*key, "ts", "uid") if c in rows.columns]
    named = flags.select("uid", "flag").join(rows.select(*dict.fromkeys(("uid", *order))), "uid").withColumn("check", F.lit(check))
    laid = named.repartition(*key).sortWithinPartitions(*order) if key else named
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("check").parquet(path)
