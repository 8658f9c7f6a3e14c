"""Schemas of the profile tables, and views of them over the driver's star-schema tables.

A profile is a cast: a header row and its levels in order. Missing values are NULL; a check's flag never is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = (
    "uid long, year int, month int, day int, time double, lat double, lon double, country string, cruise long, ocruise string,"
    " probe int, platform int, profile_type int, orig_flag_type int, training int, flagged int"
)
LEVELS = "uid long, lev int, z double, t double, s double, p double, truth int"
FLAGS = "uid long, lev int, check string, flag boolean"

#: The same text runs in Spark and in DuckDB.
LEVELS_SQL = """
SELECT l_partkey AS uid, CAST(row_number() OVER w AS INT) - 1 AS lev,
  CAST(sum(CAST(l_quantity AS INT)) OVER w AS DOUBLE) - CASE WHEN l_linenumber = 7 THEN 60 ELSE 0 END AS z,
  CASE WHEN CAST(round(l_tax*100) AS INT) = 8 THEN NULL
       ELSE CAST(2800 - 3*sum(CAST(l_quantity AS INT)) OVER w
            + CASE WHEN CAST(round(l_discount*100) AS INT) = 10 THEN 1500 ELSE 0 END AS DOUBLE) / 100 END AS t,
  CAST(3400 + 20*CAST(round(l_tax*100) AS INT) AS DOUBLE) / 100 AS s, CAST(NULL AS DOUBLE) AS p,
  CASE l_returnflag WHEN 'R' THEN CASE WHEN CAST(round(l_discount*100) AS INT) >= 9 THEN 4 ELSE 2 END ELSE 1 END AS truth
FROM lineitem
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)
"""
PROFILES_SQL = """
SELECT p_partkey AS uid, CAST(1990 + p_partkey % 30 AS INT) AS year, CAST(p_partkey % 14 AS INT) AS month,
  CAST(1 + p_partkey % 31 AS INT) AS day, CAST(p_partkey % 26 AS DOUBLE) AS time,
  CAST((p_partkey*37) % 1840 AS DOUBLE) / 10 - 92 AS lat, CAST((p_partkey*73) % 3640 AS DOUBLE) / 10 - 182 AS lon,
  p_brand AS country, p_partkey % 50 AS cruise, p_type AS ocruise, CAST(1 + p_partkey % 16 AS INT) AS probe
FROM part
"""
TRACKS_SQL = """
SELECT event_id AS uid, user_id AS cruise, 'C' AS country, 'one' AS ocruise, ts,
  CAST(event_id % 1200 AS DOUBLE) / 100 - 6 AS lat, CAST((event_id*7) % 1000 AS DOUBLE) / 100 AS lon,
  CAST(1 + user_id % 16 AS INT) AS probe
FROM events
"""


def one_header(profiles: DataFrame) -> DataFrame:
    """A header for each uid: of rows that repeat one, the least by their columns in turn."""
    rest = [c for c in profiles.columns if c != "uid"]
    least = profiles.groupBy("uid").agg(F.min(F.struct(*rest)).alias("least"))
    return least.select("uid", *(F.col(f"least.`{c}`").alias(c) for c in rest))


def merged_headers(profiles: DataFrame) -> DataFrame:
    """The same for a join with levels, which lie by ``uid`` as well: sorted and merged.

    A few columns of the headers are small only beside their files; by these Spark would broadcast a row for each profile.
    """
    return one_header(profiles).hint("merge")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table over the Parquet files of a folder, without registering any name."""
    out = sql
    for name in ("lineitem", "part", "events"):
        if f"FROM {name}" in sql:
            return spark.sql(out.replace(f"FROM {name}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    raise ValueError("no table in the view")


#: Levels that a task deals with: partitions grow in number with the table, not in size.
LEVELS_A_TASK = 250_000
#: Levels that a task reads and deals out; with more than 200 parts Spark holds all rows of such a task.
LEVELS_READ_A_TASK = 1_000_000


def _by_uid(spark: SparkSession, sf_dir: str, sql: str, table: str, key: str) -> DataFrame:
    """A view whose rows lie by ``uid``, levels and profiles alike, so that windows and joins by profile need no further exchange.

    Joins by ``uid`` and level take the same partitions, if the session lets a part of the keys suffice, as is set here. So are
    as many splits of the files as keep the rows small that a task holds while it deals them out.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # from the files' footers
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, -(-rows // LEVELS_A_TASK))
    spark.conf.set("spark.sql.files.minPartitionNum", max(cores, -(-rows // LEVELS_READ_A_TASK)))
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumnRenamed(key, "uid").repartition(parts, "uid")
    text = sql.replace(f"{key} AS uid", "uid").replace(key, "uid").replace(f"FROM {table}", "FROM {source}")
    return spark.sql(text, source=source)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_uid(spark, sf_dir, LEVELS_SQL, "lineitem", "l_partkey")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_uid(spark, sf_dir, PROFILES_SQL, "part", "p_partkey")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACKS_SQL)
