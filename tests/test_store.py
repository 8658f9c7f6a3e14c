"""Tables by profile need no exchange; publishing shows whole versions only, the first of several."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from soundings.sources import ingest, store


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_and_windows_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(u, k, float(k), (u * k) % 5 == 0) for u in range(50) for k in range(7)]
        df = spark.createDataFrame(rows, "uid long, lev int, z double, flag boolean").repartition(5)
        levels = store.save_by_profile(df.drop("flag"), "by_profile_levels", str(tmp_path / "levels"), 8)
        flags = store.save_by_profile(df.select("uid", "lev", "flag"), "by_profile_flags", str(tmp_path / "flags"), 8)
        on = levels.join(flags, ["uid", "lev"]).withColumn("above", F.lag("z").over(Window.partitionBy("uid").orderBy("lev")))
        out = on.groupBy("uid").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), F.sum("above").alias("above"))
        assert _exchanges(out) == 0
        plain = df.withColumn("above", F.lag("z").over(Window.partitionBy("uid").orderBy("lev"))).groupBy("uid").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), F.sum("above").alias("above"))
        assert _exchanges(plain) > 0
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.collect()}
        assert store.save_by_profile(df.where("uid < 3"), "by_profile_levels", str(tmp_path / "levels"), 8).count() == 21  # again
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in ("by_profile_levels", "by_profile_flags"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_one_version_of_several_counts(spark, tmp_path):
    folder = str(tmp_path / "grid")
    assert store.published(spark, folder) is None
    frames = [spark.range(20).select("id", F.lit(k).alias("who"), (F.col("id") % 3).alias("month")) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda df: store.publish(df, folder, ["month"]), frames))
    winners = {tuple(sorted(r.who for r in df.select("who").distinct().collect())) for df in found}
    assert len(winners) == 1 and len(next(iter(winners))) == 1
    versions = [p.name for p in (tmp_path / "grid").iterdir() if p.name.startswith("version-")]
    assert len(versions) == 1 and not [p for p in (tmp_path / "grid").iterdir() if p.name.startswith(".version")]
    old = store.published(spark, folder)
    new = store.publish(frames[0].withColumn("who", F.lit(9)), folder, ["month"], replace=True)
    assert {r.who for r in new.select("who").distinct().collect()} == {9} and old.count() == 20


def test_a_version_that_was_never_finished_is_not_seen(spark, tmp_path):
    folder = tmp_path / "grid"
    spark.range(3).write.parquet(str(folder / "version-broken"))
    assert store.published(spark, str(folder)) is None
    (tmp_path / "clim.txt").write_text("10.0 20.0 5 1 4.0 6.0 5.0 0.1\n")
    fields = {n: k for k, n in enumerate(("lat", "lon", "depth", "month", "q1", "q3", "median", "medcouple"))}
    assert ingest.prepared_climatology(spark, str(folder), str(tmp_path / "clim.txt"), fields).count() == 1
    (tmp_path / "clim.txt").write_text("")
    assert ingest.prepared_climatology(spark, str(folder), str(tmp_path / "clim.txt"), fields).count() == 1


def test_track_results_replace_those_of_the_check(spark, tmp_path):
    path = str(tmp_path / "flags")
    rows = spark.createDataFrame([(u, "C", u % 4, "x", u) for u in range(40)], "uid long, country string, cruise long, ocruise string, ts long")
    flags = spark.createDataFrame([(u, u % 7 == 0) for u in range(40)], "uid long, flag boolean")
    ingest.write_flags(spark.createDataFrame([(1, 0, "a03_gradient", True)], "uid long, lev int, check string, flag boolean"), path)
    for turned in (False, True):
        store.write_track_flags(flags.withColumn("flag", F.col("flag") != F.lit(turned)), rows, path)
    got = spark.read.option("mergeSchema", "true").parquet(path)
    assert {(r.uid, r.flag) for r in got.where("check = 'e10_track'").collect()} == {(u, u % 7 != 0) for u in range(40)}
    assert got.where("check = 'a03_gradient'").count() == 1
