"""Reading, screening, sampling, splitting and writing profile tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from . import store

RULES = ("Remove above reject", "Remove below reject", "Remove profile", "Remove rejected levels", "Optional", "At least one from group")


def read_profiles(spark: SparkSession, path: str, form: str = "parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """Header rows with the fixed schema; the column list reaches the scan."""
    df = spark.read.schema(schema.PROFILES).format(form).load(path)
    return df.select(*columns) if columns else df


def read_levels(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schema.LEVELS).format(form).load(path)


def exploded(profiles: DataFrame, column: str = "levels") -> DataFrame:
    """Levels of profiles that carry them as ``array<struct<z,t,s,p,truth>>``."""
    return profiles.select("uid", F.posexplode(column).alias("lev", "x")).select("uid", "lev", *(F.col(f"x.{c}").alias(c) for c in ("z", "t", "s", "p", "truth")))


def mask_sentinels(t: Column) -> Column:
    """Temperatures from 99 up to 100 are missing."""
    return F.when((t >= 99) & (t < 100), None).otherwise(t)


def encode_truth(t: Column, truth: Column) -> Column:
    """Truth 99 for temperatures strictly between 99 and 100."""
    return F.when((t > 99) & (t < 100), 99).otherwise(truth)


def drop_spurious_positions(df: DataFrame, most: float = 999.0) -> DataFrame:
    """Both coordinates go if either is beyond a limit."""
    odd = F.coalesce((F.abs("lat") > most) | (F.abs("lon") > most), F.lit(False))
    return df.withColumns({"lat": F.when(~odd, F.col("lat")), "lon": F.when(~odd, F.col("lon"))})


def first_of_each(profiles: DataFrame, order: str) -> DataFrame:
    """The first row of each uid in ingest order, whatever becomes of it later."""
    return profiles.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy(order))).where("_r = 1").drop("_r")


def screened(profiles: DataFrame, levels: DataFrame, check_flag_type: bool = True, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """Header rows fit for use: one aggregate of the levels, joined to the header's own predicates.

    Out go profile type 1, profiles without temperatures, those of several levels all above 0.1 m, flag types outside of
    1 to 14 (if asked for), other months, and those with a level whose temperature has no positive truth code.
    """
    seen = levels.groupBy("uid").agg(
        F.count("t").alias("n_t"),
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.coalesce(F.col("z") < 0.1, F.lit(False))), F.lit(False)).alias("shallow"),
        F.coalesce(F.bool_or(F.col("t").isNotNull() & (F.coalesce("truth", F.lit(0)) <= 0)), F.lit(False)).alias("unjudged"),
    )
    fit = seen.where("n_t > 0 AND NOT (n > 1 AND shallow) AND NOT unjudged").select("uid")
    own = F.coalesce(F.col("profile_type") != 1, F.lit(True)) & F.col("month").isin(*months)
    if check_flag_type:
        own = own & (F.col("orig_flag_type").isNull() | F.col("orig_flag_type").between(1, 14))
    return profiles.where(own).join(fit, "uid", "left_semi")


def flagged_before_break(levels: DataFrame, breaks: DataFrame) -> DataFrame:
    """``uid, flagged``: a bad truth code above the first wire-break flag (``breaks``: ``uid, lev, flag``)."""
    gone = F.max(F.col("flag").cast("int")).over(Window.partitionBy("uid").orderBy("lev"))
    on = levels.join(breaks, ["uid", "lev"]).withColumn("_gone", gone)
    return on.groupBy("uid").agg(F.coalesce(F.bool_or((F.col("_gone") == 0) & F.col("truth").isin(3, 4)), F.lit(False)).cast("int").alias("flagged"))


def ingest_counts(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count_if(F.col("flagged") == 0).alias("clean"), F.count_if(F.col("flagged") == 1).alias("flagged"), F.count("*").alias("total"))


def ingest(profiles: DataFrame, levels: DataFrame, breaks: DataFrame, order: str = "uid", **screen) -> tuple[DataFrame, DataFrame]:
    """(profiles, levels) to append: first of each uid, screened, truth encoded, flagged status set."""
    kept = screened(first_of_each(profiles, order), levels, **screen)
    coded = levels.join(kept.select("uid"), "uid", "left_semi").withColumn("truth", encode_truth(F.col("t"), F.col("truth")))
    return kept.drop("flagged").join(flagged_before_break(coded, breaks), "uid", "left").fillna({"flagged": 0}), coded


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def ranked(df: DataFrame, by: str, weight: Column | None = None, ranges: int = 200) -> DataFrame:
    """The rows with ``before``: the weight (1 unless given) of all rows that come before by a numeric column.

    Rows are dealt into ranges by quantiles of the column; weights are summed per range, so that only as many rows as there
    are ranges meet in one task, and running sums stay within a range.
    """
    cuts = df.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.001) if ranges > 1 else []
    weighed = df.withColumn("_w", F.lit(1) if weight is None else weight)
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>")
    placed = weighed.withColumn("_range", F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col(by))), F.lit(-1)))
    sums = placed.groupBy("_range").agg(F.sum("_w").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("_w").over(Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = placed.join(sums.select("_range", start.alias("_start")), "_range")
    return on.withColumn("before", within + F.col("_start")).drop("_range", "_w", "_start")


def batch(df: DataFrame, number: int, size: int) -> DataFrame:
    """Rows ``number*size`` up to the next batch, in order of uid."""
    return ranked(df, "uid").where((F.col("before") >= number * size) & (F.col("before") < (number + 1) * size)).drop("before")


def held_out(df: DataFrame) -> DataFrame:
    """Profiles that were not used for training."""
    return df.where("training = 0")


def balanced_sample(df: DataFrame, n: int, seed: int = 0, kind: str = "flagged") -> DataFrame:
    """n rows of each kind in random order: a sampling operator, by a hash that does not depend on the partitioning."""
    order = F.md5(F.concat_ws("-", F.col("uid").cast("string"), F.lit(str(seed))))
    parts = [df.where(F.col(kind) == k).orderBy(order, "uid").limit(n) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def random_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    ids = df.select("uid").distinct().orderBy(F.xxhash64("uid", F.lit(seed)), "uid").limit(n)
    return df.join(ids, "uid", "left_semi")


def mark_training(df: DataFrame, sample: DataFrame) -> DataFrame:
    picked = sample.select("uid").distinct().withColumn("_in", F.lit(1))
    return df.drop("training").join(picked, "uid", "left").withColumn("training", F.coalesce("_in", F.lit(0))).drop("_in")


def reuse(levels: DataFrame, stored: DataFrame, computed: DataFrame) -> DataFrame:
    """A stored flag where there is one, else the computed one."""
    old = stored.select("uid", "lev", F.col("flag").alias("_old"))
    both = levels.select("uid", "lev").join(old, ["uid", "lev"], "left").join(computed, ["uid", "lev"], "left")
    return both.select("uid", "lev", F.coalesce("_old", "flag", F.lit(False)).alias("flag"))


def without(df: DataFrame, uids: DataFrame) -> DataFrame:
    return df.join(uids.select("uid"), "uid", "left_anti")


def split_by_cruise(df: DataFrame, parts: int, size: str = "size") -> DataFrame:
    """The rows with a part number: in order of cruise, a part takes whole cruises until it is larger than an even share.

    Sizes are summed per cruise with their running sums; each border is then looked up in that table by one small aggregate,
    of which there are as many as parts. Rows without a cruise come first and end no part.
    """
    cruises = ranked(df.groupBy("cruise").agg(F.sum(size).alias("_s")), "cruise", F.col("_s")).withColumn("_end", F.col("before") + F.col("_s")).cache()
    share = math.ceil((cruises.agg(F.sum("_s")).first()[0] or 0) / parts)
    borders, start = [], 0  # the running sums at which a part ends
    known = cruises.where("cruise IS NOT NULL")
    while (end := known.where(F.col("_end") > start + share).agg(F.min("_end")).first()[0]) is not None:
        borders.append(end)
        start = end
    number = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<bigint>"), lambda e: e <= F.col("before")))
    placed = cruises.select(F.col("cruise").alias("_c"), number.alias("part"))
    return df.join(placed, df["cruise"].eqNullSafe(placed["_c"])).drop("_c")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``rule, group, checks``: the checks of each rule and group of a CSV table; an unknown rule is an error."""
    rows = spark.read.csv(path, header=True, schema="`group` string, rule string, check string, comment string")
    unknown = rows.where(~F.col("rule").isin(*RULES)).select("rule").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown rules: {[r['rule'] for r in unknown]}")
    return rows.groupBy("rule", "group").agg(F.sort_array(F.collect_set("check")).alias("checks"))


def read_region_names(spark: SparkSession, path: str) -> DataFrame:
    """``code, name``: a file of names whose line number is the code."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("code", "name"))
    return lines.select("code", F.trim("name").alias("name"))


def read_cell_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="glat double, glon double, region int")


def long_ranges(wide: DataFrame, depth: str = "depth") -> DataFrame:
    """``region, depth, tmin, tmax`` from columns ``<region>_min`` and ``<region>_max``."""
    long = wide.unpivot([depth], [c for c in wide.columns if c != depth], "what", "value")
    named = long.select(F.col(depth).cast("double").alias("depth"), F.regexp_extract("what", r"^(.*)_(min|max)$", 1).alias("region"), F.regexp_extract("what", r"^(.*)_(min|max)$", 2).alias("end"), F.col("value").cast("double").alias("value"))
    return named.groupBy("region", "depth").agg(F.max(F.when(F.col("end") == "min", F.col("value"))).alias("tmin"), F.max(F.when(F.col("end") == "max", F.col("value"))).alias("tmax"))


def adjusted_range(q1: Column, q3: Column, median: Column, medcouple: Column) -> tuple[Column, Column]:
    """Limits of the boxplot adjusted for skewness, within -2 and 33; a median of -2 or less gives just these."""
    iqr = q3 - q1
    low = q1 - 1.5 * iqr * F.exp(F.when(medcouple >= 0, -4.0).otherwise(-3.0) * medcouple)
    high = q3 + 1.5 * iqr * F.exp(F.when(medcouple >= 0, 3.0).otherwise(4.0) * medcouple)
    cold = median <= -2
    return F.when(cold, -2.0).otherwise(F.greatest(low, F.lit(-2.0))), F.when(cold, 33.0).otherwise(F.least(high, F.lit(33.0)))


def fit_lines(lines: DataFrame, fields: dict[str, int]) -> DataFrame:
    """``lat, lon, depth, month, tmin, tmax`` of white-space separated lines (``value``), without a shuffle.

    ``fields`` gives the position of ``lat, lon, depth, month, q1, q3, median, medcouple``; a month above 12 means annual.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(*(F.get(parts, F.lit(k)).try_cast("double").alias(n) for n, k in fields.items()))
    low, high = adjusted_range(F.col("q1"), F.col("q3"), F.col("median"), F.col("medcouple"))
    month = F.when(F.col("month") <= 12, F.col("month").cast("int"))
    return rows.where("lat IS NOT NULL").select("lat", "lon", "depth", month.alias("month"), low.alias("tmin"), high.alias("tmax"))


def fit_climatology(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    """Ranges of a large white-space separated climatology: one pass over its lines."""
    return fit_lines(spark.read.text(path), fields)


def prepared_climatology(spark: SparkSession, ready: str, path: str, fields: dict[str, int]) -> DataFrame:
    """The prepared grid if it has been published, else it is fitted and published first, by month; of several sessions one does so."""
    found = store.published(spark, ready)
    return store.publish(fit_climatology(spark, path, fields), ready, ["month"]) if found is None else found


def write_flags(flags: DataFrame, path: str) -> None:
    """Long flags (``uid, lev, check, flag``), a folder per check."""
    flags.write.mode("append").partitionBy("check").parquet(path)


def store_selection(points: DataFrame, path: str) -> None:
    points.coalesce(1).write.mode("overwrite").json(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos int, check string, tpr double, fpr double, enforced boolean").json(path)
