"""Level-removal rules: which levels go when a check has flagged some, and their application one after the other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: above: down to the deepest flag; below: from the first flag on; profile: all if any; levels: the flagged ones.
RULES = ("above", "below", "profile", "levels")


def removal(rule: Column | str, flag: Column, place: Column, uid: str = "uid", pad: int = 0) -> Column:
    """Whether a rule removes a level, given its flag and its place; padding extends the result by ``pad`` levels."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    whole = Window.partitionBy(uid)
    first, last = F.min(F.when(flag, place)).over(whole), F.max(F.when(flag, place)).over(whole)
    hit = F.when(rule == "above", place <= last).when(rule == "below", place >= first).when(rule == "profile", first.isNotNull()).when(rule == "levels", flag)
    hit = F.coalesce(hit, F.lit(False))
    return hit if not pad else F.max(hit).over(Window.partitionBy(uid).orderBy(place).rowsBetween(-pad, pad))


def any_flag(flags: Sequence[DataFrame]) -> DataFrame:
    """``uid, lev, flag``: the OR of flag tables, by one aggregate."""
    return reduce(DataFrame.unionByName, (f.select("uid", "lev", "flag") for f in flags)).groupBy("uid", "lev").agg(F.bool_or("flag").alias("flag"))


def passed(levels: DataFrame, flags: DataFrame) -> DataFrame:
    """The levels that a flag table does not flag."""
    return levels.join(flags.where("flag").select("uid", "lev"), ["uid", "lev"], "left_anti")


def apply_rules(levels: DataFrame, steps: list[tuple[str, str]], pad: int = 0, xbt_below: bool = False, wire_break: str | None = None) -> DataFrame:
    """Levels that survive a list of (check column, rule), each applied to what the ones before have left.

    A check's levels are renumbered after every step, so padding counts surviving levels. A step that would leave a
    profile without levels drops the profile at the end and leaves its levels to the later steps. Check columns that
    were used are removed. With ``xbt_below``, *levels* means *below* for expendable probes (probe 2). All windows
    share one partitioning by ``uid``: one exchange for the whole list. ``wire_break`` names a check whose levels below go too.
    """
    if wire_break and (wire_break, "below") not in steps:
        steps = [*steps, (wire_break, "below")]
    whole = Window.partitionBy("uid")
    df = levels.withColumn("_dead", F.lit(False))
    for check, rule in steps:
        place = F.row_number().over(Window.partitionBy("uid").orderBy("lev"))
        own = F.when(F.col("probe") == 2, "below").otherwise(rule) if rule == "levels" and xbt_below else F.lit(rule)
        df = df.withColumn("_i", place).withColumn("_gone", removal(own, F.col(check), F.col("_i")))
        if pad:
            df = df.withColumn("_gone", F.max("_gone").over(Window.partitionBy("uid").orderBy("_i").rowsBetween(-pad, pad)))
        df = df.withColumn("_all", F.min("_gone").over(whole)).withColumn("_dead", F.col("_dead") | F.col("_all"))
        df = df.where(~F.col("_gone") | F.col("_all")).drop("_i", "_gone", "_all", check)
    return df.withColumn("_dead", F.max("_dead").over(whole)).where(~F.col("_dead")).drop("_dead")


def levels_before_first_flag(flag: str = "flag") -> Column:
    """Aggregate: number of levels before the first flagged one, or all."""
    return F.coalesce(F.min(F.when(F.col(flag), F.col("lev"))), F.count("*")).cast("long")


def levels_after_last_flag(flag: str = "flag") -> Column:
    """Aggregate: minus the number of levels after the last flagged one, or of all."""
    return -F.coalesce(F.count("*") - 1 - F.max(F.when(F.col(flag), F.col("lev"))), F.count("*")).cast("long")


def decisions(levels: DataFrame, checks: list[str]) -> DataFrame:
    """One row per profile: ``truth`` (a level with code 3 or 4) and whether each check flags any level."""
    truth = F.coalesce(F.bool_or(F.col("truth").isin(3, 4)), F.lit(False)).alias("truth")
    return levels.groupBy("uid").agg(truth, *(F.bool_or(c).alias(c) for c in checks))
