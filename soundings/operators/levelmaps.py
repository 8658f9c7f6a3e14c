"""Levels of a profile as one array of bit sets, on which removal rules are array operations.

A cell of the array is a level that is left, in order; bit k tells whether check k flags it, ``TRUTH`` whether it is bad. Taking
levels away, padding, the rule for expendable probes and the decisions of a profile need no window and no exchange, so a
search that removes levels again and again scans a row per profile and round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUTH = 62


def pack(levels: DataFrame, checks: Sequence[str]) -> DataFrame:
    """``uid, probe, cells, dead`` from levels (``uid, lev, truth, probe`` and a column per check); a NULL flag flags nothing."""
    if len(checks) > TRUTH:
        raise ValueError(f"a cell holds {TRUTH} checks at most")
    bit = lambda on, k: F.when(on, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    cell = reduce(lambda a, b: a + b, [bit(F.col("truth").isin(3, 4), TRUTH), *(bit(F.col(c), k) for k, c in enumerate(checks))])
    rows = levels.groupBy("uid").agg(F.max("probe").alias("probe"), F.sort_array(F.collect_list(F.struct("lev", cell.alias("cell")))).alias("at"))
    return rows.select("uid", "probe", F.col("at.cell").alias("cells"), F.lit(False).alias("dead"))


def _on(cell: Column, k: int) -> Column:
    return cell.bitwiseAND(F.lit(1 << k).cast("long")) != 0


def remove(packed: DataFrame, k: int, rule: str, pad: int = 0, xbt_below: bool = False) -> DataFrame:
    """The table after check ``k`` has taken levels by a rule, with ``pad`` of those left around them.

    A profile that would lose all its levels is dead: it keeps them for the later steps and counts no more.
    """
    flags = packed.withColumn("_f", F.transform("cells", lambda c: _on(c, k))).withColumn("_n", F.size("cells"))
    marked = flags.withColumn("_first", F.array_position("_f", True) - 1).withColumn("_last", F.col("_n") - F.array_position(F.reverse("_f"), True))
    some = F.col("_first") >= 0
    own = F.when(F.col("probe") == 2, "below").otherwise(rule) if rule == "levels" and xbt_below else F.lit(rule)
    ruled = marked.withColumn("_rule", own)

    def gone(i: Column) -> Column:
        near = reduce(lambda a, b: a | b, (F.coalesce(F.get(F.col("_f"), i + j), F.lit(False)) for j in range(-pad, pad + 1)))
        by = F.when(F.col("_rule") == "above", i <= F.col("_last") + pad).when(F.col("_rule") == "below", i >= F.col("_first") - pad)
        return some & by.when(F.col("_rule") == "profile", F.lit(True)).otherwise(near)

    left = ruled.withColumn("_left", F.filter("cells", lambda c, i: ~gone(i)))
    lost = (F.size("_left") == 0) & (F.col("_n") > 0)
    return left.select("uid", "probe", F.when(lost, F.col("cells")).otherwise(F.col("_left")).alias("cells"), (F.col("dead") | lost).alias("dead"))


def patterns(packed: DataFrame, held: int) -> DataFrame:
    """``truth, mask, n`` of the profiles that are not dead: their truth and which of the ``held`` checks flag a level that is left."""
    whole = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(c))
    found = packed.where("NOT dead").select(whole.alias("_w"))
    return found.select(_on(F.col("_w"), TRUTH).alias("truth"), F.col("_w").bitwiseAND(F.lit(held).cast("long")).alias("mask")).groupBy("truth", "mask").agg(F.count("*").alias("n"))
