"""Rates of checks against the truth, in one pass over a table of decisions per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(hits: Column, of: Column) -> Column:
    """A percentage; NULL where the reference population is empty."""
    return F.try_divide(100.0 * hits, of)


def rates(decisions: DataFrame, checks: list[str], truth: str = "truth", include_truth: bool = False) -> DataFrame:
    """``check, fails, tpr, fpr, tnr, fnr``: the table is read once and folded to one row per check by partial sums."""
    names = [truth, *checks] if include_truth else checks
    long = decisions.select(F.col(truth).alias("_t"), F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("hit")) for n in names))).alias("c"))
    count = lambda c: F.sum(c.cast("long"))
    hit, bad = F.col("c.hit"), F.col("_t")
    sums = long.groupBy(F.col("c.check").alias("check")).agg(count(hit).alias("fails"), count(hit & bad).alias("tp"), count(hit & ~bad).alias("fp"), count(bad).alias("p"), count(~bad).alias("n"))
    return sums.select("check", "fails", _share(F.col("tp"), F.col("p")).alias("tpr"), _share(F.col("fp"), F.col("n")).alias("fpr"), _share(F.col("n") - F.col("fp"), F.col("n")).alias("tnr"), _share(F.col("p") - F.col("tp"), F.col("p")).alias("fnr"))


def confusion(truth: Column, hit: Column) -> Column:
    return F.when(truth & hit, "TP").when(truth, "FN").when(hit, "FP").otherwise("TN")


def best(table: DataFrame, size: str | None = None) -> DataFrame:
    """``criterion, check``: lowest FPR with a TPR above 0, highest TPR with an FPR below 100, nearest to (0, 100).

    Ties go to the combination of fewest checks, then to the first name.
    """
    tie = [*([F.col(size)] if size else []), F.col("check")]
    criteria = (
        ("lowest_fpr", F.col("tpr") > 0, [F.col("fpr")]),
        ("highest_tpr", F.col("fpr") < 100, [-F.col("tpr")]),
        ("nearest", F.lit(True), [F.pow("fpr", F.lit(2)) + F.pow(100 - F.col("tpr"), F.lit(2))]),
    )
    row = F.struct("check", "tpr", "fpr")
    first = lambda ok, order: F.min_by(row, F.when(ok, F.struct(*(c.alias(f"k{k}") for k, c in enumerate([*order, *tie])))))
    found = table.agg(*(first(ok, order).alias(name) for name, ok, order in criteria))
    named = found.select(F.explode(F.array(*(F.struct(F.lit(name).alias("criterion"), F.col(name).alias("row")) for name, _, _ in criteria))).alias("x"))
    return named.where("x.row IS NOT NULL").select("x.criterion", "x.row.check", "x.row.tpr", "x.row.fpr")


def effective(table: DataFrame, least: float = 2.0) -> DataFrame:
    """Checks with some true positives whose TPR is at least ``least`` times their FPR."""
    return table.where((F.col("tpr") > 0) & ((F.col("fpr") <= 0) | (F.col("tpr") >= least * F.col("fpr"))))


def varying(decisions: DataFrame) -> DataFrame:
    """The table without columns that hold one distinct value; found with one aggregate."""
    kept = decisions.agg(*(F.count_distinct(c).alias(c) for c in decisions.columns)).first().asDict()
    return decisions.select(*(c for c in decisions.columns if kept[c] > 1))


def cut_roc(points: DataFrame, most_fpr: float) -> DataFrame:
    """Leading points of a stored selection (``pos, fpr, …``) until one reaches ``most_fpr``; the first always stays."""
    over = F.max(F.when(F.col("fpr") >= most_fpr, 1)).over(Window.orderBy("pos"))
    return points.withColumn("_over", over).where((F.col("pos") == 0) | F.col("_over").isNull()).drop("_over")
