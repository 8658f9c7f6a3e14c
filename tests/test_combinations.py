"""Sums over supersets, set partitions and level maps against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.operators import levelmaps, rules, selection


def _rows(rng, n, many):
    return [(rng.random() < 0.3, rng.randrange(1 << n), rng.randint(1, 9)) for _ in range(many)]


def test_rates_of_all_sets_of_twenty_checks(spark):
    n = 20
    rows = _rows(random.Random(1), n, 400)
    table = spark.createDataFrame(rows, "truth boolean, mask long, n long")
    out = selection.subset_rates(table, n)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    got = out.toPandas().sort_values("subset")
    assert got["subset"].tolist() == list(range(1, 1 << n))
    sums = {True: np.zeros(1 << n), False: np.zeros(1 << n)}
    for truth, mask, count in rows:
        sums[truth][mask] += count
    for truth, name in ((True, "tpr"), (False, "fpr")):
        f = sums[truth]
        total = f.sum()
        for k in range(n):
            f = f.reshape(-1, 2, 1 << k)
            f[:, 0] += f[:, 1]
            f = f.reshape(-1)
        assert np.allclose(got[name], 100.0 * f[1:] / total)
    assert (got["size"] == [bin(s).count("1") for s in range(1, 1 << n)]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_superset_sums_of_few_checks(spark, n):
    rows = _rows(random.Random(n), 8, 60)
    table = spark.createDataFrame(rows, "truth boolean, mask long, n long")
    got = {r["subset"]: (r["tpr"], r["fpr"]) for r in selection.subset_rates(table, n).collect()}
    for s in range(1, 1 << n):
        for k, truth in enumerate((True, False)):
            of = sum(c for t, _, c in rows if t == truth)
            want = 100.0 * sum(c for t, m, c in rows if t == truth and m & s == s) / of if of else None
            assert got[s][k] == pytest.approx(want)
    assert {r["subset"] for r in selection.subset_rates(table, n, 1).collect()} == {1 << k for k in range(n)}


def _partitions(n):
    found = [[1]]
    for k in range(1, n):
        found = [[*(g + (1 << k) if j == i else g for j, g in enumerate(p))] if i < len(p) else [*p, 1 << k] for p in found for i in range(len(p) + 1)]
    return found


def test_partitions_from_their_numbers(spark):
    for n in (1, 2, 4, 7):
        rows = selection.partitions(spark, n).orderBy("id").collect()
        assert [list(r["groups"]) for r in rows] == _partitions(n)  # strings of group numbers in ascending order
    two_and_one = {tuple(r["groups"]) for r in selection.partitions(spark, 3, [2, 1]).collect()}
    assert two_and_one == {(3, 4), (5, 2), (1, 6)}
    with pytest.raises(ValueError):
        selection.partitions(spark, selection.MOST_PARTED + 1)


def test_partition_rates(spark):
    n, rows = 5, _rows(random.Random(7), 5, 25)
    table = spark.createDataFrame(rows, "truth boolean, mask long, n long")
    got = {r["partition"]: (r["groups"], r["tpr"], r["fpr"]) for r in selection.partition_rates(table, n).collect()}
    assert len(got) == 52
    for p in _partitions(n):
        name = "|".join("&".join(str(k) for k in range(n) if g >> k & 1) for g in p)
        want = [100.0 * sum(c for t, m, c in rows if t == truth and any(m & g == g for g in p)) / sum(c for t, _, c in rows if t == truth) for truth in (True, False)]
        assert got[name] == (len(p), pytest.approx(want[0]), pytest.approx(want[1]))


def test_partition_rates_without_patterns(spark):
    got = selection.partition_rates(spark.createDataFrame([], "truth boolean, mask long, n long"), 3).collect()
    assert len(got) == 5 and all(r["tpr"] is None and r["fpr"] is None for r in got)


@pytest.mark.parametrize("pad,xbt", [(0, False), (1, True), (2, True)])
def test_level_maps_remove_what_rules_remove(spark, pad, xbt):
    rng = random.Random(pad)
    names = ["a", "b", "c", "d"]
    rows = [(u, lev, rng.choice([1, 1, 2, 4]), 1 + u % 3, *(rng.choice([True, False, False, False, None]) for _ in names)) for u in range(120) for lev in range(rng.randint(1, 9))]
    levels = spark.createDataFrame(rows, "uid long, lev int, truth int, probe int, a boolean, b boolean, c boolean, d boolean")
    steps = [("a", "levels"), ("b", rng.choice(["above", "below", "profile"])), ("c", "levels")]
    want = rules.decisions(rules.apply_rules(levels, steps, pad, xbt_below=xbt), ["d"])
    state = levelmaps.pack(levels, names)
    for check, rule in steps:
        state = levelmaps.remove(state, names.index(check), rule, pad, xbt)
    kept = state.where("NOT dead").select("uid", F.size("cells").alias("n"))
    assert {(r.uid, r.n) for r in kept.collect()} == {(r.uid, r.n) for r in rules.apply_rules(levels, steps, pad, xbt_below=xbt).groupBy("uid").agg(F.count("*").alias("n")).collect()}
    expected = selection.patterns(want.withColumn("d", F.coalesce("d", F.lit(False))), ["d"])
    as_set = lambda df: {(r.truth, r.mask, r.n) for r in df.collect()}
    assert as_set(levelmaps.patterns(state, 1 << 3).withColumn("mask", F.shiftright("mask", 3))) == as_set(expected)
    assert "Window" not in state._jdf.queryExecution().toString()
