"""Removal rules, rates and selections against hand-made tables and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from soundings.operators import rates, rules, selection
from soundings.sources import ingest

RULE_CASES = [
    ("above", 0, "FFFTFF", "TTTTFF"), ("above", 0, "FFFTFT", "TTTTTT"), ("below", 0, "FFFTFF", "FFFTTT"), ("below", 0, "TFFTFF", "TTTTTT"), ("levels", 0, "TFFTFF", "TFFTFF"),
    ("profile", 0, "TFFTFF", "TTTTTT"), ("above", 1, "FFFTFF", "TTTTTF"), ("below", 2, "FFFTFF", "FTTTTT"), ("levels", 1, "TFFFFT", "TTFFTT"),
]


def _table(spark, rows):
    return spark.createDataFrame([(u, k, c == "T") for u, text in enumerate(rows) for k, c in enumerate(text)], "uid long, lev int, flag boolean")


@pytest.mark.parametrize("rule,pad,given,want", RULE_CASES)
def test_removal(spark, rule, pad, given, want):
    from pyspark.sql import Window

    df = _table(spark, [given]).withColumn("gone", rules.removal(rule, F.col("flag"), F.col("lev")))
    if pad:
        df = df.withColumn("gone", F.max("gone").over(Window.partitionBy("uid").orderBy("lev").rowsBetween(-pad, pad)))
    assert "".join("T" if r.gone else "F" for r in df.orderBy("lev").collect()) == want


def _levels(spark, probe=1):
    rows = [(1, k, k + 1, probe, k == 2, k % 2 == 1) for k in range(10)]
    return spark.createDataFrame(rows, "uid long, lev int, truth int, probe int, wire boolean, odd boolean")


@pytest.mark.parametrize(
    "steps,pad,xbt,want",
    [
        ([("wire", "below")], 0, False, [1, 2]), ([("wire", "below")], 1, False, [1]), ([("wire", "below")], 2, False, []), ([("wire", "above")], 0, False, list(range(4, 11))),
        ([("wire", "above")], 2, False, list(range(6, 11))), ([("wire", "levels")], 0, False, [1, 2, *range(4, 11)]), ([("wire", "levels")], 0, True, [1, 2]), ([("wire", "below"), ("odd", "levels")], 0, False, [1]),
    ],
)
def test_rules_in_turn(spark, steps, pad, xbt, want):
    got = rules.apply_rules(_levels(spark, 2 if xbt else 1), steps, pad, xbt)
    assert sorted(r.truth for r in got.collect()) == want


def test_rates_and_combinations(spark):
    df = spark.createDataFrame([(False, False, False), (True, False, True), (False, True, True)], "truth boolean, a boolean, b boolean")
    got = {r.check: (r.fpr, r.tpr) for r in rates.rates(df, ["a", "b"]).collect()}
    assert got == {"a": (50.0, 0.0), "b": (50.0, 100.0)}
    table = spark.createDataFrame([(0, True, True), (1, False, True), (2, False, False), (3, False, False)], "k int, x boolean, y boolean")
    assert [r[0] for r in table.orderBy("k").select(selection.combine([[F.col("x"), F.col("y")], [~F.col("y")]])).collect()] == [True, False, True, True]
    assert selection.combination_label([[0, 1], [12]]) == "(0 AND 1) OR 12"
    assert sorted(r.subset for r in selection.subsets(spark, 3, 2).collect()) == [3, 5, 6]


def _brute(rows, names, candidates, ratio, gain):
    chosen, out, best = [], [], None

    def rate(masks):
        hit = [any(m & r[1] == m for m in masks) for r in rows]
        p, n = sum(r[2] for r in rows if r[0]), sum(r[2] for r in rows if not r[0])
        return 100.0 * sum(r[2] for r, h in zip(rows, hit, strict=True) if h and r[0]) / p, 100.0 * sum(r[2] for r, h in zip(rows, hit, strict=True) if h and not r[0]) / n

    now, ceiling, left = (0.0, 0.0), selection.cost(ratio, 0.0, 0.0), list(candidates)
    while True:
        fit = []
        for k, (name, m) in enumerate(left):
            t, f = rate([*chosen, m])
            c = selection.cost(ratio, t, f)
            if c <= ceiling and t - now[0] > 0 and t - now[0] >= gain:
                fit.append((c, -(t - now[0]), name.count("&"), k, name, m, t, f))
        if not fit:
            return out
        best = min(fit)
        ceiling, now = best[0], (best[6], best[7])
        chosen.append(best[5])
        left.remove((best[4], best[5]))
        out.append(best[4])


def test_greedy_growth_matches_brute_force(spark):
    rng = random.Random(4)
    for _ in range(2):
        rows = [(bool(t), m, rng.randint(1, 30)) for t, m in itertools.product((0, 1), range(16)) if rng.random() < 0.8]
        rows = [(t, m, n * (6 if t == (m & 3 == 3) else 1)) for t, m, n in rows]
        table = spark.createDataFrame(rows, "truth boolean, mask long, n long").cache()
        names = ["a", "b", "c", "d"]
        candidates = selection.pairings(table, names)
        ratio = (0.8, 0.5)
        got = selection.grow_roc(table, candidates, ratio)
        assert [p["check"] for p in got] == _brute(rows, names, candidates, ratio, 0.0)
        points = selection.roc_points(table, [c for p in got for c in candidates if c[0] == p["check"]])
        assert [(round(t, 9), round(f, 9)) for t, f in points] == [(round(p["tpr"], 9), round(p["fpr"], 9)) for p in got]


def test_cover(spark):
    rows = [(True, 0b001, 5), (True, 0b110, 4), (True, 0b000, 2), (False, 0b010, 1), (False, 0b100, 1), (False, 0, 50)]
    got = selection.cover(spark.createDataFrame(rows, "truth boolean, mask long, n long").cache(), ["a", "b", "c"])
    assert got["tests"][0] == "a" and got["missed"] == 2
    assert len(got["tests"]) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "groups.csv").write_text("group,rule,check,comment\nR,Remove profile,x,\nR,Remove profile,y,\nS,Optional,z,\n")
    got = {(r.rule, r.group): r.checks for r in ingest.read_groups(spark, str(tmp_path / "groups.csv")).collect()}
    assert got == {("Remove profile", "R"): ["x", "y"], ("Optional", "S"): ["z"]}
    (tmp_path / "bad.csv").write_text("group,rule,check,comment\nR,Nonsense,x,\n")
    with pytest.raises(ValueError):
        ingest.read_groups(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "clim.txt").write_text("10.0 20.0 5 1 4.0 6.0 5.0 0.1\n10.0 20.0 5 13 4.0 6.0 -3.0 0.0\n")
    fields = {n: k for k, n in enumerate(("lat", "lon", "depth", "month", "q1", "q3", "median", "medcouple"))}
    for _ in range(2):
        grid = ingest.prepared_climatology(spark, str(tmp_path / "ready"), str(tmp_path / "clim.txt"), fields).collect()
        assert len(grid) == 2
    assert {(r.month, r.tmin, r.tmax) for r in grid if r.month is None} == {(None, -2.0, 33.0)}
    wide = spark.createDataFrame([(0.0, 1.0, 2.0), (5.0, 3.0, 4.0)], "depth double, north_min double, north_max double")
    assert sorted((r.region, r.depth, r.tmin, r.tmax) for r in ingest.long_ranges(wide).collect()) == [("north", 0.0, 1.0, 2.0), ("north", 5.0, 3.0, 4.0)]
    points = spark.createDataFrame([(0, 9.0), (1, 2.0), (2, 5.0), (3, 1.0)], "pos int, fpr double")
    assert sorted(r.pos for r in rates.cut_roc(points, 4.0).collect()) == [0]
    first = ingest.first_of_each(spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "uid long, seq int"), "seq")
    assert sorted((r.uid, r.seq) for r in first.collect()) == [(1, 1), (2, 3)]
