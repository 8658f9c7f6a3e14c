"""Inversions and stuck runs against plain versions, and their cost on long casts."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from soundings import schema
from soundings.functions import seawater
from soundings.operators import sequential


def _plain_disorder(z, spikes):
    qc = (z < 0) | (z > 11000)
    if len(z) <= 1:
        return qc
    whole = np.nan_to_num(z)
    if (whole == whole[0]).all():
        return np.ones(len(z), bool)
    left = [i for i in range(len(z)) if np.isfinite(z[i]) and not qc[i]]
    while True:
        bad = {i: [j for j in left if (i < j and z[i] >= z[j]) or (j < i and z[j] >= z[i])] for i in left}
        most = max((len(b) for b in bad.values()), default=0)
        if not most:
            return qc
        level = max(i for i, b in bad.items() if len(b) == most)
        gone = [level]
        if most == 1:
            gone = [k for k in (level, bad[level][0]) if spikes[k]] or [level, bad[level][0]]
        for k in gone:
            qc[k] = True
            left.remove(k)


def test_disorder_equals_the_plain_rule():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(0, 30))
        z = np.sort(rng.integers(-1, 60, n)).astype(float) if rng.random() < 0.7 else rng.integers(-2, 40, n).astype(float)
        for _ in range(int(rng.integers(0, 4))):
            if n:
                z[rng.integers(n)] = rng.choice([np.nan, 12000.0, 3.0, 45.0])
        spikes = rng.random(n) < 0.3
        with np.errstate(invalid="ignore"):
            assert (sequential.depths_out_of_order(z, spikes) == _plain_disorder(z, spikes)).all(), (z, spikes)


def test_inversions_are_counted_as_pairs_say():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 7, 64, 65, 200):
        d = rng.integers(0, 50, n).astype(float)
        want = [sum((j > i and d[i] >= d[j]) or (j < i and d[j] >= d[i]) for j in range(n)) for i in range(n)]
        assert sequential._inversions(d).tolist() == want


def test_a_cast_of_a_hundred_thousand_levels():
    n = 100_000
    rng = np.random.default_rng(7)
    z = np.arange(n) / 10.0
    at = rng.choice(n, 3000, replace=False)
    z[at] = rng.permutation(z[at])
    began = time.perf_counter()
    qc = sequential.depths_out_of_order(z, np.zeros(n, bool))
    assert time.perf_counter() - began < 30
    assert (np.diff(z[~qc]) > 0).all() and qc.sum() < 3001


def _plain_run(z, t, least):
    n = len(t)
    if n <= least:
        return None
    runs = [1] * n
    for i in range(n - least):
        while i + runs[i] < n and abs(t[i + runs[i]] - t[i]) <= 1e-4:
            runs[i] += 1
    i = max(range(n), key=lambda k: (runs[k], -k))
    return (i, i + runs[i] - 1) if runs[i] >= least and z[i + runs[i] - 1] - z[i] >= 200 else None


def test_stuck_runs_equal_the_plain_rule():
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(600):
        n = int(rng.integers(1, 60))
        t = 5 + np.cumsum(rng.choice([0.0, 0.0, 5e-5, -5e-5, 1e-4, 0.3], n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))
        z = np.cumsum(rng.integers(1, 60, n)).astype(float)
        want = _plain_run(z, t, 7)
        found += want is not None
        assert sequential.stuck_run(z, t, 7) == want
    assert found > 50


def test_stuck_levels_in_a_table(spark):
    """Windows let through every profile that has a run; no group of rows goes to Python."""
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for uid in range(120):
        n = int(rng.integers(1, 50))
        t = 5 + np.cumsum(rng.choice([0.0, 5e-5, -1e-4, 0.2], n, p=[0.7, 0.15, 0.1, 0.05]))
        z = np.cumsum(rng.integers(1, 50, n)).astype(float)
        run = _plain_run(z, t, 7)
        want |= {(uid, k) for k in range(run[0], run[1] + 1)} if run else set()
        rows += [(uid, k, float(z[k]), float(t[k])) for k in range(n)] + [(uid, n, -1.0, 5.0), (uid, n + 1, 4.0, None)]
    levels = spark.createDataFrame(rows, "uid long, lev int, z double, t double").repartition(4)
    heads = spark.createDataFrame([(u, 1 if u % 10 else 8) for u in range(120)], "uid long, probe int")
    out = sequential.stuck_value(levels, heads)
    got = {(r.uid, r.lev) for r in out.where("flag").collect()}
    assert got == {x for x in want if x[0] % 10} and out.count() == len(rows)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_profiles_judged_together_equal_those_judged_alone():
    rng = np.random.default_rng(3)
    for longest in (6, 40, 200):
        size = rng.integers(1, longest, 150)
        n = int(size.sum())
        z = np.cumsum(rng.integers(-20, 50, n)).astype(float) % 900 - 5
        t = np.round(28 - 0.03 * z + rng.choice([0, 0, 0, 15, -8, 3, -3], n) + rng.normal(0, 0.3, n), 1)
        for values, value, share in ((t, np.nan, 0.05), (z, np.nan, 0.03), (t, 0.0, 0.03), (t, 0.5, 0.1)):
            values[rng.random(n) < share] = value
        lat = np.where(rng.random(len(size)) < 0.1, np.nan, rng.uniform(-60, 60, len(size)))
        got, start = sequential._judged(z, t, lat, size), np.cumsum(size) - size
        with np.errstate(all="ignore"):
            for k, (a, m) in enumerate(zip(start, size, strict=True)):
                reject, suspect = sequential.spikes_and_steps(z[a : a + m], t[a : a + m], lat[k])
                want = reject, suspect, sequential.depths_out_of_order(z[a : a + m], reject)
                assert all((g[a : a + m] == w).all() for g, w in zip(got, want, strict=True)), (longest, k)


def test_temperatures_moved_together_equal_those_moved_alone():
    rng = np.random.default_rng(4)
    t, s, p0 = rng.uniform(-2, 30, 60), rng.uniform(30, 37, 60), np.concatenate([[0.0, 0.4, 1.0, 7.0], rng.uniform(0, 300, 56)])
    p1 = np.where(rng.random(60) < 0.5, 0.0, rng.uniform(0, 300, 60))
    got = seawater.moved_temperature.func(*map(pd.Series, (t, s, p0, p1)))
    for k in range(60):
        step, p, now, ds = (1.0 if p1[k] >= p0[k] else -1.0), p0[k], t[k], s[k] - 35
        before, first = now - seawater._lapse(now, ds, p) * step, True
        while first or (p - p1[k]) * (p - step - p1[k]) > 0:
            before, now, p, first = now, before + 2 * seawater._lapse(now, ds, p) * step, p + step, False
        assert abs(got[k] - ((p1[k] - p + step) * now + (p - p1[k]) * before) / step) < 1e-9, k


def test_views_lie_by_profile_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(schema, "LEVELS_A_TASK", 500)
    levels, profiles = (f(spark, "/root/testdata/sf0.001") for f in (schema.levels, schema.profiles))
    parts = -(-levels.count() // 500)
    sizes = levels.groupBy(F.spark_partition_id()).count().collect()
    assert levels.rdd.getNumPartitions() == profiles.rdd.getNumPartitions() == parts and max(r["count"] for r in sizes) < 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # one exchange of each table, whatever windows and joins follow
        plan = sequential.increasing_depth(levels, profiles)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_files_are_read_in_splits_of_bounded_size(spark, monkeypatch):
    """Spark holds all rows of a task that deals them out to more than 200 parts."""
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for least in (25, 50):
            monkeypatch.setattr(schema, "LEVELS_READ_A_TASK", 600_000 // least)
            schema.levels(spark, "/root/testdata/sf0.1")
            assert spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").rdd.getNumPartitions() >= least
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
        monkeypatch.undo()
        schema.levels(spark, "/root/testdata/sf0.001")
