"""Operators over tables against plain versions: registry, prior union, fuzzy sets, buddies, splits, growth by levels."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings import queries, schema
from soundings.operators import buddy, gridded, local, rates, rules, selection, sequential
from soundings.plans import registry
from soundings.sources import ingest
from soundings.streaming.profiles import flag_ranges

HEAD = {"year": 1999, "month": 12, "day": 31, "time": 0.0, "lat": 0.0, "lon": 0.0, "country": "X", "cruise": 1, "ocruise": "a", "probe": 1, "platform": None, "profile_type": None, "orig_flag_type": None, "training": 0, "flagged": 0}


def _headers(spark, rows):
    return spark.createDataFrame([tuple({"uid": u, **HEAD, **own}.values()) for u, own in rows], schema.PROFILES)


@pytest.fixture(scope="module")
def cast(spark):
    """Random casts with spikes, missing values and depths out of order; headers that are missing or repeat."""
    rng = random.Random(5)
    levels = []
    for u in range(40):
        z = 0.0
        for k in range(rng.randint(1, 30)):
            z += rng.choice([5, 10, 40, 120]) if rng.random() < 0.92 else -30
            t = None if rng.random() < 0.05 else round(18 - z / 200 + rng.gauss(0, 0.3) + (9 if rng.random() < 0.06 else 0), 2)
            levels.append((u, k, None if rng.random() < 0.03 else z, t, 35.0, None, rng.choice([1, 1, 1, 4])))
    heads = [(u, {"lat": float(rng.randint(-60, 60)), "lon": float(rng.randint(-170, 170)), "cruise": u % 4 or None, "probe": rng.choice([1, 2, 4])}) for u in range(38)]
    return spark.createDataFrame(levels, schema.LEVELS).repartition(3).cache(), _headers(spark, heads + heads[:2]).repartition(2).cache()


def test_sequential_flags(cast):
    """The window tests let no profile pass that the state machine would flag; a level without a header is judged too."""
    levels, profiles = cast
    lat = {r.uid: r.lat for r in profiles.collect()}
    rows = {}
    for r in levels.orderBy("lev").collect():
        rows.setdefault(r.uid, []).append(r)
    want = {}
    for u, own in rows.items():
        z, t = (np.array([math.nan if r[c] is None else r[c] for r in own], float) for c in ("z", "t"))
        with np.errstate(all="ignore"):
            reject, suspect = sequential.spikes_and_steps(z, t, lat.get(u, math.nan))
            disorder = sequential.depths_out_of_order(z, reject)
        want |= {(u, r.lev): f for r, f in zip(own, zip(reject.tolist(), suspect.tolist(), disorder.tolist(), strict=True), strict=True)}
    got = sequential.sequential_flags(levels, profiles).collect()
    assert len(got) == levels.count() and {(r.uid, r.lev): (r.reject, r.suspect, r.disorder) for r in got} == want
    assert any(f[0] for f in want.values()) and any(f[2] for f in want.values())
    assert sequential.sequential_flags(levels.limit(0), profiles).count() == 0


def test_depth_order_by_brute_force():
    """Against counts made anew after each removal."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(2, 14))
        z = np.cumsum(rng.integers(0, 9, n)).astype(float)
        z[rng.random(n) < 0.3] -= rng.integers(0, 20)
        z[rng.random(n) < 0.1] = np.nan
        spikes, left, qc = rng.random(n) < 0.2, [k for k in range(n) if 0 <= z[k] <= 11000], (z < 0) | (z > 11000)
        whole = np.nan_to_num(z)
        out = lambda a, b: z[a] >= z[b] if a < b else z[a] <= z[b]  # noqa: B023, E731
        while True:
            count = {a: sum(out(a, b) for b in left if b != a) for a in left}
            most = max(count.values(), default=0)
            if (whole == whole[0]).all() or not most:
                break
            a = max(k for k in left if count[k] == most)
            gone = [a]
            if most == 1:
                b = max(b for b in left if b != a and out(a, b))
                gone = [k for k in (a, b) if spikes[k]] or [a, b]
            qc[gone] = True
            left = [k for k in left if k not in gone]
        with np.errstate(all="ignore"):
            got = sequential.depths_out_of_order(z, spikes)
        assert got.tolist() == ([True] * n if (whole == whole[0]).all() else qc.tolist())


def test_every_check_by_name(spark, cast):
    """All sixty run by name from one call with their reference tables; each gives one flag per level."""
    levels, profiles = cast
    levels, profiles = levels.where("uid < 6 OR uid > 36"), profiles.where("uid < 6 OR uid > 36")
    sql = lambda text: spark.sql(text, **({"profiles": profiles} if "{profiles}" in text else {}))
    square = F.array(*(F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + b).alias("lon")) for a, b in ((-5, -5), (-5, 5), (5, 5), (5, -5))))
    cells = spark.sql("SELECT CAST(id AS INT) AS cell, CAST(floor(id / 36) * 10 - 85 AS DOUBLE) AS lat, CAST(id % 36 * 10 - 175 AS DOUBLE) AS lon FROM range(648)").withColumn("corners", square)
    ranges = spark.sql("SELECT CAST(c.id AS INT) AS i, CAST(d.id AS INT) AS j, CAST(m.id + 1 AS INT) AS month, 0 AS k, 0D AS tmin, 30D AS tmax FROM range(2) c, range(2) d, range(2) m")
    refs = {
        "background": sql(queries.BACKGROUND_SQL), "standard_depths": queries.DEPTHS, "relief": sql(queries.RELIEF_SQL), "relief_axes": ((-90.0, 10.0, 19), (0.0, 10.0, 36)), "climatology": sql(queries.POINTS_SQL),
        "envelope": ((-1.0, 500.0, 0.0, 25.0),), "laws": queries.LAWS, "memberships": queries.MEMBERSHIPS, "narrow_memberships": queries.NARROW, "monthly": sql(queries.MONTHLY_SQL), "annual": sql(queries.ANNUAL_SQL),
        "depth_edges": queries.EDGES, "monthly_ranges": ranges, "annual_ranges": ranges.drop("month").distinct(), "regions": sql(queries.REGIONS_SQL), "region_ranges": sql(queries.RANGES_SQL), "cells": cells,
        "cell_ranges": spark.sql("SELECT CAST(id AS INT) AS cell, 0D AS lo, 900D AS hi, 5D AS tmin, 20D AS tmax FROM range(648)"),
    }
    assert len(registry.names()) == 60
    total = levels.count()
    for part in itertools.batched(registry.names(), 20):
        counts = registry.run_checks(levels, profiles, part, refs).groupBy("check").agg(F.count("*").alias("n"), F.count_distinct("uid", "lev").alias("own"), F.count("flag").alias("known")).collect()
        assert {r["check"]: (r.n, r.own, r.known) for r in counts} == {c: (total, total, total) for c in part}
    assert registry.run_checks(levels, profiles, []).count() == 0
    with pytest.raises(KeyError):
        registry.run_checks(levels, profiles, ["o01_below_bottom"])
    registry.register_check("x_own", lambda lv, pr, refs: pr.select("uid", (F.col("probe") == 2).alias("flag")), "profile")
    try:
        own = registry.run_checks(levels, profiles, ["x_own"])
        assert own.count() == total and own.where("flag").select("uid").distinct().count() == profiles.where("probe = 2").select("uid").distinct().count()
    finally:
        del registry._CHECKS["x_own"]


def test_prior_union(cast):
    """The union of six checks, level by level, and what passes it."""
    levels, profiles = cast
    grid = levels.sparkSession.sql(queries.BACKGROUND_SQL)
    found = sequential.sequential_flags(levels, profiles)
    near = gridded.background(levels, profiles, grid, found)
    parts = [near, found.select("uid", "lev", F.col("reject").alias("flag")), found.select("uid", "lev", F.col("disorder").alias("flag")), *(local.run(n, levels, profiles) for n in ("e01_range", "e02_constant_value", "e06_stability"))]
    want = {(r.uid, r.lev) for p in parts for r in p.where("flag").collect()}
    prior = buddy.prior_flags(levels, profiles, near, found)
    assert {(r.uid, r.lev) for r in prior.where("flag").collect()} == want and prior.count() == levels.count()
    assert {(r.uid, r.lev) for r in rules.passed(levels, prior).collect()} == {(r.uid, r.lev) for r in levels.collect()} - want
    assert buddy.standard_level_check(levels, profiles, grid, queries.DEPTHS).count() == levels.count()


def test_headers_missing_and_repeated(cast):
    levels, profiles = cast
    total = levels.count()
    for name in ("r06_impossible_date", "s05_surface_spikes", "i07_spike", "e06_stability", "a03_gradient"):
        rows = local.run(name, levels, profiles).collect()
        assert len(rows) == total and not any(r.flag for r in rows if r.uid >= 38 and name == "r06_impossible_date")
    assert gridded.regional_range(levels, profiles).count() == gridded.at_sea(levels, profiles, levels.sparkSession.sql(queries.RELIEF_SQL), *queries._TENS).count() == total


def test_fuzzy_sets(spark):
    rng = random.Random(3)
    rows = [(k, 0, *(None if rng.random() < 0.15 else rng.uniform(0, 8) for _ in range(3))) for k in range(60)] + [(99, 0, None, None, None)]
    df = spark.createDataFrame(rows, "uid long, lev int, gradient double, spike double, rate double")
    columns = {n: F.col(n) for n in ("gradient", "spike", "rate")}
    ramp = lambda x, a, b: max(0.0, min(1.0, (x - a) / (b - a)))
    over = lambda x, c: ramp(x, *c) if len(c) == 2 else min(ramp(x, c[0], c[1]), ramp(x, c[3], c[2]))
    got = {r.uid: r.uncertainty for r in gridded.uncertainty(df, columns, queries.MEMBERSHIPS).collect()}
    laws = {r.uid: r.flag for r in gridded.anomaly(df, columns, queries.LAWS, -6.0).collect()}
    for uid, _, *values in rows:
        known = {n: v for n, v in zip(columns, values, strict=True) if v is not None}
        if not known:
            assert got[uid] is None and not laws[uid]
            continue
        held = {s: [over(v, queries.MEMBERSHIPS[n][s]) for n, v in known.items()] for s in gridded.UNCERTAINTY}
        strength = {s: max(x) if s == "high" else sum(x) / len(x) for s, x in held.items()}
        area = [max(min(strength[s], over(k / gridded._STEPS, c)) for s, c in gridded.UNCERTAINTY.items()) for k in range(gridded._STEPS + 1)]
        half = next((k for k in range(len(area)) if sum(area[: k + 1]) >= sum(area) / 2 - 1e-9), None) if sum(area) else None
        assert got[uid] == (None if half is None else half / gridded._STEPS)
        total = sum(math.log(max(1 - (1 - math.exp(-(max((v - p) / s, 0.0) ** c))) ** a, 1e-300)) for n, v in known.items() for a, c, p, s in [queries.LAWS[n]])
        assert laws[uid] == (total < -6.0)


def test_shared_nodes_are_made_once(cast, spark, monkeypatch):
    """All of a run's checks take the sequential pass and the background from one node each; the flags are those of each check alone."""
    levels, profiles = cast
    made = []
    for module, name in ((sequential, "sequential_flags"), (gridded, "background"), (local, "run_local")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: made.append(n) or f(*a, **k))
    refs = {"background": spark.sql(queries.BACKGROUND_SQL), "standard_depths": queries.DEPTHS}
    names = ["e03_spike_and_step", "e04_spike_and_step_suspect", "e05_increasing_depth", "e07_background", "e09_standard_levels_and_buddies", "e01_range", "a03_gradient", "e06_stability"]
    run = registry.CheckRun(levels, profiles, names, refs)
    flags = run.flags()
    assert sorted(made) == ["background", "run_local", "sequential_flags"]
    assert {n for n, k in run.uses.items() if k > 1} == {"sequential", "background", "neighbours", "e06_stability"} & set(run.uses)
    got = {(r.check, r.uid, r.lev): r.flag for r in flags.collect()}
    cached = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in cached
    run.release()
    for name in names:
        alone = {(name, r.uid, r.lev): r.flag for r in registry.run_checks(levels, profiles, [name], refs).collect()}
        assert alone == {k: v for k, v in got.items() if k[0] == name}
    assert any(v for k, v in got.items() if k[0] == "e07_background")


def test_buddies_by_all_pairs(spark):
    """Cells of longitude lose no pair, across the date line and near the poles; a profile may have no buddy."""
    rng = random.Random(8)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    places += [(a + rng.uniform(-2, 2), o + rng.uniform(-4, 4)) for a, o in places] + [(89.0, o) for o in range(-180, 180, 60)] + [(a, 179.9) for a in range(-80, 81, 20)] + [(a + 0.3, -179.8) for a in range(-80, 81, 20)]
    heads = [(u, {"lat": float(max(-90.0, min(90.0, a))), "lon": float(o), "cruise": u % 7}) for u, (a, o) in enumerate(places)]
    rad = math.radians

    def metres(p, q):
        h = math.sin(rad(q["lat"] - p["lat"]) / 2) ** 2 + math.cos(rad(p["lat"])) * math.cos(rad(q["lat"])) * math.sin(rad(q["lon"] - p["lon"]) / 2) ** 2
        return 2 * 6_367_000.0 * math.asin(min(1.0, math.sqrt(h)))

    want = {}
    for u, p in heads:
        near = [(metres(p, q), v) for v, q in heads if v != u and p["cruise"] != q["cruise"] and abs(p["lat"] - q["lat"]) <= 5]
        if near and min(near)[0] <= buddy.REACH_M:
            want[u] = min(near)
    got = {r.uid: (r.metres, r.buddy) for r in buddy.buddies(_headers(spark, heads)).collect()}
    assert got.keys() == want.keys() and all(abs(got[u][0] - want[u][0]) < 1e-3 and abs(metres(dict(heads)[u], dict(heads)[got[u][1]]) - want[u][0]) < 1e-3 for u in want)


def test_split_and_ranks(spark):
    rng = random.Random(1)
    for parts in (1, 3, 7):
        rows = [(k, c, rng.randint(1, 40)) for k, c in enumerate(sorted(rng.choices([None, *range(25)], k=90), key=lambda c: -1 if c is None else c))]
        df = spark.createDataFrame(rows, "uid long, cruise long, size int").repartition(4)
        share, want, part, filled, last = math.ceil(sum(s for *_, s in rows) / parts), {}, 0, 0, None
        for uid, cruise, size in rows:
            if filled > share and cruise != last and None not in (cruise, last):
                part, filled = part + 1, 0
            want[uid], last = part, cruise
            filled += size
        assert {r.uid: r.part for r in ingest.split_by_cruise(df, parts).collect()} == want
    for ranges in (1, 5, 200):
        got = {r.uid: r.before for r in ingest.ranked(df, "uid", F.col("size"), ranges).collect()}
        assert got == {u: sum(s for v, _, s in rows if v < u) for u, _, _ in rows}
    slices = [[r.uid for r in ingest.batch(df, k, 40).collect()] for k in range(3)]
    assert sorted(itertools.chain(*slices)) == sorted(u for u, *_ in rows) and [len(s) for s in slices] == [40, 40, 10]
    flags = df.select("uid", F.lit(0).alias("lev"), (F.col("size") > 20).alias("flag"))
    joined = [r for k in range(3) for r in flags.join(ingest.batch(df, k, 40).select("uid"), "uid").groupBy("uid").agg(F.bool_or("flag").alias("flag")).collect()]
    assert {r.uid: r.flag for r in joined} == {u: s > 20 for u, _, s in rows}  # results do not depend on the batches
    marked = ingest.mark_training(df, df.where("uid < 30"))
    assert sorted(r.uid for r in ingest.held_out(marked).collect()) == list(range(30, 90))


def test_growth_by_levels(spark, tmp_path):
    """Against the same rounds in plain Python: chosen checks remove levels before the next one is rated."""
    rng = random.Random(6)
    checks = ["a", "b", "c", "d"]
    rows = [(u, k, rng.choice([1, 1, 1, 4]), rng.choice([1, 2]), *(rng.random() < p for p in (0.05, 0.1, 0.02, 0.15))) for u in range(60) for k in range(6)]
    rows = [(u, k, t, 2 if u % 5 == 0 else 1, *(f or (t == 4 and rng.random() < 0.3) for f in flags)) for u, k, t, _, *flags in rows]
    df = spark.createDataFrame(rows, "uid long, lev int, truth int, probe int, a boolean, b boolean, c boolean, d boolean").cache()
    groups, ratio, gain = {"first": ["b", "c"]}, (0.5, 0.5), 1.0
    got = selection.grow_by_levels(df, checks, groups, (), ratio, gain, pad=0)
    chosen, waiting = [], [["b", "c"]]
    while True:
        left = rules.apply_rules(df, [(c, "levels") for c in chosen], 0, True).collect()
        truth = {u: any(r.truth in (3, 4) for r in left if r.uid == u) for u in {r.uid for r in left}}
        pool, enforced = (waiting.pop(0), True) if waiting else (checks, False)
        scored = []
        for c in (c for c in checks if c in pool and c not in chosen):
            hit = {u: any(r[c] for r in left if r.uid == u) for u in truth}
            share = lambda bad: 100.0 * sum(hit[u] for u in truth if truth[u] == bad) / (sum(truth[u] == bad for u in truth) or 1)  # noqa: B023, E731
            scored.append((selection.cost(ratio, share(True), share(False)), share(True), c))
        best = min(scored, key=lambda x: x[0], default=None)
        if best and not enforced and (best[0] > selection.cost(ratio, 0, 0) or best[1] < gain):
            best = None
        if best is None:
            break
        chosen.append(best[2])
    assert [p["check"] for p in got] == chosen and got[0]["enforced"] and len(got) >= 2
    first = spark.createDataFrame([tuple(p[k] for k in ("pos", "check", "tpr", "fpr", "enforced")) for p in got], "pos int, check string, tpr double, fpr double, enforced boolean")
    ingest.store_selection(first, str(tmp_path / "selection"))
    assert sorted(ingest.read_selection(spark, str(tmp_path / "selection")).collect()) == sorted(first.collect())


def test_inverted_and_two_rounds(spark):
    rows = [(bool(k % 3 == 0), k % 2 == 0, k % 5 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "truth boolean, a boolean, b boolean")
    table, names = selection.search_table(df, ["a", "b"], with_inverted=True)
    assert names == ["a", "b", "ra", "rb"]
    found = {p["check"]: p for p in selection.grow_roc(table.cache(), [(n, 1 << k) for k, n in enumerate(names)], (0.5, 0.5))}
    single = dict(zip(names, selection._evaluate(table, [], [1, 2, 4, 8]), strict=True))
    assert all(abs(single[f"r{n}"][k] - (100 - single[n][k])) < 1e-9 for n in ("a", "b") for k in (0, 1)) and found
    twice = {n for n, _ in selection.pairings(table, names[:3], rounds=2)}
    assert {"a", "a&b", "a&b&ra"} - twice <= {"a&b&ra"}  # a check and its inverse never hold together
    with pytest.raises(ValueError):
        selection.subset_rates(table, selection.MOST_CHECKS + 1)


def test_wire_break_shorthand(spark):
    rows = [(1, k, k + 1, 1, k == 2, False) for k in range(6)]
    df = spark.createDataFrame(rows, "uid long, lev int, truth int, probe int, wire boolean, odd boolean")
    assert sorted(r.truth for r in rules.apply_rules(df, [("odd", "levels")], wire_break="wire").collect()) == [1, 2]
    assert sorted(r.truth for r in rules.apply_rules(df, [("wire", "below")], wire_break="wire").collect()) == [1, 2]


def test_best_in_one_pass(spark):
    df = spark.createDataFrame([("a", 10.0, 0.0), ("b", 90.0, 50.0), ("c", 90.0, 20.0), ("d", 0.0, 0.0)], "check string, tpr double, fpr double")
    assert {r.criterion: r.check for r in rates.best(df).collect()} == {"lowest_fpr": "a", "highest_tpr": "b", "nearest": "c"}
    assert rates.best(df.where("check = 'd'")).count() == 2 and rates.best(df.limit(0)).count() == 0


def test_stream_of_profiles(spark, tmp_path):
    kind = "uid long, levels array<struct<z:double,t:double>>"
    spark.createDataFrame([(1, [(0.0, 5.0), (1.0, 50.0)]), (2, [(0.0, None)]), (3, None)], kind).write.parquet(f"{tmp_path}/in")
    stream = flag_ranges(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.uid: r.flags for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: [False, True], 2: [False], 3: None}


def test_profiles_are_merged_with_their_levels(cast, spark):
    """What is known of each profile is no broadcast, however few its shuffled bytes: packed columns shrink in a shuffle only."""
    levels, profiles = cast
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    grid = profiles.selectExpr("lat", "lon", "explode(array(0d, 200d)) AS depth", "10d AS mean", "1d AS sd")
    assert "BroadcastExchange" not in plan(gridded.climatology(levels, profiles, grid))
    cells = spark.range(684).selectExpr("int(id / 36) AS ilat", "int(id % 36) AS ilon", "0d AS depth", "9d AS clim", "1d AS bgev", "1d AS obev")
    assert plan(gridded.background_available(levels, profiles, cells)).split("Initial Plan")[0].count("SortMergeJoin") == 1


def _broadcast_by_profile(monkeypatch, make):
    """Joins of what a check runs that broadcast a table by profile, those of its cut parts included."""
    plans, plan, cut = [], lambda df: df._jdf.queryExecution().executedPlan().toString(), buddy.cut
    monkeypatch.setattr(buddy, "cut", lambda df: (cut(df), plans.append(plan(df)))[0])
    found = make()
    found.collect()
    return [x for p in (*plans, plan(found)) for x in re.findall(r"BroadcastHashJoin \[(?:uid|buddy|year)", p)]


def test_standard_levels_broadcast_no_profiles(cast, monkeypatch):
    grid = cast[0].sparkSession.sql(queries.BACKGROUND_SQL)
    assert not _broadcast_by_profile(monkeypatch, lambda: buddy.standard_level_check(*cast, grid, queries.DEPTHS))


def test_single_checks_broadcast_no_headers(cast):
    found = local.run("e06_stability", *cast)
    assert found.collect() and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_areas_are_halved_in_batches(cast):
    """No list of heights is made and folded for each level by itself."""
    rows, found = gridded.features(cast[0])
    plan = gridded.fuzzy(rows, found, queries.NARROW)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan
