"""Profiles whose flagged levels are known: fixed values that the checks must give."""

import re

import pytest

from soundings import schema
from soundings.functions import geo, seawater
from soundings.operators import gridded, local, rules, sequential
from soundings.plans import registry

NINE = [float(z) for z in range(100, 1001, 100)]
#: Check, temperatures, depths, header, salinities, pressures, flagged levels.
CASES = [
    ("a01_gross_range", [40.0000001, 40, 30, 20, 10, 0, -2.5, -2.5000001], [0, 10, -10, 20, 3000, 40, 50, 60], {}, None, None, [0, 2, 4, 7]),
    ("a02_constant", [0, 0, 0], [0, 1, 2], {}, None, None, [0, 1, 2]),
    ("a02_constant", [0], [0], {}, None, None, []),
    ("a03_gradient", [500000, 400000, 299999], [100000, 200000, 300000], {}, None, None, [1, 2]),
    ("a03_gradient", [480000, 500000, 520000], [100000, 200000, 299999], {}, None, None, [1, 2]),
    ("a03_gradient", [1.8, 1], [2, 1], {}, None, None, []),
    ("a04_spike", [20, 199, 200, 201, 16], [1, 2, 3, 4, 5], {}, None, None, [2, 3]),
    ("a04_spike", [20, 190, 18, 18, 18, 170, 16], [1, 2, 3, 4, 5, 5, 7], {}, None, None, [1, 5]),
    ("r01_global_range", [-2.500000001, -2.5, 40, 40.0000001], [100, 100, 100, 100], {}, None, None, [0, 3]),
    ("r02_gradient", [2, 11, 2], [100, 200, 300], {}, None, None, []),
    ("r02_gradient", [2, 11.0001, 2], [100, 200, 300], {}, None, None, [1]),
    ("r02_gradient", [2, 5.0001, 2], [1000, 2000, 3000], {}, None, None, [1]),
    ("r03_spike", [5, 11, 5], [100, 200, 300], {}, None, None, []),
    ("r03_spike", [5, 11.0001, 5], [100, 200, 300], {}, None, None, [1]),
    ("r03_spike", [5, 7.0001, 5], [1000, 2000, 3000], {}, None, None, [1]),
    ("r04_depth_increasing", [2, 2, 2], [100, 100, 100], {}, None, None, [1, 2]),
    ("r04_depth_increasing", [2, 2, 2], [100, 200, 100], {}, None, None, [1, 2]),
    ("r06_impossible_date", [0], [0], {"year": 1699, "month": 1, "day": 1}, None, None, [0]),
    ("r06_impossible_date", [0], [0], {"year": 2001, "month": 0, "day": 1}, None, None, [0]),
    ("r06_impossible_date", [0], [0], {"year": 2001, "month": 2, "day": 29}, None, None, [0]),
    ("r06_impossible_date", [0], [0], {"year": 2004, "month": 2, "day": 29}, None, None, []),
    ("r06_impossible_date", [0], [0], {"time": 24.0}, None, None, [0]),
    ("r07_impossible_location", [0], [0], {"lat": 91.0}, None, None, [0]),
    ("r07_impossible_location", [0], [0], {"lon": 181.0}, None, None, [0]),
    ("s01_constant_bottom", [0, 0, 0], [0, 100, 200], {"probe": 2}, None, None, [2]),
    ("s01_constant_bottom", [0, 0, 0], [0, 100, 200], {"probe": 2, "lat": -41.0}, None, None, []),
    ("s03_long_gradient", [20, 10, 15, 15, 15, 10], [0, 5, 10, 15, 20, 25], {}, None, None, [1]),
    ("s03_long_gradient", [20, 10, 15, 15, 15, 10], [0, 10, 20, 30, 40, 50], {}, None, None, []),
    ("s03_long_gradient", [20, 10, 15, 15, 15, 10], [0, 1, 6, 11, 16, 21], {}, None, None, []),
    ("s06_wire_break", [-2.399, -2.399, -2.4001], [10, 20, 30], {"probe": 2}, None, None, [2]),
    ("s06_wire_break", [31.99, 31.99, 32.001], [10, 20, 30], {"probe": 2}, None, None, [2]),
    ("s06_wire_break", [0, 32.01, 31.99], [10, 20, 30], {"probe": 2}, None, None, []),
    ("s06_wire_break", [9, 9, 10], [10, 20, 30], {"probe": 2}, None, None, [1, 2]),
    ("e01_range", [-4.00000001, -4, 40, 40.0000001], [100] * 4, {}, None, None, [0, 3]),
    ("e02_constant_value", [0] * 9 + [10], NINE, {}, None, None, list(range(10))),
    ("e02_constant_value", [0] * 8 + [10, 10], NINE, {}, None, None, []),
    ("e02_constant_value", [0] * 9 + [10], list(range(1, 11)), {}, None, None, []),
    ("e02_constant_value", [0] * 10, NINE[:9] + [None], {}, None, None, list(range(10))),
    ("e03_spike_and_step", [20, 24, 18, 17], [0, 10, 20, 30], {"lat": 20.0}, None, None, [1]),
    ("e03_spike_and_step", [22.5, 24, 22.5, 22], [500, 510, 520, 530], {"lat": 20.0}, None, None, [1]),
    ("e04_spike_and_step_suspect", [0, 0, 0, 0], [0, 10, 20, 30], {}, None, None, [0, 1, 2, 3]),
    ("e04_spike_and_step_suspect", [24, 24, 2, 1], [10, 20, 30, 40], {"lat": 20.0}, None, None, [1, 2]),
    ("e04_spike_and_step_suspect", [13, 13, 13, 1], [310, 320, 330, 340], {"lat": 50.0}, None, None, [3]),
    ("e04_spike_and_step_suspect", [0, 0, 0, 0], [10, 20, 30, 40], {"lat": 50.0}, None, None, [3]),
    ("e05_increasing_depth", [0] * 10, [-1, 200, 300, 400, 500, 600, 700, 800, 900, 1000], {}, None, None, [0]),
    ("e05_increasing_depth", [0] * 10, [100, 200, 300, 500, 500, 600, 700, 800, 900, 1000], {}, None, None, [3, 4]),
    ("e05_increasing_depth", [0] * 10, [100, 200, 300, 510, 500, 600, 700, 800, 900, 1000], {}, None, None, [3, 4]),
    ("e05_increasing_depth", [0] * 10, [100, 200, 300, 610, 500, 600, 700, 800, 900, 1000], {}, None, None, [3]),
    ("e05_increasing_depth", [0] * 50, [0] * 50, {}, None, None, list(range(50))),
    ("e06_stability", [13.5, 25.5, 20.4] + [13.5] * 6, list(range(0, 90, 10)), {}, [40, 35, 20] + [40] * 6, [8000, 2000, 1000] + [8000] * 6, [1, 2]),
    ("e06_stability", [13.5, 25.5, 20.4, 13.5], [0, 10, 20, 30], {}, [40, 35, 20, 40], [8000, 2000, 1000, 8000], [0, 1, 2, 3]),
    ("o02_gross_range", [0, 20, -5, 16, 101], [0, 1, 2, 3, 4], {}, None, None, [2, 4]),
    ("o03_gradient", [100, 130], [100, 200], {}, None, None, []),
    ("o03_gradient", [100, 130.00001], [100, 200], {}, None, None, [0, 1]),
    ("o03_gradient", [100, 30], [100, 200], {}, None, None, []),
    ("o03_gradient", [100, 29.9999], [100, 200], {}, None, None, [0, 1]),
    ("i01_level_order", [1, 2, 3], [2, -1, 1], {}, None, None, [1]),
]


@pytest.fixture(scope="module")
def tables(spark):
    head = {"year": 1999, "month": 12, "day": 31, "time": 0.0, "lat": 0.0, "lon": 0.0, "country": "X", "cruise": 1, "ocruise": "a", "probe": 1, "platform": None, "profile_type": None, "orig_flag_type": None, "training": 0, "flagged": 0}
    f = lambda v: None if v is None else float(v)
    profiles = [tuple({"uid": u, **head, **case[3]}.values()) for u, case in enumerate(CASES)]
    levels = [(u, k, f(z), f(t), f(s), f(p), 1) for u, (_, ts, zs, _, ss, ps, _) in enumerate(CASES) for k, (t, z, s, p) in enumerate(zip(ts, zs, ss or [None] * len(ts), ps or [None] * len(ts), strict=True))]
    return spark.createDataFrame(levels, schema.LEVELS).cache(), spark.createDataFrame(profiles, schema.PROFILES).cache()


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_flagged_levels(tables, name):
    levels, profiles = tables
    own = [u for u, c in enumerate(CASES) if c[0] == name]
    chosen = levels.where(levels.uid.isin(own)).repartition(3), profiles.where(profiles.uid.isin(own))
    rows = registry.run_checks(*chosen, [name]).collect()
    assert len(rows) == sum(len(CASES[u][1]) for u in own)
    for u in own:
        assert sorted(r.lev for r in rows if r.uid == u and r.flag) == CASES[u][6], CASES[u]


def test_all_checks_share_one_window_pass(tables):
    wide = local.run_local(*tables)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 2
    assert wide.count() == tables[0].count()


@pytest.mark.parametrize("name", ["r04_depth_increasing", "s05_surface_spikes", "e06_stability", "t09_smooth_residual", "t10_scaled_residual"])
def test_steps_sort_levels_once(tables, name):
    """Numbers of levels follow from their order, so no window sorts by them again."""
    plan = local.run(name, *tables)._jdf.queryExecution().sparkPlan().toString()
    plan += local.run(name, *tables)._jdf.queryExecution().executedPlan().toString()
    assert "lev#" in plan and not re.search(r"Sort \[uid#\d+L? ASC NULLS FIRST, i#", plan)


def test_long_gradients_without_a_join(spark):
    levels = schema.levels(spark, "/root/testdata/sf0.01")
    got = local.run("s03_long_gradient", levels, levels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    steps = spark.sql(local.check_sql("s03_long_gradient", local.SPARK), levels=levels)
    rows = lambda df: sorted(map(tuple, df.select("uid", "lev", "flag").collect()))
    assert rows(got) == rows(steps) and 0 < got.where("flag").count() < got.count()


@pytest.mark.parametrize("names", [("e01_range", "e02_constant_value", "e06_stability"), ("e02_constant_value",), ("o03_gradient", "r04_depth_increasing"), ("e06_stability", "r02_gradient", "s06_wire_break")])
def test_any_of_some_checks_in_one_pass(tables, names):
    rows = lambda df: sorted(map(tuple, df.select("uid", "lev", "flag").collect()))
    got, want = local.run_any(names, *tables), rules.any_flag([local.run(n, *tables) for n in names])
    assert rows(got) == rows(want) and any(r[2] for r in rows(got))


def test_constant_values(spark):
    """A value counts if it makes 90 % of all levels, those without a value included, over 100 m."""
    z = [None, *(13.0 * k for k in range(9))]
    cases = {1: [5.0] * 10, 2: [5.0] * 9 + [None], 3: [5.0] * 8 + [6.0, None], 4: [None] * 10, 5: [6.0] + [5.0] * 9, 6: [5.0] * 5 + [6.0] * 5}
    levels = spark.createDataFrame([(u, k, z[k], t, None, None, 1) for u, ts in cases.items() for k, t in enumerate(ts)] + [(7, 0, 1.0, 2.0, None, None, 1)], schema.LEVELS)
    assert {r.uid for r in local.constant_profiles(levels).collect()} == {1, 5}  # from 2 the deepest level is missing: 91 m
    assert {r.uid for r in local.run("e02_constant_value", levels, levels).where("flag").collect()} == {1, 5}


def test_formulas(spark):
    from pyspark.sql import functions as F

    lit = lambda *x: [F.lit(float(v)) for v in x]
    row = spark.range(1).select(
        seawater.density(*lit(35, 25, 2000)).alias("d1"), seawater.density(*lit(20, 20, 1000)).alias("d2"), seawater.density(*lit(40, 12, 8000)).alias("d3"),
        seawater.potential_temperature(*lit(35, 20, 2000)).alias("pt"), seawater.t48_to_t68(F.lit(100.0)).alias("t68"), seawater.t68_to_t90(F.lit(10.0)).alias("t90"),
        seawater.depth_to_pressure(*lit(10000, 30)).alias("p"), seawater.pressure_to_depth(*lit(10000, 30)).alias("z"), seawater.moved_temperature(*lit(10, 35, 1000, 0)).alias("m"),
        geo.normal_latitude(F.lit(91.0)).alias("n1"), geo.normal_latitude(F.lit(-93.0)).alias("n2"),
        geo.nearest_index(F.array(*lit(10, 11, 12, 13, 14)), F.lit(12.1)).alias("i"), geo.bracket_partner(F.array(*lit(10, 11, 12, 13, 14)), F.lit(12.1)).alias("j"),
        geo.grid_index(geo.normal_latitude(F.lit(121.0)), -90.0, 30.0, 7).alias("ilat"), geo.grid_index(F.lit(421.0), 0.0, 60.0, 6, cyclic=True).alias("ilon"),
        geo.in_region(*lit(35, 18), *gridded.MEDITERRANEAN).alias("med"), geo.in_region(*lit(0, -30), *gridded.MEDITERRANEAN).alias("out"),
    ).first()
    for got, want in ((row.d1, 1031.654229), (row.d2, 1017.726743), (row.d3, 1062.928258), (row.pt, 19.621967)):
        assert abs(got - want) < 1e-5
    assert row.t68 == 100 and abs(row.t90 - 9.9976) < 1e-9
    assert abs(row.p - 10300.98) < 10 and abs(row.z - 9713.7) < 10
    assert 9.8 < row.m < 9.95
    assert (row.n1, row.n2, row.i, row.j, row.ilat, row.ilon) == (89, -87, 2, 3, 5, 1)
    assert row.med and not row.out


def test_stuck_run():
    import numpy as np

    z = np.arange(0.0, 600, 20)
    t = np.where((z >= 100) & (z <= 400), 5.0, z / 10)
    assert sequential.stuck_run(z, t, 7) == (5, 20)
    assert sequential.stuck_run(z[:7], t[:7], 7) is None


def test_centres_ranked_alike(spark):
    """At a pole all centres are as near, at a corner four: the least numbers count, and the cell that holds the place may be none of them."""
    corner = lambda a, o: [(a - 5, o - 5), (a - 5, o + 5), (a + 5, o + 5), (a + 5, o - 5)]
    rows = [(k, float(k // 36 * 10 - 85), float(k % 36 * 10 - 175), corner(k // 36 * 10 - 85.0, k % 36 * 10 - 175.0)) for k in range(648)]
    cells = spark.createDataFrame(rows, "cell int, lat double, lon double, corners array<struct<lat: double, lon: double>>")
    places = [(1, -90.0, 24.0), (2, -90.0, -171.0), (3, -89.9, 24.0), (4, 0.0, 100.0), (5, 81.0, 179.0)]
    got = {r.uid: r.cell for r in gridded.hex_cells(spark.createDataFrame(places, "uid long, lat double, lon double"), cells).collect()}
    assert got == {2: 0, 3: 20, 5: 647}  # the cells of 1 and 4 come after others as near
