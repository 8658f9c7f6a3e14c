"""Buddies in crowded cells against all pairs."""

import math
import random

import pytest

from soundings.operators import buddy

SCHEMA = "uid long, year int, month int, cruise long, lat double, lon double"


def _metres(a, b):
    h = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
    return 2 * 6367000.0 * math.asin(min(1.0, math.sqrt(h)))


def _plain(rows):
    out = {}
    for a in rows:
        near = [(_metres(a, b), b[0]) for b in rows if a[0] != b[0] and a[1:3] == b[1:3] and None not in (a[3], b[3]) and a[3] != b[3] and abs(a[4] - b[4]) <= 5]
        near = [x for x in near if x[0] <= 400_000]
        if near:
            out[a[0]] = min(near)
    return out


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_crowds_at_several_scales(spark, leaf):
    rng = random.Random(leaf)
    rows, uid = [], 0

    def add(lat, lon, cruise, month=1):
        nonlocal uid
        rows.append((uid, 2000, month, cruise, lat, lon))
        uid += 1

    for _ in range(150):  # a crowd within metres, mostly of one cruise
        add(10 + rng.random() * 1e-4, 20 + rng.random() * 1e-4, 1 if rng.random() < 0.95 else rng.randint(2, 4))
    for _ in range(80):  # a crowd of one cruise and another one some way off: each must find the other
        add(40 + rng.random() * 0.01, 179.9 + rng.random() * 0.05, 5, 2)
        add(42 + rng.random() * 0.01, -179.9 + rng.random() * 0.05, 6, 2)
    for _ in range(60):  # one place, many cruises
        add(-30.0, 50.0, rng.randint(1, 40), 3)
    for _ in range(60):  # around a pole, and beyond it
        add(rng.choice([89.0, 89.5, 90.5, 88.0]) + rng.random() * 0.1, rng.uniform(-180, 180), rng.randint(1, 3), 4)
    for _ in range(120):
        add(rng.uniform(-60, 60), rng.uniform(-180, 360), rng.randint(1, 9), 5)
    rows += [(uid, 2000, 1, None, 10.0, 20.0), (uid + 1, 2000, 1, 9, None, 20.0)]
    got = {r.uid: (r.metres, r.buddy) for r in buddy.buddies(spark.createDataFrame(rows, SCHEMA).repartition(4), leaf).collect()}
    want = _plain([r for r in rows if r[4] is not None])
    assert set(got) == set(want)
    for u, (metres, other) in want.items():
        assert got[u][1] == other or abs(got[u][0] - metres) < 1e-6, (u, got[u], want[u])
        assert got[u][0] == pytest.approx(metres, abs=1e-5)


def test_a_hundred_thousand_headers_in_one_cell(spark):
    from pyspark.sql import functions as F

    n = 100_000
    heads = spark.range(n).select(
        F.col("id").alias("uid"), F.lit(2001).alias("year"), F.lit(7).alias("month"), (F.col("id") % 50).alias("cruise"),
        (10 + F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6).alias("lat"), (20 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6).alias("lon"),
    )
    found = buddy.buddies(heads)
    got = {r.uid: (r.buddy, r.metres) for r in found.collect()}
    assert len(got) == n
    rows = [(r.uid, 2001, 7, r.cruise, r.lat, r.lon) for r in heads.collect()]
    for a in random.Random(2).sample(rows, 40):
        metres, other = min((_metres(a, b), b[0]) for b in rows if b[3] != a[3])
        assert got[a[0]][0] == other and got[a[0]][1] == pytest.approx(metres, abs=1e-4)


def test_equally_near_to_the_millimetre(spark):
    """Two places as far to the east as to the west, which rounding puts apart: the first uid is the buddy."""
    place = lambda u: (u, 2001, 7, u % 50, u * 37 % 1840 / 10 - 92, u * 73 % 3640 / 10 - 182)
    found = buddy.buddies(spark.createDataFrame([place(u) for u in (99, 38739, 77379)], SCHEMA)).collect()
    assert next(r for r in found if r.uid == 38739).buddy == 99


def test_a_buddy_at_an_unknown_time_changes_nothing(spark):
    """The 31st of February is no date: the probability of the profile's own difference (0.58) stays."""
    names = "uid long, cruise long, year int, month int, day int, time double, lat double, lon double, probe int"
    levels = spark.createDataFrame([(1, 0, 25.0, 3.652), (2, 0, 25.0, 3.652)], "uid long, lev int, z double, diff double")
    errors = spark.createDataFrame([(1, 2, 1.0, 0.5, 23.5), (2, 2, 2.0, 0.5, 23.5)], "uid long, k int, bgev double, obev double, clim double")
    for day, want in ((31, {1: True, 2: False}), (20, {1: False, 2: False})):
        heads = spark.createDataFrame([(1, 1, 1990, 2, day, 3.0, 40.0, 0.0, 3), (2, 2, 1990, 2, day, 3.0, 41.0, 0.0, 5)], names)
        assert {r.uid: r.flag for r in buddy.buddy_check(levels, heads, errors, (5.0, 15.0, 25.0)).collect()} == want, day


@pytest.mark.parametrize("leaf", [8, 32])
def test_no_table_of_profiles_is_broadcast(spark, leaf, monkeypatch):
    """Spark takes what is exploded from few bytes of headers for small; the driver would have to hold a row for each cell around each profile."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut = buddy.cut
    monkeypatch.setattr(buddy, "cut", lambda df: (cut(df), plans.append(plan(df)))[0])
    found = buddy.buddies(spark.createDataFrame([(u, 2000, 1, u % 3, 10 + u / 20, 20 + u / 20) for u in range(30)], SCHEMA), leaf)
    assert len(found.collect()) == 30 and bool(plans) == (leaf < 30)
    assert not any("Broadcast" in x for x in [*plans, plan(found)])
