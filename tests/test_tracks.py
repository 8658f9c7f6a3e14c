"""Which end of a too fast segment goes, on tracks along a meridian."""

import numpy as np
import pytest

from soundings.operators.track import Track, bad_positions, track_check

#: Rule, position, first hour, latitudes, position to reject.
CASES = [
    ("a", 1, 0, [0, 0.01, 1], 1), ("a", 1, 0, [0, 0.5, 1, 0.5], 1), ("a", 1, 0, [0, 0.5, 2], 0), ("a", 1, 0, [0, 0.5, 1], 0),
    ("a", 5, 5, [16, 16.5, 17, 18.5, 19.49, 19.5], 4), ("a", 5, 5, [16, 16.5, 17, 17.5, 17, 16.5], 4), ("a", 5, 5, [16, 16.5, 17, 17.5, 18, 18.5], 5),
    ("b", 4, 5, [16, 16.5, 17, 18, 19, 19.5], 3), ("b", 4, 5, [16, 16.5, 17, 17.5, 18.5, 19.5], 4),
    ("c", 4, 5, [16, 16.5, 17, 17.5, 18.5, 19.5], 3), ("c", 4, 5, [15.5, 16, 16.5, 17.5, 18.5, 18.5], 4),
    ("d", 4, 5, [16, 16.5, 17, 17.5, 16.5, 16], 3), ("d", 4, 5, [16, 16.5, 17, 17.5, 18.5, 18], 4),
    ("e", 4, 5, [16, 16.5, 17, 16.5, 16, 15.5, 15], 3), ("e", 4, 5, [16, 16.5, 17, 17.5, 18, 18.5, 18], 4),
    ("f", 4, 5, [16, 16.5, 17, 17, 18, 18.5], 3), ("f", 4, 5, [16, 16.5, 17, 17.5, 18.5, 18.5], 4),
    ("g", 4, 5, [16, 16.5, 18, 10, 18, 18], 3), ("g", 4, 5, [16, 16.5, 18, 18, 10, 18], 4),
    ("h", 4, 5, [16, 16.5, 17, 17, 18, 18.5], 3), ("h", 4, 5, [16, 16.5, 17, 17.5, 18.5, 18.5], 4),
]


@pytest.mark.parametrize("rule,index,hour,lats,reject", CASES)
def test_rules(rule, index, hour, lats, reject):
    lat = np.array(lats, float)
    track = Track(3600.0 * (hour + np.arange(len(lat))), lat, np.full(len(lat), 90.0), 15.0)
    if rule == "f":  # the mean speed of segments without a time gap is 0 here, as the whole check sees it
        track._mean_speed = lambda: np.nanmean(track.speed)
    assert Track.RULES[rule](track, index) == reject


def test_taking_out_equals_a_new_track():
    """Speeds, angles and choices after each removal are those of a track made of what is left."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(3, 20))
        s, lat, lon = np.sort(rng.integers(0, 40, n)) * 3600.0, np.cumsum(rng.normal(0, 0.6, n)), np.cumsum(rng.normal(0, 0.6, n))
        track, left = Track(s, lat, lon, 15.0), list(range(n))
        while len(left) > 2:
            k = left[int(rng.integers(len(left)))]
            track.drop(k)
            left.remove(k)
            new = Track(s[left], lat[left], lon[left], 15.0)
            assert np.allclose([track.speed[i] for i in left], new.speed, equal_nan=True) and np.allclose([track.angle[i] for i in left], new.angle, equal_nan=True)
            assert left[new.fastest()] == track.fastest()
            for at in range(1, len(left)):
                pick, rule = new.choice(at)
                assert (None if pick is None else left[pick], rule) == track.choice(left[at])
                assert new.excessive(at) == track.excessive(left[at])


def test_turns_only_where_asked_for(monkeypatch):
    """A segment beyond the limit is excessive whatever the turns at its ends."""
    n = 50
    monkeypatch.setattr(Track, "_turn", lambda *_: pytest.fail("a turn that decides nothing"))
    track = Track(3600.0 * np.arange(n), np.arange(n) % 2 * 5.0, np.full(n, 90.0), 15.0)
    assert all(track.excessive(i) for i in range(1, n)) and not track.excessive(0)


def test_track_table(spark):
    """Aircraft, unnamed cruises and incomplete headers take no part; of the others the jump is flagged."""
    import datetime as dt

    start = dt.datetime(1999, 12, 31)
    rows = [(u, "C", 7, "x", start + dt.timedelta(hours=u), 30.0 if u == 4 else 0.0, 0.0, 1, None) for u in range(8)]
    rows += [(100 + u, "C", 8, "x", start + dt.timedelta(hours=u), 30.0 if u == 4 else 0.0, 0.0, 1, 1053) for u in range(8)]
    rows += [(200, "C", 0, "x", start, 80.0, 0.0, 1, None), (201, "99", 7, "x", start, 80.0, 0.0, 1, None), (202, "C", 7, "x", None, 80.0, 0.0, 1, None), (203, "C", 7, None, start, 80.0, 0.0, 1, None)]
    df = spark.createDataFrame(rows, "uid long, country string, cruise long, ocruise string, ts timestamp, lat double, lon double, probe int, platform int").repartition(3)
    got = {r.uid: r.flag for r in track_check(df).collect()}
    assert len(got) == len(rows) and [u for u, f in got.items() if f] == [4]
    assert track_check(df.drop("platform").where("uid >= 100 AND uid < 200")).where("flag").count() == 1
    assert track_check(df.limit(0)).count() == 0


def test_whole_tracks():
    hours = 3600.0 * np.arange(8)
    still = np.zeros(8)
    assert not bad_positions(hours, still, still, 15.0).any()
    lat = still.copy()
    lat[4] = 30.0
    assert bad_positions(hours, lat, still, 15.0).tolist() == [False] * 4 + [True] + [False] * 3
    wild = np.array([0, 40, -40, 60, -60, 80, -80, 10.0])
    assert bad_positions(hours, wild, still, 15.0).all()


def _random_tracks(rng, many):
    """Ship-like walks with clusters of bad positions, near-limit speeds, turns and repeated times."""
    rows, uid = [], 0
    for cruise in range(1, many + 1):
        n = int(rng.integers(2, 160))
        gaps = np.where(rng.random(n) < (0.05 if cruise % 4 == 0 else 0.0), 0, rng.integers(1, 4, n)) * 3600
        scale = rng.choice([0.2, 0.45, 0.5])
        lat, lon = np.cumsum(rng.choice([-1, 1, 1, 1], n) * scale * (gaps / 3600)), np.cumsum(rng.normal(0, 0.05, n))
        for _ in range(int(rng.integers(0, 6))):
            at, wide = int(rng.integers(n)), int(rng.integers(1, 4))
            lat[at : at + wide] += rng.normal(0, 3)
        probe = int(rng.choice([1, 1, 1, 4]))
        for s, a, o in zip(np.cumsum(gaps), lat, lon, strict=True):
            rows.append((uid, "C", cruise, "x", int(s), float(a), float(o), probe))
            uid += 1
    return rows


@pytest.mark.parametrize("margins,small", [((2, 6, None), 0), ((5, None), 0), (None, None)])
def test_cells_equal_whole_tracks(spark, monkeypatch, margins, small):
    from pyspark.sql import functions as F

    from soundings.operators import track as T

    if small is not None:
        monkeypatch.setattr(T, "SMALL", small)
    rows = _random_tracks(np.random.default_rng(11), 150)
    want = {}
    for cruise in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == cruise), key=lambda r: (r[4], r[0]))
        bad = bad_positions(*(np.array([r[k] for r in own], float) for k in (4, 5, 6)), T.BUOY_SPEED if own[0][7] in T.BUOYS else T.SHIP_SPEED)
        want |= {r[0]: bool(b) for r, b in zip(own, bad, strict=True)}
    df = spark.createDataFrame(rows, "uid long, country string, cruise long, ocruise string, s long, lat double, lon double, probe int").repartition(4)
    dated = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.uid: r.flag for r in (track_check(dated) if margins is None else track_check(dated, margins)).collect()}
    assert 0 < sum(want.values()) < len(want)
    assert got == want
