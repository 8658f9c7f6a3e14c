"""Ship-track check: positions of one cruise that imply impossible speeds.

The rule takes the fastest segment of a track again and again; if it is excessive, one or both of its ends go, else all is done.
What goes depends on a few positions around the segment, so a track falls into cells: positions around its excessive segments, found
by windows, with a margin on both sides. Cells are solved apart by different tasks. A cell whose removals come near its edge
is not trusted; its track is solved again with a wider margin.

Only two things bind the cells of a track. The first is the order: the whole ends with the fastest segment that is not excessive. A cell
goes through its own fastest segments, and a removal happens in the whole track if the slowest of these up to it is faster
than where the whole ends. That is the largest, over cells, of the slowest segment on the way to the cell's own end, or the fastest segment
outside the cells: one aggregate. The second is the share of positions that survive: another aggregate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Platforms that are aircraft, probes that drift or are moored.
AIRCRAFT = (2635, 1053, 5178, 6876, 305, 879, 7841, 6743, 2911, 183)
BUOYS = (4, 7, 9, 10, 11, 12, 13, 15)
SHIP_SPEED, BUOY_SPEED = 15.0, 2.0
SLACK_M, SLACK_S = 20_000.0, 600.0
TURN = math.radians(45)
#: Positions on each side of an excessive segment that its cell takes in, at first, then for tracks whose removals came near an edge;
#: None takes in the whole track.
MARGINS: tuple[int | None, ...] = (16, 128, 1024, None)
#: A track of so many positions is one cell.
SMALL = 64


def usable() -> Column:
    """Whether a header row can take part in a track: it names a cruise, is complete and not an aircraft's."""
    known = F.col("cruise").isNotNull() & (F.col("cruise") != 0) & F.col("ocruise").isNotNull() & (F.col("ocruise") != "0")
    full = F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("probe").isNotNull()
    return F.coalesce(known & full & (F.col("country") != "99") & ~is_aircraft(F.col("platform")), F.lit(False))


def is_aircraft(platform: Column) -> Column:
    return F.coalesce(platform.isin(*AIRCRAFT), F.lit(False))


class Angles(Sequence):
    """The turn at each position of a track, found when first asked for: most segments that go are too fast whatever the turn."""

    def __init__(self, track: Track, n: int):
        self.track, self.known = track, [None] * n

    def __len__(self) -> int:
        return len(self.known)

    def __getitem__(self, i: int) -> float:
        found = self.known[i]
        if found is None:
            found = self.known[i] = self.track._turn(self.track.prev[i], i, self.track.next[i])
        return found

    def forget(self, i: int) -> None:
        self.known[i] = None


class Track:
    """Times (s) and positions (degrees) of one cruise in order; the rules that pick a position to reject.

    Positions are numbered for good and linked to their neighbours. Taking one out renews the speed and the angles of these
    only, and the fastest segment comes from a heap, so the work is in proportion to the positions and those taken out.
    """

    def __init__(self, seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray, limit: float, others: int = 0):
        """``others`` is the number of positions of the track that are not in this cell."""
        self.others, self.asked = others, False
        self.s, self.lat, self.lon, self.limit = seconds.tolist(), np.radians(lat).tolist(), np.radians(lon).tolist(), limit
        n = self.size = len(self.s)
        self.prev, self.next = list(range(-1, n - 1)), [*range(1, n), -1]
        self.speed, self.heap = [math.nan] * n, []
        self.angle = Angles(self, n)
        self.gone = [False] * n
        for i in range(1, n):
            self.speed[i] = self.pace(i - 1, i)
        self.heap = [(-v, i) for i, v in enumerate(self.speed) if v == v]
        heapq.heapify(self.heap)

    def metres(self, i: int, j: int) -> float:
        h = math.sin((self.lat[j] - self.lat[i]) / 2) ** 2 + math.cos(self.lat[i]) * math.cos(self.lat[j]) * math.sin((self.lon[j] - self.lon[i]) / 2) ** 2
        return geo.RADIUS * 2 * math.asin(min(1.0, math.sqrt(h)))

    def pace(self, i: int, j: int) -> float:
        return (self.metres(i, j) - SLACK_M) / max(self.s[j] - self.s[i], SLACK_S)

    def corner(self, i: int, j: int, k: int) -> float:
        a, b, c = (self.metres(*x) / geo.RADIUS for x in ((i, j), (j, k), (i, k)))
        if a == 0 or b == 0:
            return 0.0
        return math.acos(max(-1.0, min(1.0, (math.cos(c) - math.cos(a) * math.cos(b)) / (math.sin(a) * math.sin(b)))))

    def _turn(self, i: int, j: int, k: int) -> float:
        return abs(math.pi - self.corner(i, j, k)) if min(i, j, k) >= 0 else math.nan

    def drop(self, k: int) -> None:
        """Take a position out."""
        p, q = self.prev[k], self.next[k]
        self.gone[k] = True
        self.size -= 1
        if p >= 0:
            self.next[p] = q
            self.angle.forget(p)
        if q >= 0:
            self.prev[q] = p
            self.angle.forget(q)
            self.speed[q] = self.pace(p, q) if p >= 0 else math.nan
            if p >= 0:
                heapq.heappush(self.heap, (-self.speed[q], q))

    def fastest(self) -> int:
        """The position at the end of the fastest segment, the first of equals; -1 if there is none."""
        while self.heap:
            v, i = self.heap[0]
            if not self.gone[i] and self.speed[i] == -v:
                return i
            heapq.heappop(self.heap)
        return -1

    def _too_fast(self, v: float, here: Callable[[], float], before: Callable[[], float]) -> bool:
        return v > self.limit or (v > 0.8 * self.limit and (here() > math.pi / 2 or before() > math.pi / 2))

    def excessive(self, i: int) -> bool:
        return self.prev[i] >= 0 and self._too_fast(self.speed[i], lambda: self.angle[i], lambda: self.angle[self.prev[i]])

    def excessive_without(self, k: int) -> bool:
        """Whether the segment that takes the place of those at a position would be excessive."""
        p, q = self.prev[k], self.next[k]
        return p >= 0 and q >= 0 and self._too_fast(self.pace(p, q), lambda: self._turn(p, q, self.next[q]), lambda: self._turn(self.prev[p], p, q))

    def _mean_speed(self) -> float:
        """Of segments without a time gap (as specified), so it is nearly always 0."""
        fit = [v for i, v in enumerate(self.speed) if not self.gone[i] and self.prev[i] >= 0 and self.s[i] == self.s[self.prev[i]] and v <= self.limit]
        return sum(fit) / len(fit) if fit else 0.0

    def _around(self, i: int) -> tuple[int, int, int]:
        """The positions two before, one before and one after; -1 where there is none."""
        q = self.prev[i]
        return self.prev[q] if q >= 0 else -1, q, self.next[i]

    def at_an_end(self, i: int) -> int | None:
        p, q, s = self._around(i)
        v, a, most = self.speed, self.angle, self.limit
        if p < 0:
            skip = s >= 0 and self.pace(q, s) < most and (v[s] > most or a[s] > TURN)
            return i if skip else q
        if s < 0 and self.size + self.others > 3:
            skip = self.pace(p, i) < most and (v[q] > most or a[p] > TURN)
            return q if skip else i
        return None

    def next_segment(self, i: int) -> int | None:
        _, q, s = self._around(i)
        if self.speed[q] > self.limit:
            return q
        return i if s >= 0 and self.speed[s] > self.limit else None

    def left_out(self, i: int) -> int | None:
        p, q, s = self._around(i)
        if s >= 0 and self.pace(q, s) > self.limit:
            return q
        return i if p >= 0 and self.pace(p, i) > self.limit else None

    def sharper_turn(self, i: int) -> int | None:
        q, a = self.prev[i], self.angle
        return q if a[q] > TURN + a[i] else i if a[i] > TURN + a[q] else None

    def turns_beyond(self, i: int) -> int | None:
        p, q, s = self._around(i)
        if min(p, s) < 0:
            return None
        a = self.angle
        return q if a[p] > TURN and a[p] > a[s] else i if a[s] > TURN else None

    def slow_neighbour(self, i: int) -> int | None:
        p, q, s = self._around(i)
        v = self.speed
        if s < 0 or p < 0:
            return None
        self.asked = True  # the mean is that of the whole track
        half = 0.5 * self._mean_speed()
        return q if v[q] < min(v[s], half) else i if not math.isnan(v[q]) and v[s] < min(v[q], half) else None

    def shorter_way(self, i: int) -> int | None:
        p, q, s = self._around(i)
        if min(p, s) < 0:
            return None
        without_q, without_i = self.metres(p, i) + self.metres(i, s), self.metres(p, q) + self.metres(q, s)
        slack = max(SLACK_M, 0.1 * (self.metres(p, q) + self.metres(q, i) + self.metres(i, s)))
        return q if without_q < without_i - slack else i if without_i < without_q - slack else None

    def steadier_way(self, i: int) -> int | None:
        p, q, s = self._around(i)
        if min(p, s) < 0:
            return None
        without_q, without_i, whole = self.metres(p, i) + self.metres(i, s), self.metres(p, q) + self.metres(q, s), self.s[s] - self.s[p]
        if not (without_q and without_i and whole):
            return None
        off_q = abs(self.metres(p, q) / without_i - (self.s[q] - self.s[p]) / whole)
        off_i = abs(self.metres(p, i) / without_q - (self.s[i] - self.s[p]) / whole)
        return q if off_q > 0.1 + off_i else i if off_i > 0.1 + off_q else None

    #: The rules in turn, by letter; each gives the end of the segment before a position to reject, or None. NaN compares false.
    RULES = {
        "a": at_an_end, "b": next_segment, "c": left_out, "d": sharper_turn, "e": turns_beyond, "f": slow_neighbour, "g": shorter_way, "h": steadier_way,
    }

    def choice(self, i: int) -> tuple[int | None, str]:
        """The end of the segment before ``i`` to reject, with the rule that decides; None if no rule does."""
        for letter, rule in self.RULES.items():
            if (pick := rule(self, i)) is not None:
                return pick, letter
        return None, "i"

    def rejected(self, i: int) -> list[int]:
        """Positions to reject for an excessive segment: one end, or both if undecided or still excessive without it."""
        pick, _ = self.choice(i)
        if pick is None or (self.next[pick] >= 0 and self.excessive_without(pick)):
            return [self.prev[i], i]
        return [pick]


def bad_positions(seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray, limit: float) -> np.ndarray:
    """Which positions of a track are rejected; all, if fewer than half survive."""
    track = Track(seconds, lat, lon, limit)
    while track.size > 1 and (i := track.fastest()) >= 0 and track.excessive(i):
        for k in track.rejected(i):
            track.drop(k)
    return np.array(track.gone) if 2 * track.size >= len(seconds) else np.ones(len(seconds), bool)


class Cell(NamedTuple):
    """What a run over a cell has found."""

    removed: list[int]
    #: For each of them the slowest of the fastest segments up to its removal: speed and place of its end.
    slowest: list[tuple[float, int]]
    #: The same up to the first fastest segment that is not excessive; None if none is left.
    end: tuple[float, int] | None
    #: Whether nothing outside the cell can have mattered.
    trusted: bool


def solve_cell(seconds: np.ndarray, lat: np.ndarray, lon: np.ndarray, limit: float, place: int, count: int, tied: bool) -> Cell:
    """Run over a cell that begins at ``place`` (from 0) of a track of ``count`` positions.

    ``tied`` tells whether the track has positions of one time: only then is its mean speed, which one of the rules asks for, not 0.
    """
    n = len(seconds)
    track = Track(seconds, lat, lon, limit, count - n)
    removed, slowest, low = [], [], (math.inf, 0)
    open_start, open_end = place > 0, place + n < count
    trusted = True

    def inside(k: int, links: list[int], is_open: bool) -> bool:
        for _ in range(5 if is_open else 0):
            k = links[k]
            if k < 0:
                return False
        return True

    while track.size > 1 and (i := track.fastest()) >= 0:
        low = min(low, (track.speed[i], -(place + i)))
        if not track.excessive(i):
            return Cell(removed, slowest, (low[0], -low[1]), trusted)
        trusted &= inside(i, track.prev, open_start) and inside(i, track.next, open_end)
        for k in track.rejected(i):
            removed.append(k)
            slowest.append((low[0], -low[1]))
            track.drop(k)
        trusted &= not (track.asked and tied and count > n)
        if not trusted:
            break
    return Cell(removed, slowest, None, trusted)


KEY = ("country", "cruise", "ocruise")


def segments(rows: DataFrame) -> DataFrame:
    """The rows with ``speed`` and ``angle`` of each position of its track, from one window pass."""
    w = Window.partitionBy(*KEY).orderBy("ts", "uid")
    at = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    gap = geo.seconds_between(at("ts", 1), F.col("ts"))
    speed = (geo.distance(at("lat", 1), at("lon", 1), F.col("lat"), F.col("lon")) - SLACK_M) / F.greatest(gap, F.lit(SLACK_S))
    angle = F.abs(math.pi - geo.corner(at("lat", 1), at("lon", 1), F.col("lat"), F.col("lon"), at("lat", -1), at("lon", -1)))
    return rows.withColumn("speed", speed).withColumn("angle", angle)


def dated(profiles: DataFrame) -> DataFrame:
    """Header rows with ``ts`` from their date and time."""
    return profiles.withColumn("ts", geo.moment(F.col("year"), F.col("month"), F.col("day"), F.col("time")))


_EVENT = "array<struct<uid:long,v:double,i:long>>"
_CELL = f"country string, cruise long, ocruise string, cell long, events {_EVENT}, end struct<v:double,i:long>, trusted boolean"


def _cells(marked: DataFrame, margin: int | None) -> DataFrame:
    """Positions of tracks with ``cell``: NULL for those that are not near an excessive segment."""
    w = Window.partitionBy(*KEY).orderBy("i")
    if margin is None:
        return marked.withColumn("cell", F.lit(0).cast("long"))
    near = F.max(F.col("odd").cast("int")).over(w.rowsBetween(-margin, margin + 1)) == 1
    inside = marked.withColumn("_in", near | (F.col("n") <= SMALL))
    fresh = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return inside.withColumn("cell", F.when(F.col("_in"), F.sum(fresh.cast("long")).over(w) - 1)).drop("_in")


def _solved(cells: DataFrame) -> DataFrame:
    """A row per cell: its removals in order, where it ends, and whether it is trusted."""
    position = F.struct("i", "uid", "s", "lat", "lon")
    packed = cells.where("cell IS NOT NULL").groupBy(*KEY, "cell").agg(F.sort_array(F.collect_list(position)).alias("at"), F.first("limit").alias("limit"), F.first("n").alias("n"), F.first("tied").alias("tied"))
    rows = packed.select(*KEY, "cell", "limit", "n", "tied", *(F.col(f"at.{c}").alias(c) for c in ("i", "uid", "s", "lat", "lon")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("uid", pa.int64()), ("v", pa.float64()), ("i", pa.int64())]))
        for b in batches:
            events, ends, trusted = [], [], []
            for limit, n, tied, i, uid, s, lat, lon in zip(*(b[c].to_pylist() for c in ("limit", "n", "tied", "i", "uid", "s", "lat", "lon")), strict=True):
                found = solve_cell(np.array(s, float), np.array(lat, float), np.array(lon, float), limit, i[0], n, tied)
                events.append([{"uid": uid[k], "v": v, "i": at} for k, (v, at) in zip(found.removed, found.slowest, strict=True)])
                ends.append(None if found.end is None else {"v": found.end[0], "i": found.end[1]})
                trusted.append(found.trusted)
            yield pa.record_batch([*(b[c] for c in (*KEY, "cell")), pa.array(events, kind), pa.array(ends, pa.struct([("v", pa.float64()), ("i", pa.int64())])), pa.array(trusted, pa.bool_())], names=[*KEY, "cell", "events", "end", "trusted"])

    return rows.mapInArrow(run, _CELL)


def removals(marked: DataFrame, margins: Sequence[int | None] = MARGINS) -> DataFrame:
    """``uid`` of the positions that go, without the rule of the surviving share, from ``marked`` positions of tracks with some excessive segment:
    ``uid``, the key, ``i, n`` (place and number of positions), ``s, lat, lon, speed, odd, limit, tied``."""
    out: DataFrame | None = None
    left = marked
    for margin in margins:
        cells = _cells(left, margin)
        solved = _solved(cells).cache()
        bad = solved.where("NOT trusted").select(*KEY).distinct()
        w = Window.partitionBy(*KEY).orderBy("i")
        outside = cells.withColumn("_of", F.lag("cell").over(w)).where(F.col("speed").isNotNull() & ~F.coalesce(F.col("cell") == F.col("_of"), F.lit(False)))
        # Where the whole ends: speed, then the first place; the cell it belongs to goes all its way.
        key = lambda v, i, cell: F.struct(v.alias("v"), (-i).alias("i"), cell.alias("cell"))
        ends = solved.where("end IS NOT NULL").select(*KEY, key(F.col("end.v"), F.col("end.i"), F.col("cell")).alias("k"))
        calm = outside.select(*KEY, key(F.col("speed"), F.col("i"), F.lit(-1).cast("long")).alias("k"))
        whole = ends.unionByName(calm).groupBy(*KEY).agg(F.max("k").alias("stop"))
        events = solved.select(*KEY, "cell", F.explode("events").alias("e"))
        met = events.join(bad, [*KEY], "left_anti").join(whole, [*KEY], "left")
        before = F.struct(F.col("e.v").alias("v"), (-F.col("e.i")).alias("i")) > F.struct(F.col("stop.v").alias("v"), F.col("stop.i").alias("i"))
        found = met.where(F.col("stop").isNull() | before | (F.col("cell") == F.col("stop.cell"))).select(F.col("e.uid").alias("uid"), *KEY)
        out = found if out is None else out.unionByName(found)
        if margin is None or bad.isEmpty():
            return out
        left = left.join(bad, [*KEY], "left_semi")
    raise ValueError("the last margin must be None")


def track_check(rows: DataFrame, margins: Sequence[int | None] = MARGINS) -> DataFrame:
    """``uid, flag`` of header rows (``uid, country, cruise, ocruise, ts, lat, lon, probe`` and, if there, ``platform``);
    unusable rows pass. Only tracks with some excessive segment are solved, a cell of positions a row; if fewer than half of a track's
    positions survive, all are flagged."""
    platform = F.col("platform") if "platform" in rows.columns else F.lit(None).cast("int")
    rows = rows.select("uid", *(F.col(c).cast(t).alias(c) for c, t in zip(KEY, ("string", "long", "string"), strict=True)), F.col("ts").cast("timestamp_ntz").alias("ts"), "lat", "lon", "probe", platform.alias("platform"))
    fit = rows.where(usable())
    marked = segments(fit)
    w = Window.partitionBy(*KEY).orderBy("ts", "uid")
    track = Window.partitionBy(*KEY)
    limit = F.when(F.first("probe").over(w).isin(*BUOYS), BUOY_SPEED).otherwise(SHIP_SPEED)
    turn = (F.col("angle") > math.pi / 2) | (F.lag("angle").over(w) > math.pi / 2)
    odd = F.coalesce((F.col("speed") > limit) | ((F.col("speed") > 0.8 * limit) & turn), F.lit(False))
    second = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    placed = marked.select("uid", *KEY, second.alias("s"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "speed", odd.alias("odd"), limit.alias("limit"), (F.row_number().over(w) - 1).cast("long").alias("i"), (second == F.lag(second).over(w)).alias("_tie"))
    open_rows = placed.select("*", F.max("odd").over(track).alias("_open"), F.count("*").over(track).alias("n"), F.coalesce(F.max("_tie").over(track), F.lit(False)).alias("tied")).where("_open").drop("_open", "_tie").cache()
    gone = removals(open_rows, margins)
    lost = gone.groupBy(*KEY).agg(F.count("*").alias("lost")).join(open_rows.groupBy(*KEY).agg(F.count("*").alias("n")), [*KEY]).where(2 * (F.col("n") - F.col("lost")) < F.col("n"))
    every = open_rows.join(lost.select(*KEY), [*KEY], "left_semi").select("uid")
    hit = gone.select("uid").unionByName(every).distinct().withColumn("hit", F.lit(True))
    return rows.select("uid").join(hit, "uid", "left").select("uid", F.coalesce("hit", F.lit(False)).alias("flag"))
