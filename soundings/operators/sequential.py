"""Checks whose steps depend on earlier ones: spikes and steps, increasing depth, stuck values.

Each works on whole profiles. Spikes, steps and depths of many profiles are judged at once, level by level; the runs of a stuck value
one profile after the other, of those that a window test does not clear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import merged_headers, one_header

_NAN = float("nan")


def depth_tolerance(z: float, lat: float) -> float:
    """Largest temperature step at a depth; ``lat`` is absolute."""
    base = 300.0 if lat < 20.0 else 200.0
    factor = 0.3 if z > 600 else 0.4 if z > 500 else 0.5 if z > base + 100 else 1.0 - 0.005 * (z - base) if z > base else 1.0
    return 5.0 * factor


def spikes_and_steps(z: np.ndarray, t: np.ndarray, lat: float) -> tuple[np.ndarray, np.ndarray]:
    """(rejected, suspect) levels of one profile; missing values are NaN. One pass serves both outputs."""
    n = len(z)
    reject, suspect = np.zeros(n, bool), np.zeros(n, bool)
    step, slope = np.full(n, _NAN), np.full(n, _NAN)
    dz, diff = np.diff(z), np.diff(t)
    near = (dz <= 50) | ((z[1:] >= 350) & (dz <= 100))
    step[1:] = np.where(near, diff, _NAN)
    slope[1:] = np.where(near, diff / np.maximum(10.0, dz), _NAN)
    held = np.isfinite(z) & np.isfinite(t)
    away = abs(lat)
    for i in range(1, n):
        if not held[max(0, i - 2) : i + 1].all():
            continue
        weight = (z[i - 1] - z[i - 2]) / (z[i] - z[i - 2]) if i >= 2 and z[i] - z[i - 2] >= 5.0 else 0.5
        most = depth_tolerance(z[i - 1], away)
        if away < 20.0 and z[i - 1] < 1000.0 and t[i - 1] < 1.0:  # too cold for the tropics
            step[i] = _NAN
            suspect[i - 1] = True
            continue
        a, b = step[i - 1], step[i]
        if max(abs(a), abs(b)) > most:  # large spike, or a steep but steady gradient that is not looked at again
            spike = abs(a + b) < 0.5 * most
            if spike or abs((1.0 - weight) * a - weight * b) < 0.5 * most:
                reject[i - 1] |= spike
                step[i - 1 : i + 1] = _NAN
        a, b = step[i - 1], step[i]
        if max(abs(a), abs(b)) > 0.5 * most and np.max(np.abs(slope[i - 1 : i + 1])) > 0.05 and abs(a + b) < 0.25 * abs(b - a):  # small spike
            reject[i - 1] = True
            step[i - 1 : i + 1] = _NAN
        a = step[i - 1]
        if abs(a) > most:  # step
            thermocline = z[i - 1] <= 250.0 and -3.0 * most < a < -most
            steady = i > 1 and z[i] - z[i - 2] > 0 and abs(t[i - 1] - ((z[i - 1] - z[i - 2]) / (z[i] - z[i - 2]) * (t[i] - t[i - 2]) + t[i - 2])) < 0.5 * most
            if not thermocline and not steady:
                suspect[max(0, i - 2) : i] |= i > 1
    if n:
        if held[-1] and abs(step[-1]) > depth_tolerance(z[-1], away):
            suspect[-1] = True
        if t[-1] == 0.0:
            suspect[-1] = True
    if reject.sum() >= 4 or reject.sum() > n / 2:
        reject[:] = True
    return reject, suspect


def _inversions(d: np.ndarray) -> np.ndarray:
    """For each level how many others are out of order with it: later ones that are not deeper, earlier ones that are not shallower.

    Counted as a merge sort merges: of two neighbouring blocks, each sorted, every level of one finds its place in the other.
    """
    n = len(d)
    count = np.zeros(n, np.int64)
    rank = np.unique(d, return_inverse=True)[1].astype(np.int64)
    place, width = np.arange(n), 1
    while width < n:
        block, right = place // (2 * width), place // width % 2 == 1
        # Ranks that grow from pair of blocks to pair, so that one search serves all pairs.
        key = block * n + rank
        early, late = np.sort(key[~right]), np.sort(key[right])
        upto = np.searchsorted(late, key[~right], "right") - np.searchsorted(late, block[~right] * n)
        count[~right] += upto
        count[right] += np.searchsorted(early, (block[right] + 1) * n) - np.searchsorted(early, key[right], "left")
        width *= 2
    return count


def depths_out_of_order(z: np.ndarray, spikes: np.ndarray) -> np.ndarray:
    """Levels that break the increase of depth: the level of most inversions goes first, the deepest of equals.

    Inversions are counted once, in n log n; each level that goes takes its own off the others' counts, by one comparison with
    the levels that are left, which are moved together as they become fewer.
    """
    n = len(z)
    qc = (z < 0) | (z > 11000)
    if n <= 1:
        return qc
    whole = np.where(np.isfinite(z), z, 0.0)
    if (whole == whole[0]).all():
        return np.ones(n, bool)
    index = np.flatnonzero(np.isfinite(z) & ~qc)
    d = z[index]
    count, gone = _inversions(d), 0
    while len(count) and (most := count.max()) > 0:
        level = len(count) - 1 - int(count[::-1].argmax())
        taken = [level]
        if most == 1:
            other = int(np.flatnonzero(_inverted(d, level) & (count > 0))[-1])
            taken = [k for k in (level, other) if spikes[index[k]]] or [level, other]
        for k in taken:
            count[:k] -= d[:k] >= d[k]
            count[k + 1 :] -= d[k + 1 :] <= d[k]
            count[k] = -n - 1  # never counts again
        qc[index[taken]] = True
        gone += len(taken)
        if 4 * gone > len(count):
            left = count >= 0
            index, d, count, gone = index[left], d[left], count[left], 0
    return qc


def _inverted(d: np.ndarray, k: int) -> np.ndarray:
    """Which levels are out of order with level ``k``."""
    return np.concatenate([d[:k] >= d[k], [False], d[k + 1 :] <= d[k]])


#: Values that differ by more than this are not the same.
STUCK, THICK = 1e-4, 200.0


def _first_beyond(t: list[float], sign: float) -> list[int]:
    """For each place the first later one whose value is higher (``sign`` 1) or lower (-1) by more than ``STUCK``; the length if none.

    From the end on, a stack keeps the places that nothing before them surpasses; their values rise towards its bottom, so the
    first that is far enough is found by halving.
    """
    n = len(t)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        low, high = -1, len(stack) - 1  # the topmost place of the stack that is far enough
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sign * (t[stack[middle]] - t[i]) > STUCK else (low, middle - 1)
        if low >= 0:
            out[i] = stack[low]
        while stack and sign * t[stack[-1]] <= sign * t[i]:
            stack.pop()
        stack.append(i)
    return out


def stuck_run(z: np.ndarray, t: np.ndarray, least: int) -> tuple[int, int] | None:
    """First and last place of the longest run of one value in depth-ordered levels, if long and thick enough."""
    n = len(t)
    if n <= least:
        return None
    values = t.tolist()
    ends = np.minimum(_first_beyond(values, 1.0), _first_beyond(values, -1.0))
    runs = np.where(np.arange(n) < n - least, ends - np.arange(n), 1)
    i = int(runs.argmax())
    if runs[i] < least or z[i + runs[i] - 1] - z[i] < THICK:
        return None
    return i, i + int(runs[i]) - 1


#: Profiles of up to ``SHORT`` levels have their inversions counted pair by pair; fewer than ``FEW`` of a length are judged one by one.
SHORT, FEW = 128, 8


def _tolerances(z: np.ndarray, away: np.ndarray) -> np.ndarray:
    """``depth_tolerance`` of many levels."""
    base = np.where(away < 20.0, 300.0, 200.0)
    upper = np.where(z > base, 1.0 - 0.005 * (z - base), 1.0)
    return 5.0 * np.where(z > 600, 0.3, np.where(z > 500, 0.4, np.where(z > base + 100, 0.5, upper)))


def _spikes_side_by_side(z: np.ndarray, t: np.ndarray, lat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``spikes_and_steps`` of many profiles, a column each, level by level; longest first, NaN below a profile's last level."""
    reject, suspect = np.zeros(z.shape, bool), np.zeros(z.shape, bool)
    step, slope = np.full(z.shape, _NAN), np.full(z.shape, _NAN)
    dz, diff = np.diff(z, axis=0), np.diff(t, axis=0)
    near = (dz <= 50) | ((z[1:] >= 350) & (dz <= 100))
    step[1:] = np.where(near, diff, _NAN)
    slope[1:] = np.where(near, diff / np.maximum(10.0, dz), _NAN)
    held, away = np.isfinite(z) & np.isfinite(t), np.abs(lat)
    tropic, longer = away < 20.0, len(n) - np.searchsorted(n[::-1], np.arange(len(z)), "right")
    for i in range(1, len(z)):
        m = longer[i]  # profiles with a level ``i``
        z0, z1, t0, t1 = z[i - 1, :m], z[i, :m], t[i - 1, :m], t[i, :m]
        ok = held[i, :m] & held[i - 1, :m]
        weight, steady = 0.5, np.zeros(m, bool)
        most = _tolerances(z0, away[:m])
        if i >= 2:
            ok &= held[i - 2, :m]
            two = z1 - z[i - 2, :m]
            part = (z0 - z[i - 2, :m]) / two
            weight = np.where(two >= 5.0, part, 0.5)
            steady = (two > 0) & (np.abs(t0 - (part * (t1 - t[i - 2, :m]) + t[i - 2, :m])) < 0.5 * most)
        cold = ok & tropic[:m] & (z0 < 1000.0) & (t0 < 1.0)
        suspect[i - 1, :m] |= cold
        step[i, :m][cold] = _NAN
        ok &= ~cold
        a, b = step[i - 1, :m], step[i, :m]  # views: what is set to NaN is NaN from then on
        spike = np.abs(a + b) < 0.5 * most
        hit = ok & (np.maximum(np.abs(a), np.abs(b)) > most) & (spike | (np.abs((1.0 - weight) * a - weight * b) < 0.5 * most))
        reject[i - 1, :m] |= hit & spike
        a[hit] = b[hit] = _NAN
        steep = np.maximum(np.abs(slope[i - 1, :m]), np.abs(slope[i, :m])) > 0.05
        small = ok & steep & (np.maximum(np.abs(a), np.abs(b)) > 0.5 * most) & (np.abs(a + b) < 0.25 * np.abs(b - a))
        reject[i - 1, :m] |= small
        a[small] = b[small] = _NAN
        if i >= 2:
            thermocline = (z0 <= 250.0) & (-3.0 * most < a) & (a < -most)
            suspect[i - 2 : i, :m] |= ok & (np.abs(a) > most) & ~thermocline & ~steady
    last, own = n - 1, np.arange(len(n))
    suspect[last, own] |= held[last, own] & (np.abs(step[last, own]) > _tolerances(z[last, own], away))
    suspect[last, own] |= t[last, own] == 0.0
    found = reject.sum(axis=0)
    reject |= ((found >= 4) | (found > n / 2)) & (np.arange(len(z))[:, None] < n)
    return reject, suspect


def _disorder_side_by_side(z: np.ndarray, spikes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``depths_out_of_order`` of many short profiles, a column each, NaN below a profile's last level; a round takes a level, or a
    lone pair, of each that still has inversions."""
    rows = np.arange(len(z))[:, None]
    inside = rows < n
    qc = (z < 0) | (z > 11000)
    whole = np.where(np.isfinite(z), z, 0.0)
    flat = (n > 1) & ((whole == whole[0]) | ~inside).all(axis=0)
    cols = np.flatnonzero((n > 1) & ~flat)
    d = np.where(qc | ~np.isfinite(z), _NAN, z)[:, cols]
    count = np.zeros(d.shape, np.int32)
    for k in range(1, len(d)):
        pair = d[k:] <= d[:-k]
        count[:-k] += pair
        count[k:] += pair

    def inverted(k: np.ndarray) -> np.ndarray:
        at = d[k, np.arange(len(k))]
        return np.where(rows < k, d >= at, d <= at) & (rows != k)

    def take(k: np.ndarray, who: np.ndarray) -> None:
        nonlocal count
        count = count - (inverted(k) & who)
        k, own = k[who], np.flatnonzero(who)
        d[k, own], count[k, own] = _NAN, -1
        qc[k, cols[own]] = True

    while True:
        most = count.max(axis=0, initial=0)
        live = most > 0
        if not live.any():
            break
        if not live.all():
            cols, d, count, most = cols[live], d[:, live], count[:, live], most[live]
        level = len(d) - 1 - (count[::-1] == most).argmax(axis=0)
        other = np.where(most == 1, len(d) - 1 - inverted(level)[::-1].argmax(axis=0), level)
        lone, one, two = most == 1, spikes[level, cols], spikes[other, cols]
        take(level, ~lone | one | ~two)
        take(other, lone & (two | ~one))
    return qc | (flat & inside)


def _judged(z: np.ndarray, t: np.ndarray, lat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reject, suspect, disorder) of the levels of many profiles that lie one behind the other, ``size`` levels each.

    Profiles of about the same length are laid side by side, so that the levels of one place are judged at once.
    """
    reject, suspect, disorder = (np.zeros(len(z), bool) for _ in range(3))
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    width = np.ceil(np.log2(np.maximum(size[order], 1))).astype(int)
    with np.errstate(all="ignore"):
        for who in np.split(order, np.flatnonzero(np.diff(width)) + 1):
            n, rows = size[who], np.arange(size[who].max(initial=0))[:, None]
            if not len(rows):
                continue
            if len(who) < FEW:
                for k in who:
                    own = slice(start[k], start[k] + size[k])
                    reject[own], suspect[own] = spikes_and_steps(z[own], t[own], lat[k])
                    disorder[own] = depths_out_of_order(z[own], reject[own])
                continue
            inside = rows < n
            at = start[who] + np.minimum(rows, n - 1)
            deep, warm = np.where(inside, z[at], _NAN), np.where(inside, t[at], _NAN)
            found = _spikes_side_by_side(deep, warm, lat[who], n)
            reject[at[inside]], suspect[at[inside]] = found[0][inside], found[1][inside]
            if len(rows) <= SHORT:
                disorder[at[inside]] = _disorder_side_by_side(deep, found[0], n)[inside]
                continue
            for k in who:
                own = slice(start[k], start[k] + size[k])
                disorder[own] = depths_out_of_order(z[own], reject[own])
    return reject, suspect, disorder


def sequential_flags(levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, reject, suspect, disorder`` of every level (checks e03, e04 and e05), in one pass.

    Profiles are packed, a row of arrays each, and judged many at once. A profile without a header counts as one of unknown latitude.
    """
    own = levels.select("uid", F.struct("lev", F.col("z").cast("double").alias("z"), F.col("t").cast("double").alias("t")).alias("at"))
    packed = own.groupBy("uid").agg(F.sort_array(F.collect_list("at")).alias("at")).join(merged_headers(profiles).select("uid", "lat"), "uid", "left")
    rows = packed.select("uid", F.col("lat").cast("double").alias("lat"), *(F.col(f"at.{c}").alias(c) for c in ("lev", "z", "t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = lambda name: b[name].flatten().to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            size = np.diff(b["lev"].offsets.to_numpy())
            flags = _judged(flat("z"), flat("t"), b["lat"].to_numpy(zero_copy_only=False).astype(float), size)
            uid = b["uid"].take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.record_batch([uid, b["lev"].flatten(), *map(pa.array, flags)], names=["uid", "lev", "reject", "suspect", "disorder"])

    return rows.mapInArrow(run, "uid long, lev int, reject boolean, suspect boolean, disorder boolean")


def spike_and_step(levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, reject, suspect`` of every level (checks e03 and e04)."""
    return sequential_flags(levels, profiles).select("uid", "lev", "reject", "suspect")


def increasing_depth(levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, flag`` (check e05): of two lone inverted levels, rejected spikes go first."""
    return sequential_flags(levels, profiles).select("uid", "lev", F.col("disorder").alias("flag"))


def _least_levels():
    # Probe types and the levels that a run of one value must have.
    return F.create_map(*(F.lit(x) for p, n in ((1, 7), (2, 20), (3, 7), (4, 50), (5, 7), (6, 7), (7, 7), (9, 20), (13, 20), (14, 7), (16, 7)) for x in (p, n)))[F.col("probe")]


def stuck_value(levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, flag`` (check i05), over levels in order of depth; how long a run must be depends on the probe.

    Within a run neighbours differ by twice ``STUCK`` at most, so windows find the stretches that are long and thick enough to hold one;
    only profiles with such a stretch are packed, a row of arrays each, for the exact runs.
    """
    wide = levels.where("z >= 0 AND t IS NOT NULL").select("uid", "lev", F.col("z").cast("double").alias("z"), F.col("t").cast("double").alias("t"))
    wide = wide.join(one_header(profiles).select("uid", _least_levels().alias("least")).where("least IS NOT NULL"), "uid")
    w, whole = Window.partitionBy("uid").orderBy("z", "lev"), Window.partitionBy("uid")
    step = F.coalesce(F.abs(F.col("t") - F.lag("t").over(w)) > 2.01 * STUCK, F.lit(True))
    parts = wide.withColumn("_part", F.sum(step.cast("int")).over(w))
    part = Window.partitionBy("uid", "_part")
    fit = (F.count("*").over(part) >= F.col("least")) & (F.max("z").over(part) - F.min("z").over(part) >= THICK)
    open_rows = parts.withColumn("_fit", fit).withColumn("_open", F.max("_fit").over(whole)).where("_open")
    packed = open_rows.groupBy("uid", "least").agg(F.sort_array(F.collect_list(F.struct("z", "lev", "t"))).alias("at"))
    rows = packed.select("uid", "least", *(F.col(f"at.{c}").alias(c) for c in ("z", "lev", "t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, levs = [], []
            for uid, least, z, lev, t in zip(*(b[c].to_pylist() for c in ("uid", "least", "z", "lev", "t")), strict=True):
                if found := stuck_run(np.array(z, float), np.array(t, float), least):
                    levs += lev[found[0] : found[1] + 1]
                    uids += [uid] * (found[1] + 1 - found[0])
            yield pa.record_batch([pa.array(uids, pa.int64()), pa.array(levs, pa.int32())], names=["uid", "lev"])

    stuck = rows.mapInArrow(run, "uid long, lev int").withColumn("hit", F.lit(True))
    return levels.select("uid", "lev").join(stuck, ["uid", "lev"], "left").select("uid", "lev", F.coalesce("hit", F.lit(False)).alias("flag"))
