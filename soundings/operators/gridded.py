"""Checks against gridded reference data: cell lookups, depth columns, climatologies, relief, regions.

Grids are long tables; their depth columns fold to one array row per cell, so a profile joins one row however many
depths there are. Cells are matched by computed indices: equi joins, which Spark broadcasts when the grid is small and
shuffles by cell when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, seawater
from ..functions.geo import in_region
from ..schema import one_header


def with_profile(levels: DataFrame, of: DataFrame, how: str = "left") -> DataFrame:
    """Levels with what is known of their profile, as many rows as there are profiles: sorted and merged, as both lie by ``uid``.

    Packed depth columns are small only as shuffled bytes; by these Spark would broadcast a table that does not fit the driver.
    """
    return levels.join(of.hint("merge"), "uid", how)


def columns_of(grid: DataFrame, cell: Sequence[str], fields: Sequence[str], depth: str = "depth") -> DataFrame:
    """One row per cell with its depth column as ``col array<struct<depth, fields…>>`` in order of depth."""
    kept = grid.where(" AND ".join(f"{f} IS NOT NULL" for f in (depth, *fields)))
    return kept.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(F.col(depth).cast("double").alias("depth"), *(F.col(f).cast("double").alias(f) for f in fields)))).alias("col"))


def once(column: Column) -> Column:
    """A value computed once per row, however often it is used later: a projection would be copied to each use."""
    return F.explode(F.array(column))


def around_depth(col: Column, z: Column) -> Column:
    """The points of a depth column around ``z``: the last that is not below it (``lo``) and the first that is not above it (``hi``)."""
    above = F.filter(col, lambda x: x["depth"] <= z)
    return F.struct(F.get(above, F.size(above) - 1).alias("lo"), F.get(F.filter(col, lambda x: x["depth"] >= z), F.lit(0)).alias("hi"))


def between(around: Column, z: Column, field: str) -> Column:
    """Linear interpolation between two points of a depth column: the first value above it, NULL below its deepest point."""
    lo, hi = around["lo"], around["hi"]
    inside = geo.linear(z, lo["depth"], F.nullif(hi["depth"], lo["depth"]), lo[field], hi[field])
    return F.when(hi.isNull(), F.lit(None)).when(lo.isNull(), hi[field]).otherwise(F.coalesce(inside, lo[field]))


def at_depth(col: Column, z: Column, field: str) -> Column:
    """The value of a depth column at a depth; for several uses see ``around_depth``."""
    return between(around_depth(col, z), z, field)


def nearest_cells(profiles: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """Profiles with ``ilat, ilon`` of the nearest point of an even grid, each axis given as (first, step, number)."""
    return profiles.withColumn("ilat", geo.grid_index(geo.normal_latitude(F.col("lat")), *lat)).withColumn("ilon", geo.grid_index(F.col("lon"), *lon, cyclic=True))


BACKGROUND_AXES = ((-90.0, 10.0, 19), (0.0, 10.0, 36))


def on_background(levels: DataFrame, profiles: DataFrame, grid: DataFrame, axes=BACKGROUND_AXES) -> DataFrame:
    """Levels with the background column ``col`` of their profile's cell, and the header's latitude and probe."""
    cells = columns_of(grid, ("ilat", "ilon"), ("clim", "bgev", "obev"))
    headers = nearest_cells(one_header(profiles), *axes).join(cells, ["ilat", "ilon"], "left").select("uid", "lat", "probe", "col")
    return with_profile(levels, headers)


def background_available(levels: DataFrame, profiles: DataFrame, grid: DataFrame, axes=BACKGROUND_AXES) -> DataFrame:
    """``uid, lev, flag`` (e08): a level with data where the background column does not reach; all, if there is no column."""
    on = on_background(levels, profiles, grid, axes).select("*", F.element_at("col", -1)["depth"].alias("deepest"))
    deep = F.col("t").isNotNull() & F.col("z").isNotNull() & (F.col("z") > F.col("deepest"))
    return on.select("uid", "lev", F.coalesce(F.col("col").isNull() | deep, F.lit(False)).alias("flag"))


def gross_error(probe: Column, suspect: Column) -> Column:
    """First guess of the probability of a gross error."""
    base = F.when(probe.isin(1, 2, 3, 13, 16), 0.05).otherwise(0.01)
    return F.when(suspect, 0.5 + 0.5 * base).otherwise(base)


def posterior_error(difference: Column, variance: Column, guess: Column) -> Column:
    """Probability of a gross error given a difference from the background and its variance."""
    good = F.exp(-0.5 * F.least(difference * difference / variance, F.lit(160.0))) / F.sqrt(F.lit(6.283185307179586) * variance)
    return F.when(difference.isNotNull() & variance.isNotNull(), 0.1 * guess / (0.1 * guess + good * (1 - guess)))


def background(levels: DataFrame, profiles: DataFrame, grid: DataFrame, suspects: DataFrame, axes=BACKGROUND_AXES) -> DataFrame:
    """``uid, lev, flag, pge, theta, clim`` (e07): Bayesian comparison of potential temperature with the background."""
    heard = suspects.select("uid", "lev", F.struct("suspect").alias("heard"))
    on = on_background(levels, profiles, grid, axes).join(heard.hint("merge"), ["uid", "lev"], "left").withColumn("suspect", F.col("heard.suspect"))
    pressure = seawater.depth_to_pressure(F.col("z"), F.col("lat"))
    at = lambda f: between(F.col("around"), F.col("z"), f)
    usable = F.expr("t IS NOT NULL AND z IS NOT NULL AND col IS NOT NULL AND heard IS NOT NULL")
    met = on.select("*", once(F.when(usable, around_depth(F.col("col"), F.col("z")))).alias("around"))
    seen = met.select("uid", "lev", "lat", "probe", "suspect", "t", F.coalesce("s", F.lit(35.0)).alias("s"), pressure.alias("pr"), at("clim").alias("clim"), at("bgev").alias("bgev"), at("obev").alias("obev"))
    wide = F.col("bgev") * F.when(F.abs("lat") < 10, 2.25).otherwise(1.0) * 4.0 + F.col("obev")
    warm = F.when(F.col("clim").isNotNull(), F.col("t"))
    theta = seen.withColumn("theta", seawater.moved_temperature(warm, "s", "pr", F.lit(0.0))).withColumn("variance", wide)
    pge = posterior_error(F.col("theta") - F.col("clim"), F.col("variance"), gross_error(F.col("probe"), F.col("suspect")))
    return theta.withColumn("pge", pge).select("uid", "lev", F.coalesce(F.col("pge") >= 0.5, F.lit(False)).alias("flag"), "pge", "theta", "clim")


def near_cells(profiles: DataFrame, cells: DataFrame, step: float = 0.25) -> DataFrame:
    """Profiles with the nearest grid point within one step (in degrees, across the date line), or nothing."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    profiles = one_header(profiles)
    row, col, turns = F.floor(F.col("lat") / step).cast("int"), F.floor(F.col("lon") / step).cast("int"), int(360 / step)
    seek = profiles.select("uid", "lat", "lon", F.explode(around).alias("a")).select("*", F.explode(around).alias("b"))
    seek = seek.select("uid", "lat", "lon", (F.floor(F.col("lat") / step) + F.col("a")).cast("int").alias("row"), F.pmod(F.floor(F.col("lon") / step) + F.col("b"), F.lit(turns)).cast("int").alias("column"))
    points = cells.select("*", row.alias("row"), F.pmod(col, F.lit(turns)).alias("column"), F.col("lat").alias("plat"), F.col("lon").alias("plon")).drop("lat", "lon")
    met = seek.join(points.hint("merge"), ["row", "column"])  # as many points as places: never broadcast
    away = F.sqrt(F.pow(F.col("plat") - F.col("lat"), 2) + F.pow(geo.nearest_turn(F.col("plon"), F.col("lon")) - F.col("lon"), 2))
    best = met.withColumn("away", away).where(F.col("away") <= step).groupBy("uid").agg(F.min_by("col", F.struct("away", "plat", "plon")).alias("col"))
    return best


def climatology(levels: DataFrame, profiles: DataFrame, grid: DataFrame, most: float = 5.0, step: float = 0.25) -> DataFrame:
    """``uid, lev, flag`` (a05, t11, t12): more than ``most`` deviations from the mean of the nearest grid point."""
    cells = columns_of(grid, ("lat", "lon"), ("mean", "sd"))
    on = with_profile(levels, near_cells(profiles, cells, step))
    on = on.select("uid", "lev", "z", "t", once(around_depth(F.col("col"), F.col("z"))).alias("around"))
    on = on.select("uid", "lev", "t", *(between(F.col("around"), F.col("z"), f).alias(f) for f in ("mean", "sd")))
    mean, sd = F.col("mean"), F.col("sd")
    return on.select("uid", "lev", F.coalesce((sd > 0) & (F.abs(F.col("t") - mean) / F.nullif(sd, F.lit(0.0)) > most), F.lit(False)).alias("flag"))


def _bin(z: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin [edge, next edge) that holds ``z``; NULL outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((z >= edges[k]) & (z < edges[k + 1]), k).otherwise(out)
    return out


def local_climatology(levels: DataFrame, profiles: DataFrame, monthly: DataFrame, annual: DataFrame, edges: Sequence[float], monthly_bins: int = 15) -> DataFrame:
    """``uid, lev, flag`` (i09): outside of median +/- 3 deviations of a half-degree cell's depth bin.

    ``monthly`` is ``ix, iy, k, month, med, amd`` and ``annual`` the same without month; the annual values serve deep
    bins, unknown months, and monthly values that are missing (a negative deviation or a median below -2.3).
    """
    closed = (F.col("lat").between(35, 45) & F.col("lon").between(45, 60)) | (F.col("lat").between(40, 50) & F.col("lon").between(-95, -75))
    at = one_header(profiles).where(~closed).select("uid", "month", F.floor((F.col("lon") + 180) / 0.5).cast("int").alias("ix"), F.floor((90 - F.col("lat")) / 0.5).cast("int").alias("iy"))
    rows = levels.where("z >= 0 AND t IS NOT NULL").select("uid", "lev", "t", _bin(F.col("z"), edges).alias("k")).where("k IS NOT NULL").transform(with_profile, at, "inner")
    named = lambda g, p: g.withColumnRenamed("med", f"{p}_med").withColumnRenamed("amd", f"{p}_amd")
    got = rows.join(named(monthly, "m"), ["ix", "iy", "k", "month"], "left").join(named(annual, "y"), ["ix", "iy", "k"], "left")
    fit = (F.col("k") <= monthly_bins) & (F.col("m_amd") >= 0) & (F.col("m_med") >= -2.3)
    usable = (F.col("y_amd") >= 0) & (F.col("y_med") >= -2.3)
    med = F.when(fit, F.col("m_med")).when(usable, F.col("y_med"))
    amd = F.when(fit, F.col("m_amd")).when(usable, F.col("y_amd"))
    amd = F.when((amd > 0) & (amd < 0.05), 0.05).otherwise(amd)
    bad = (F.col("t") < F.greatest(med - 3 * amd, F.lit(-2.3))) | (F.col("t") > F.least(med + 3 * amd, F.lit(33.0)))
    found = got.select("uid", "lev", F.when(med.isNotNull(), bad).alias("bad"))
    return levels.select("uid", "lev").join(found, ["uid", "lev"], "left").select("uid", "lev", F.coalesce("bad", F.lit(False)).alias("flag"))


def two_bin_climatology(levels: DataFrame, profiles: DataFrame, monthly: DataFrame, annual: DataFrame, edges: Sequence[float], monthly_bins: int = 37) -> DataFrame:
    """``uid, lev, flag`` (i10): outside of the wider range of the two depths around a level, at the nearest cell.

    ``monthly`` is ``i, j, k, month, tmin, tmax`` and ``annual`` the same without month; where neither has both depths,
    the global range -2 to 33 holds.
    """
    lon = F.when((F.col("lon") >= 180) & (F.col("lon") < 360), F.col("lon") - 360).otherwise(F.col("lon"))
    at = one_header(profiles).select("uid", "month", F.bround((lon + 180) / 0.5).cast("int").alias("i"), F.bround((90 - F.col("lat")) / 0.5).cast("int").alias("j")).where("i BETWEEN 0 AND 720 AND j BETWEEN 0 AND 360")
    rows = levels.where("z IS NOT NULL AND t IS NOT NULL").select("uid", "lev", "t", _bin(F.col("z"), edges).alias("k")).where("k IS NOT NULL").transform(with_profile, at, "inner")
    shifted = lambda g, p, by: g.select(*(c for c in ("i", "j", "month") if c in g.columns), (F.col("k") - by).alias("k"), F.col("tmin").alias(f"{p}_lo"), F.col("tmax").alias(f"{p}_hi"))
    for p, by in (("m0", 0), ("m1", 1)):
        rows = rows.join(shifted(monthly, p, by), ["i", "j", "month", "k"], "left")
    for p, by in (("y0", 0), ("y1", 1)):
        rows = rows.join(shifted(annual, p, by), ["i", "j", "k"], "left")
    full = lambda a: F.col(f"{a}0_lo").isNotNull() & F.col(f"{a}1_lo").isNotNull() & F.col(f"{a}0_hi").isNotNull() & F.col(f"{a}1_hi").isNotNull()
    pick = lambda fn, end, other: F.when((F.col("k") < monthly_bins) & full("m"), fn(f"m0_{end}", f"m1_{end}")).when(full("y"), fn(f"y0_{end}", f"y1_{end}")).otherwise(F.lit(other))
    bad = (F.col("t") < pick(F.least, "lo", -2.0)) | (F.col("t") > pick(F.greatest, "hi", 33.0))
    return levels.select("uid", "lev").join(rows.select("uid", "lev", bad.alias("bad")), ["uid", "lev"], "left").select("uid", "lev", F.coalesce("bad", F.lit(False)).alias("flag"))


def region_range(levels: DataFrame, profiles: DataFrame, cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """``uid, lev, flag`` (o04): outside of a region's range for the depth; the first level is never tested.

    ``cells`` is ``glat, glon, region`` (points at half degrees) and ``ranges`` is ``region, depth, tmin, tmax``; a level
    belongs to the first depth that is not above it, and passes below the deepest one.
    """
    wrap = lambda c, half: F.pmod(F.bround(c - 0.5) + 0.5 + half, F.lit(2.0 * half)) - half
    at = one_header(profiles).select("uid", wrap(F.col("lat"), 90).alias("glat"), wrap(F.col("lon"), 180).alias("glon")).join(cells, ["glat", "glon"]).select("uid", "region")
    table = columns_of(ranges, ("region",), ("tmin", "tmax"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy("lev"))
    on = levels.withColumn("_i", place).transform(with_profile, at).join(table, "region", "left")
    hit = F.get(F.filter("col", lambda x: x["depth"] >= F.col("z")), F.lit(0))
    bad = (F.col("_i") > 1) & F.col("z").isNotNull() & ((F.col("t") < hit["tmin"]) | (F.col("t") > hit["tmax"]))
    return on.select("uid", "lev", F.coalesce(bad, F.lit(False)).alias("flag"))


def all_land(relief: DataFrame, nlat: int, nlon: int, reach: int = 2) -> DataFrame:
    """``ilat, ilon, land``: whether all points within ``reach`` are land; longitudes wrap, beyond the poles is ocean.

    Each point sends its height to its neighbours: one shuffle with partial aggregates instead of a self-join.
    """
    offsets = F.array(*(F.lit(k) for k in range(-reach, reach + 1)))
    sent = relief.select("ilat", "ilon", "height", F.explode(offsets).alias("a")).select("*", F.explode(offsets).alias("b"))
    sent = sent.select((F.col("ilat") + F.col("a")).alias("ilat"), F.pmod(F.col("ilon") + F.col("b"), F.lit(nlon)).alias("ilon"), "height")
    seen = sent.groupBy("ilat", "ilon").agg(F.min("height").alias("low"), F.count("*").alias("n"))
    return seen.where(F.col("ilat").between(0, nlat - 1)).select("ilat", "ilon", ((F.col("low") >= 0) & (F.col("n") == (2 * reach + 1) ** 2)).alias("land"))


def at_sea(levels: DataFrame, profiles: DataFrame, relief: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int], reach: int = 2) -> DataFrame:
    """``uid, lev, flag`` (o05; t14 with a reach of 0): impossible positions, or land all around."""
    land = all_land(relief, lat[2], lon[2], reach)
    wrong = ~F.col("lon").between(-180, 359.999999) | ~F.col("lat").between(-90, 90)
    cells = nearest_cells(one_header(profiles), lat, lon).join(land, ["ilat", "ilon"], "left")
    flag = F.when(F.col("lat").isNull() | F.col("lon").isNull(), False).otherwise(F.coalesce(wrong | F.col("land"), F.lit(False)))
    return with_profile(levels.select("uid", "lev"), cells.select("uid", flag.alias("flag"))).select("uid", "lev", F.coalesce("flag", F.lit(False)).alias("flag"))


def below_bottom(levels: DataFrame, profiles: DataFrame, relief: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """``uid, lev, flag`` (o01): deeper than the bottom at the nearest relief point."""
    floor = nearest_cells(one_header(profiles), lat, lon).join(relief, ["ilat", "ilon"], "left").select("uid", (-F.col("height")).alias("floor"))
    return with_profile(levels, floor).select("uid", "lev", F.coalesce(F.col("z") > F.col("floor"), F.lit(False)).alias("flag"))


#: Corners of two seas with their own temperature ranges.
RED_SEA = ((10.0, 20.0, 30.0, 10.0), (40.0, 50.0, 30.0, 40.0))
MEDITERRANEAN = ((30.0, 30.0, 40.0, 42.0, 50.0, 40.0, 30.0), (6.0, 40.0, 35.0, 20.0, 15.0, 5.0, 6.0))


def regional_range(levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, flag`` (r05): outside of the range of the Red Sea or the Mediterranean."""
    seas = one_header(profiles).select("uid", in_region(F.col("lat"), F.col("lon"), *RED_SEA).alias("red"), in_region(F.col("lat"), F.col("lon"), *MEDITERRANEAN).alias("med"))
    bad = (F.col("red") & ~F.col("t").between(21.7, 40)) | (F.col("med") & ~F.col("t").between(10, 40))
    return with_profile(levels, seas).select("uid", "lev", F.coalesce(bad, F.lit(False)).alias("flag"))


def envelope(levels: DataFrame, bounds: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """``uid, lev, flag`` (t06): outside of a depth-dependent envelope of (from, to, tmin, tmax), half-open at the top."""
    bad = F.lit(False)
    for lo, hi, tmin, tmax in bounds:
        bad = bad | ((F.col("z") > lo) & (F.col("z") <= hi) & ~F.col("t").between(tmin, tmax))
    return levels.select("uid", "lev", F.coalesce(bad, F.lit(False)).alias("flag"))


def hex_cells(profiles: DataFrame, cells: DataFrame) -> DataFrame:
    """``uid, cell``: the polygon among the three nearest centres that holds a position.

    ``cells`` is ``cell, lat, lon, corners array<struct<lat,lon>>``. Centres are found through 10-degree boxes and those
    around them, of the boxes at a pole all, then ranked by angle to 1e-9 degrees and by number. Positions with coordinates beyond 999 are none.
    """
    box = lambda lat, lon: (F.least(F.floor((lat + 90) / 10), F.lit(17)), F.pmod(F.floor((lon + 180) / 10), F.lit(36)))
    fit = profiles.where((F.abs("lat") <= 999) & (F.abs("lon") <= 999))
    y, x = box(F.col("lat"), F.col("lon"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    polar = lambda by: (by <= 0) | (by >= 17)
    row, beside = y + F.col("a"), F.transform(around, lambda b: F.pmod(x + b, F.lit(36)))
    reach = F.when(polar(y) & polar(row), F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))).otherwise(beside)
    seek = fit.select("uid", "lat", "lon", F.explode(around).alias("a")).select("uid", "lat", "lon", row.alias("by"), F.explode(reach).alias("bx"))
    cy, cx = box(F.col("lat"), F.col("lon"))
    centres = cells.select("cell", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "corners", cy.alias("by"), cx.alias("bx"))
    met = seek.join(centres, ["by", "bx"]).withColumn("angle", F.round(geo.central_angle(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 9))
    near = met.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy("angle", "cell"))).where("_r <= 3")
    n = F.size("corners")
    corner = lambda i: F.get("corners", F.pmod(i, n))
    turn = lambda c: geo.nearest_turn(c, geo.nearest_turn(F.col("clon"), F.col("lon")))  # noqa: E731  # all corners with their centre
    crossed = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (
            ((corner(i)["lat"] > F.col("lat")) != (corner(i + 1)["lat"] > F.col("lat")))
            & (F.col("lon") < turn(corner(i)["lon"]) + (F.col("lat") - corner(i)["lat"]) / F.nullif(corner(i + 1)["lat"] - corner(i)["lat"], F.lit(0.0)) * (turn(corner(i + 1)["lon"]) - turn(corner(i)["lon"])))
        ).cast("int"),
    )
    holds = F.aggregate(crossed, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 2 == 1
    return near.where(holds).groupBy("uid").agg(F.min_by("cell", "_r").alias("cell"))


def min_max(levels: DataFrame, profiles: DataFrame, cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """``uid, lev, flag`` (o06): outside of the (tmin, tmax) of a cell's pressure bin; ``bounds`` is ``cell, lo, hi, tmin, tmax``."""
    profiles = one_header(profiles)
    at = hex_cells(profiles, cells).join(profiles.select("uid", "lat"), "uid")
    bins = bounds.groupBy("cell").agg(F.collect_list(F.struct("lo", "hi", "tmin", "tmax")).alias("bins"))
    on = with_profile(levels, at).join(bins, "cell", "left").withColumn("pr", seawater.depth_to_pressure(F.col("z"), F.col("lat")))
    hit = F.get(F.filter("bins", lambda b: (b["lo"] < F.col("pr")) & (F.col("pr") <= b["hi"])), F.lit(0))
    return on.select("uid", "lev", F.coalesce((F.col("t") < hit["tmin"]) | (F.col("t") > hit["tmax"]), F.lit(False)).alias("flag"))


def features(levels: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Levels with the features that the combined checks judge: gradient, spike and rate of change, from one window pass."""
    w = Window.partitionBy("uid").orderBy("lev")
    a, b = F.lag("t").over(w), F.lead("t").over(w)
    off = F.abs(F.col("t") - (a + b) / 2)
    rows = levels.select("uid", "lev", off.alias("gradient"), F.abs(off - F.abs((b - a) / 2)).alias("spike"), F.abs(F.col("t") - a).alias("rate"))
    return rows, {n: F.col(n) for n in ("gradient", "spike", "rate")}


def _ramp(x: Column, a: float, b: float) -> Column:
    """0 up to ``a``, 1 from ``b`` on, linear between; downwards if ``b`` is less; NULL for NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a))))


def _over(x: Column, corners: Sequence[float]) -> Column:
    """Membership of a trapezoid ``(a, b, c, d)``; two corners are a ramp."""
    if len(corners) == 2:
        return _ramp(x, *corners)
    a, b, c, d = corners
    return F.least(_ramp(x, a, b), _ramp(x, d, c))


#: What *low*, *medium* and *high* mean for the uncertainty of a level, which lies between 0 and 1.
UNCERTAINTY = {"low": (0.0, 0.225, 0.225, 0.45), "medium": (0.275, 0.5, 0.5, 0.725), "high": (0.55, 0.775)}
_STEPS = 50


@F.pandas_udf(T.DoubleType())
def _halved(low: pd.Series, medium: pd.Series, high: pd.Series) -> pd.Series:
    """Where the area of the cut output sets is halved, for the levels of a batch at once; NULL without an area."""
    grid, height = np.arange(_STEPS + 1) / float(_STEPS), np.zeros((len(low), _STEPS + 1))
    ramp = lambda a, b: np.maximum(0.0, np.minimum(1.0, (grid - a) / (b - a)))
    for cut, corners in zip((low, medium, high), UNCERTAINTY.values(), strict=True):
        own = ramp(*corners) if len(corners) == 2 else np.minimum(ramp(corners[0], corners[1]), ramp(corners[3], corners[2]))
        np.maximum(height, np.minimum(cut.to_numpy(float)[:, None], own), out=height)
    upto = np.cumsum(height, axis=1)
    whole = upto[:, -1:]
    at = (upto >= whole / 2 - 1e-9).argmax(axis=1) / float(_STEPS)
    return pd.Series(at, dtype="Float64").mask(~(whole[:, 0] > 0))


def uncertainty(rows: DataFrame, features: dict[str, Column], memberships: dict[str, dict[str, Sequence[float]]]) -> DataFrame:
    """``uid, lev, uncertainty``: the defuzzified uncertainty of each level. Rule strengths are the mean membership of the
    features in *low* and in *medium*, and the largest in *high*; these cut the output sets, and their union is halved by area.

    A membership is a ramp (two corners, downwards for *low*) or a trapezoid (four). Missing features are left out; NULL
    without any.
    """
    own = {level: [_over(features[n].cast("double"), m[level]) for n, m in memberships.items()] for level in UNCERTAINTY}
    held = rows.select("uid", "lev", *(a.alias(f"{level}{k}") for level, each in own.items() for k, a in enumerate(each)))
    cells = lambda level: [F.col(f"{level}{k}") for k in range(len(own[level]))]
    total = lambda level: reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in cells(level)), F.lit(0.0))
    known = lambda level: reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in cells(level)))
    most = lambda level: F.greatest(*cells(level)) if len(own[level]) > 1 else cells(level)[0]
    strength = held.select("uid", "lev", *((most(level) if level == "high" else F.try_divide(total(level), known(level))).alias(level) for level in UNCERTAINTY))
    return strength.select("uid", "lev", _halved("low", "medium", "high").alias("uncertainty"))


def fuzzy(levels: DataFrame, features: dict[str, Column], memberships: dict[str, dict[str, Sequence[float]]], most: float = 0.34) -> DataFrame:
    """``uid, lev, flag`` (t16, t17): levels whose uncertainty is above ``most``."""
    return uncertainty(levels, features, memberships).select("uid", "lev", F.coalesce(F.col("uncertainty") > most, F.lit(False)).alias("flag"))


def log_survival(x: Column, shape: float, power: float, place: float, scale: float) -> Column:
    """Log of the survival function of an exponentiated Weibull law; with shape and power 1, of an exponential one."""
    y = F.greatest((x - place) / scale, F.lit(0.0))
    below = 1.0 - F.exp(-F.pow(y, F.lit(power)))
    return F.log(F.greatest(1.0 - F.pow(below, F.lit(shape)), F.lit(1e-300)))


def anomaly(levels: DataFrame, features: dict[str, Column], laws: dict[str, tuple[float, float, float, float]], least: float = -18.0) -> DataFrame:
    """``uid, lev, flag`` (t15): sum over features of the log survival under laws ``(shape, power, place, scale)`` below ``least``."""
    total = sum((F.coalesce(log_survival(F.abs(features[n].cast("double")), *law), F.lit(0.0)) for n, law in laws.items()), F.lit(0.0))
    return levels.select("uid", "lev", (total < least).alias("flag"))
