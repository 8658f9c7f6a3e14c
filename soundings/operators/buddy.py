"""Standard-level check with neighbouring profiles ("buddies") as window and join operations (check e09)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..lineage import cut
from ..schema import one_header
from . import gridded, local, rules, sequential
from .gridded import gross_error, posterior_error

REACH_M, BAND = 400_000.0, 5.0


def standard_levels(levels: DataFrame, depths: Sequence[float]) -> DataFrame:
    """``uid, k, diff, n``: mean of ``diff`` (``uid, lev, z, diff``) over the levels nearest to each standard depth."""
    nearest = geo.nearest_index(F.array(*(F.lit(float(d)) for d in depths)), F.col("z"))
    return levels.where("diff IS NOT NULL AND z IS NOT NULL").withColumn("k", nearest).groupBy("uid", "k").agg(F.avg("diff").alias("diff"), F.count("*").alias("n"))


def _merged(rows: DataFrame, of: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined with a table that grows with the profiles: sorted and merged.

    What is exploded from the headers is small only by Spark's estimate of their files; by it Spark would broadcast a table that does
    not fit the driver. So is it with packed or repeated columns, which are small only as shuffled bytes.
    """
    return rows.join(of.hint("merge"), [*on], how)


def _cells_around() -> Column:
    """By latitude band (5 degrees, numbered from the equator): how many longitude cells there are, each at least as wide as
    the reach on that band and those beside it; one around the poles."""
    counts = {}
    for band in range(-20, 20):
        far = min(90.0, max(abs(BAND * (band - 1)), abs(BAND * (band + 2))))
        side = math.sin(REACH_M / (2 * geo.RADIUS)) / max(math.cos(math.radians(far)), 1e-9)
        counts[band] = max(1, int(360 / math.degrees(2 * math.asin(side)))) if side < 1 else 1
    return F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))


#: Places of a cell that are compared one by one; cells of more are divided in four by four, at most so many halvings deep.
LEAF, DEEPEST, STEP = 32, 30, 2
_MONTH = ("year", "month")
_NODE = (*_MONTH, "band", "cell", "depth", "ix", "iy")


def _positions(profiles: DataFrame) -> DataFrame:
    """Places where a buddy may be: of the profiles of a month at one place the first uid, and the first of another cruise.

    Whatever the cruise that seeks, the first buddy at that place is one of these two.
    """
    rows = profiles.where("cruise IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    firsts = rows.groupBy(*_MONTH, "lat", "lon", "cruise").agg(F.min("uid").alias("uid"))
    place = Window.partitionBy(*_MONTH, "lat", "lon").orderBy("uid")
    return firsts.withColumn("_r", F.row_number().over(place)).where("_r <= 2").drop("_r")


def _at(points: DataFrame, depth: int) -> DataFrame:
    side = float(1 << depth)
    return points.withColumn("depth", F.lit(depth)).withColumn("ix", F.floor(F.col("x") * side).cast("long")).withColumn("iy", F.floor(F.col("y") * side).cast("long"))


def _tree(points: DataFrame, leaf: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """By depth, cells and the places they are made of; cells have ``n``, the bounds of their places, and a profile of the first and of
    the last cruise.

    Only cells of more than ``leaf`` places have cells below them; the places (``x, y`` from 0 to 1 in their outermost cell) of no
    others are looked at again.
    """
    out, left = [], points
    for depth in range(0, DEEPEST + 1, STEP):
        at = _at(left, depth)
        one = F.struct("cruise", "uid", "lat", "lon")
        bounds = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "lo"), (F.max, "hi"))]
        cells = at.groupBy(*_NODE).agg(F.count("*").alias("n"), *bounds, F.min(one).alias("first"), F.max(one).alias("last"))
        cells = cut(cells) if depth else cells.cache()
        out.append((depth, cells, at))
        full = cells.where(F.col("n") > leaf)
        if depth == DEEPEST or full.isEmpty():
            return out
        left = cut(_merged(at, full.select(*_NODE), _NODE, "left_semi").drop("depth", "ix", "iy"))
    return out


def _away_from(cell_lat: tuple[str, str], cell_lon: tuple[str, str]) -> Column:
    """No place between these bounds is nearer than so many metres: by latitude, and by the distance to the nearest meridian.

    Latitudes beyond a pole, which lie on its other side, bound nothing.
    """
    lat, lon = F.col("lat"), F.col("lon")
    beside = lambda x, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - x, x - F.col(hi))
    turned = F.least(*(beside(lon + k, *cell_lon) for k in (-360.0, 0.0, 360.0)))
    across = F.asin(F.least(F.lit(1.0), F.abs(F.cos(F.radians(lat))) * F.sin(F.radians(F.least(turned, F.lit(90.0))))))
    least = geo.RADIUS * F.greatest(F.radians(beside(lat, *cell_lat)), across) - 0.01  # a centimetre for rounding
    return F.when((F.abs(lat) > 90) | (F.col(cell_lat[0]) < -90) | (F.col(cell_lat[1]) > 90), 0.0).otherwise(least)


def buddies(profiles: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``uid, buddy, metres``: the nearest profile of another cruise in the same year and month within 400 km (so within 5
    degrees of latitude), the first uid of those that are equally near to the millimetre.

    Places meet through cells of latitude bands and, within a band, of longitudes; a profile seeks in its own cell and those beside
    it. Cells of many places are divided until few are left in each. A search goes down all cells at once, a level a round: it keeps
    those that can hold something as near as the nearest place known so far, of which every cell names two of different cruises. So
    a month's places that crowd into one cell cost each profile a few cells a level, and all pairs meet only within the smallest cells.
    """
    profiles = one_header(profiles)
    number, around = _cells_around(), F.array(F.lit(-1), F.lit(0), F.lit(1))
    cells = lambda band: F.coalesce(F.try_element_at(number, band), F.lit(1))
    across = lambda lon, band: F.pmod(lon, F.lit(360.0)) / 360.0 * cells(band)
    cell = lambda lon, band: F.floor(across(lon, band)).cast("int")
    band = F.floor(F.col("lat") / BAND).cast("int")
    here = F.pmod(cell(F.col("lon"), F.col("band")), cells(F.col("band")))
    points = _positions(profiles).withColumn("band", band).withColumn("cell", here)
    points = points.withColumn("x", across(F.col("lon"), F.col("band")) - F.floor(across(F.col("lon"), F.col("band")))).withColumn("y", F.col("lat") / BAND - F.floor(F.col("lat") / BAND))
    levels = _tree(points, leaf)

    seekers = profiles.where("cruise IS NOT NULL").select("uid", "cruise", "lat", "lon", *_MONTH)
    reach = F.array_distinct(F.transform(around, lambda a: F.pmod(cell(F.col("lon"), F.col("band")) + a, cells(F.col("band")))))
    front = seekers.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("cell", F.explode(reach))
    front = front.withColumn("depth", F.lit(0)).withColumn("ix", F.lit(0).cast("long")).withColumn("iy", F.lit(0).cast("long")).withColumn("best", F.lit(REACH_M))
    lone = lambda name: F.when(F.col(f"{name}.cruise") != F.col("cruise"), geo.distance(F.col("lat"), F.col("lon"), F.col(f"{name}.lat"), geo.nearest_turn(F.col(f"{name}.lon"), F.col("lon"))))
    bounds = [c for c in levels[0][1].columns if c not in _NODE]
    side = F.sequence(F.lit(0), F.lit((1 << STEP) - 1))
    leaves: DataFrame | None = None
    ends: DataFrame | None = None  # the places of the smallest cells
    for depth, level, at in levels:
        small = (F.col("n") <= leaf) | F.lit(depth == DEEPEST)
        known = F.min(F.least(F.col("best"), lone("first"), lone("last"))).over(Window.partitionBy("uid"))
        met = _merged(front, level, _NODE).where((F.col("first.cruise") != F.col("cruise")) | (F.col("last.cruise") != F.col("cruise")))
        kept = met.withColumn("best", known).withColumn("least", _away_from(("lat_lo", "lat_hi"), ("lon_lo", "lon_hi"))).where(F.col("least") <= F.col("best"))
        if len(levels) > 1:
            kept = cut(kept)
            at = _merged(at, level.where(small).select(*_NODE), _NODE, "left_semi")
        done = kept.where(small).select("uid", "cruise", "lat", "lon", *_NODE, "best", "least")
        places = at.select(*_NODE, F.col("uid").alias("buddy"), F.col("cruise").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        leaves, ends = (done, places) if leaves is None else (leaves.unionByName(done), ends.unionByName(places))
        below = kept.where(~small).drop(*bounds, "least").withColumn("depth", F.lit(depth + STEP))
        below = below.withColumn("_x", F.explode(side)).withColumn("_y", F.explode(side))
        front = below.withColumn("ix", F.col("ix") * (1 << STEP) + F.col("_x")).withColumn("iy", F.col("iy") * (1 << STEP) + F.col("_y")).drop("_x", "_y")
    fit = leaves.withColumn("best", F.min("best").over(Window.partitionBy("uid"))).where(F.col("least") <= F.col("best")) if len(levels) > 1 else leaves
    pairs = _merged(fit, ends, _NODE).where(F.col("cruise") != F.col("other"))
    away = geo.distance(F.col("lat"), F.col("lon"), F.col("lat2"), geo.nearest_turn(F.col("lon2"), F.col("lon")))
    best = pairs.withColumn("metres", away).groupBy("uid").agg(F.min(F.struct(F.round("metres", 3).alias("near"), "buddy", "metres")).alias("m"))
    return best.select("uid", F.col("m.buddy").alias("buddy"), F.col("m.metres").alias("metres")).where(F.col("metres") <= REACH_M)


def covariance(metres: Column, seconds: Column, a: Column, b: Column) -> Column:
    """Covariance of the background errors of two profiles: half meso-scale (100 km), half synoptic (400 km)."""
    late = F.pow(seconds / 432_000.0, 2)
    part = lambda km: F.sqrt(a / 2 * b / 2) * (1 + metres / (1000.0 * km)) * F.exp(-metres / (1000.0 * km) - late)
    return part(100.0) + part(400.0)


def union_of_prior(background: DataFrame | None, found: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """``uid, lev, flag``: the union of the checks that a level must pass before it counts at a standard level.

    ``background`` is the result of e07 (None where its flags are taken otherwise), ``found`` that of the sequential checks, ``others``
    are flags of further checks.
    """
    disorder = found.select("uid", "lev", (F.col("reject") | F.col("disorder")).alias("flag"))
    return rules.any_flag([disorder, *others] if background is None else [background, disorder, *others])


def prior_flags(levels: DataFrame, profiles: DataFrame, background: DataFrame | None, found: DataFrame) -> DataFrame:
    """The union with the other checks (constant values, range, stability) run here."""
    return union_of_prior(background, found, [local.run_any(("e01_range", "e02_constant_value", "e06_stability"), levels, profiles)])


def standard_level_check(levels: DataFrame, profiles: DataFrame, grid: DataFrame, depths: Sequence[float], axes=gridded.BACKGROUND_AXES, near: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """``uid, lev, flag`` (e09): differences from the background of the levels that pass the six checks, at standard depths,
    compared with the buddy's. ``near`` (the result of e07) and ``prior`` (the union of the six) are made here if not given.

    The differences, which later steps use three times, are written to the checkpoint folder once.
    """
    if near is None or prior is None:
        found = sequential.sequential_flags(levels, profiles)
        near = gridded.background(levels, profiles, grid, found, axes) if near is None else near
        if prior is None:  # flags of e07 are taken beside its differences: a union with them would make it twice
            near = near.withColumn("_hit", F.max("flag").over(Window.partitionBy("uid", "lev"))).where("NOT _hit")
            prior = prior_flags(levels, profiles, None, found)
    diff = near.select("uid", "lev", (F.col("theta") - F.col("clim")).alias("diff"))
    diff = cut(_merged(diff.where("diff IS NOT NULL"), prior.where("NOT flag").select("uid", "lev"), ["uid", "lev"]))
    on = _merged(levels.select("uid", "lev", "z"), diff, ["uid", "lev"], "left")
    cells = gridded.columns_of(grid, ("ilat", "ilon"), ("clim", "bgev", "obev"))
    at = gridded.nearest_cells(one_header(profiles), *axes).join(cells, ["ilat", "ilon"]).select("uid", "col", F.posexplode(F.array(*(F.lit(float(d)) for d in depths))).alias("k", "depth"))
    at = at.select("uid", "k", "depth", gridded.once(gridded.around_depth(F.col("col"), F.col("depth"))).alias("around"))
    errors = at.select("uid", "k", *(gridded.between(F.col("around"), F.col("depth"), f).alias(f) for f in ("clim", "bgev", "obev"))).where("clim IS NOT NULL")
    return buddy_check(on, profiles, errors, depths)


def buddy_check(levels: DataFrame, profiles: DataFrame, errors: DataFrame, depths: Sequence[float]) -> DataFrame:
    """``uid, lev, flag``: levels of standard depths whose error stays probable after the buddy is heard.

    ``levels`` is ``uid, lev, z, diff`` (potential temperature less background of levels that passed the checks before;
    NULL otherwise) and ``errors`` is ``uid, k, bgev, obev, clim`` at the standard depths. The buddy's probability is
    computed from the profile's own differences with the buddy's variance, as specified; where the buddy has no difference, or the
    time between the two is unknown, the profile's own probability stays. A rejected level between
    accepted ones is reinstated if it lies within their values and a tolerance; accepted is meant before reinstating.
    """
    profiles = one_header(profiles)
    std = standard_levels(levels, depths)
    own = _merged(_merged(std, errors, ["uid", "k"]), profiles.select("uid", "lat", "probe", "year", "month", "day", "time"), ["uid"])
    wide = F.when(F.abs("lat") < 10, 2.25).otherwise(1.0)
    own = own.withColumn("pge0", posterior_error(F.col("diff"), F.col("obev") + F.col("bgev") * wide, gross_error(F.col("probe"), F.lit(False))))
    other = _merged(std, errors.select("uid", "k", "bgev"), ["uid", "k"]).select(F.col("uid").alias("buddy"), "k", F.col("diff").alias("diff2"), F.col("bgev").alias("bgev2"))
    when = profiles.select(F.col("uid").alias("buddy"), F.col("year").alias("y2"), F.col("month").alias("m2"), F.col("day").alias("d2"), F.col("time").alias("t2"), F.col("lat").alias("blat"), F.col("probe").alias("bprobe"))
    pairs = _merged(_merged(_merged(own, buddies(profiles), ["uid"], "left"), other, ["buddy", "k"], "left"), when, ["buddy"], "left")
    gap = geo.time_apart((F.col("year"), F.col("month"), F.col("day"), F.col("time")), (F.col("y2"), F.col("m2"), F.col("d2"), F.col("t2")))
    cov = covariance(F.col("metres"), gap, F.col("bgev"), F.col("bgev2"))
    va, vb = F.col("obev") + F.col("bgev"), F.col("obev") + F.col("bgev2")
    rho = cov * cov / (va * vb)
    log = -0.5 * F.log(1 - rho) - 0.5 * rho / (1 - rho) * (F.pow("diff", F.lit(2)) / va + F.pow("diff2", F.lit(2)) / vb - 2 * F.col("diff") * F.col("diff2") / cov)
    log = F.when(log.isNotNull(), F.greatest(F.lit(-80.0), F.least(F.lit(80.0), log)))  # bounds would replace a NULL
    heard = posterior_error(F.col("diff"), F.col("obev") + F.col("bgev2") * F.when(F.abs("blat") < 10, 2.25).otherwise(1.0), gross_error(F.col("bprobe"), F.lit(False)))
    z = F.try_divide(F.lit(1.0), 1 - (1 - F.col("pge0")) * (1 - heard) * (1 - log))
    scored = pairs.withColumn("pge", F.coalesce(F.col("pge0") * F.sqrt(F.when(z < 0, 1.0).otherwise(z)), F.col("pge0"))).select("uid", "k", "lat", "diff", "clim", "pge")
    w = Window.partitionBy("uid").orderBy("k")
    value = F.col("diff") + F.col("clim")
    side = lambda f: F.when((f("k").over(w) - F.col("k")).isin(-1, 1) & (f("pge").over(w) < 0.5), f(value).over(w))
    above, below = side(F.lag), side(F.lead)
    depth = F.get(F.array(*(F.lit(float(d)) for d in depths)), F.col("k"))
    base = F.when(F.abs("lat") < 20, 300.0).otherwise(200.0)
    slack = 0.5 * F.when(depth > base + 100, 0.5).when(depth > base, 1.0 - 0.005 * (depth - base)).otherwise(1.0)
    top, low = F.coalesce(above, below) + slack, F.coalesce(below, above) - slack
    kept = scored.withColumn("bad", (F.col("pge") >= 0.5) & ~F.coalesce(value.between(low, top), F.lit(False)))
    nearest = geo.nearest_index(F.array(*(F.lit(float(d)) for d in depths)), F.col("z"))
    on = levels.withColumn("k", F.when(F.col("diff").isNotNull(), nearest)).transform(_merged, kept.select("uid", "k", "bad"), ["uid", "k"], "left")
    return on.select("uid", "lev", F.coalesce("bad", F.lit(False)).alias("flag"))
