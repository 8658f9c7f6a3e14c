"""Places and times as column expressions: great circles, time gaps, longitudes, polygons, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_367_000.0


def haversine(theta: Column) -> Column:
    return F.pow(F.sin(theta / 2), 2)


def arc_haversine(h: Column) -> Column:
    """Inverse of ``haversine``; a root slightly above 1 is rounded to ten places first."""
    r = F.sqrt(h)
    return 2 * F.asin(F.when(r > 1, F.round(r, 10)).otherwise(r))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in m."""
    a, b = F.radians(lat1), F.radians(lat2)
    return RADIUS * arc_haversine(haversine(b - a) + F.cos(a) * F.cos(b) * haversine(F.radians(lon2) - F.radians(lon1)))


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in degrees."""
    return F.degrees(distance(lat1, lon1, lat2, lon2) / RADIUS)


def corner(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat3: Column, lon3: Column) -> Column:
    """Angle at the second point of a path; 0 if a side is 0, NULL if a point is missing."""
    a, b, c = (distance(*x) / RADIUS for x in ((lat1, lon1, lat2, lon2), (lat2, lon2, lat3, lon3), (lat1, lon1, lat3, lon3)))
    cosine = (F.cos(c) - F.cos(a) * F.cos(b)) / (F.sin(a) * F.sin(b))
    return F.when((a == 0) | (b == 0), F.lit(0.0)).when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def clock(time: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second of a time in hours."""
    return F.floor(time), F.floor(60 * time) % 60, F.floor(3600 * time) % 60


def moment(year: Column, month: Column, day: Column, time: Column) -> Column:
    """Timestamp of a date and a time in hours; NULL if either is invalid."""
    h, m, s = (x.cast("int") for x in clock(time))
    return F.when((time >= 0) & (time < 24), F.try_make_timestamp(year, month, day, h, m, s))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)).cast("double")


def time_apart(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Absolute gap in s between two dates; an invalid time of day counts as midnight, an invalid date gives NULL."""
    at = lambda y, m, d, t: F.coalesce(moment(y, m, d, t), F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)))
    return F.abs(seconds_between(at(*a), at(*b)))


def normal_latitude(lat: Column) -> Column:
    """Latitudes beyond a pole come back on the other side."""
    return F.round(F.degrees(F.asin(F.sin(F.radians(lat)))), 6)


def wrap_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def wrap_180(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def nearest_turn(lon: Column, other: Column) -> Column:
    """``lon`` moved by whole turns to lie within 180 degrees of ``other``."""
    return lon + F.when(lon - other > 180, F.lit(-360.0)).when(lon - other < -180, F.lit(360.0)).otherwise(F.lit(0.0))


def polar(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Lambert equal-area coordinates around the north pole with central meridian 40 W (spherical)."""
    r, a = 2 * RADIUS * F.sin(F.radians(90 - lat) / 2), F.radians(lon + 40)
    return r * F.sin(a), -r * F.cos(a)


def inside(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point lies in a polygon, by counting crossed edges."""
    crossed = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        crossed.append((((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))).cast("int"))
    return reduce(lambda a, b: a + b, crossed) % 2 == 1


def in_region(lat: Column, lon: Column, lats: tuple[float, ...], lons: tuple[float, ...]) -> Column:
    """Whether a position lies in a region given by its corners, on the polar map."""
    return inside(*polar(lat, lon), [polar(F.lit(float(a)), F.lit(float(o))) for a, o in zip(lats, lons, strict=True)])


def linear(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return (x - x0) / (x1 - x0) * (y1 - y0) + y0


def grid_index(value: Column, origin: float, step: float, n: int, cyclic: bool = False) -> Column:
    """Index of the nearest point of an even grid, halves to the even index; the far edge of a closed axis is its last."""
    i = F.bround((value - origin) / step).cast("int")
    return F.pmod(i, F.lit(n)) if cyclic else F.when(i == n, F.lit(n - 1)).otherwise(i)


def nearest_index(values: Column, x: Column) -> Column:
    """Index of the array element nearest to ``x``, the lower one on ties."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]


def bracket_partner(values: Column, x: Column) -> Column:
    """Index of the neighbour that brackets ``x`` together with the nearest element."""
    i = nearest_index(values, x)
    return F.when(F.get(values, i) > x, i - 1).otherwise(i + 1)
