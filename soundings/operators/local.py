"""Checks of one profile: each is SQL over ``levels`` and ``profiles``, giving ``uid, lev, flag`` for every level.
A level without a header is judged without one; of headers that repeat a uid one counts.

Most checks are predicates over a level and its neighbours. ``run_local`` evaluates any number of those in one select, so
they share one exchange by ``uid`` and one sort by ``lev``; tables bucketed by ``uid`` save the exchange as well. Checks
that need several steps are queries of their own. A missing value never flags; a flag is never NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seawater
from ..schema import merged_headers
from .rules import any_flag

PRESSURE = "((1 - c1) - sqrt((1 - c1) * (1 - c1) - 8.84e-6 * z)) / 4.42e-6"

#: A level with its neighbours; ``i`` counts levels from 0, ``pr`` is the pressure at the level's depth.
NEIGHBOURS = f"""
SELECT *, {PRESSURE} AS pr FROM (
SELECT l.uid, l.lev, l.z, l.t, l.s, l.p, p.lat, p.lon, p.probe, p.country{{carried}},
  5.92e-3 + 5.25e-3 * sin(radians(p.lat)) * sin(radians(p.lat)) AS c1,
  row_number() OVER w - 1 AS i, count(*) OVER u AS n, count(l.t) OVER u AS n_t, min(l.t) OVER u AS min_t, max(l.t) OVER u AS max_t,
  lag(l.t, 1) OVER w AS t_p1, lag(l.t, 2) OVER w AS t_p2, lead(l.t, 1) OVER w AS t_n1, lead(l.t, 2) OVER w AS t_n2,
  lag(l.z, 1) OVER w AS z_p1, lag(l.z, 2) OVER w AS z_p2, lead(l.z, 1) OVER w AS z_n1,
  lag(l.s, 1) OVER w AS s_p1, count(l.p) OVER u AS n_p
FROM {{levels}} l LEFT JOIN {{profiles}} p ON l.uid = p.uid
WINDOW w AS (PARTITION BY l.uid ORDER BY l.lev), u AS (PARTITION BY l.uid)) x
"""


def neighbours(*carried: str) -> str:
    """The query above, with columns of the levels carried along."""
    return NEIGHBOURS.replace("{carried}", "".join(f", l.{c}" for c in carried))


def _both(pair: str) -> str:
    """A condition on a level (``a``) and the next (``b``) that flags both: as the first of one pair or the second of another."""
    return f"coalesce({pair.format(ta='t', tb='t_n1', za='z', zb='z_n1')}, FALSE) OR coalesce({pair.format(ta='t_p1', tb='t', za='z_p1', zb='z')}, FALSE)"


_MED3 = "greatest(least({0}, {1}), least(greatest({0}, {1}), {2}))"


def median3(a: str, b: str, c: str) -> str:
    return _MED3.format(a, b, c)


def median5(a: str, b: str, c: str, d: str, e: str) -> str:
    return _MED3.format(e, f"greatest(least({a}, {b}), least({c}, {d}))", f"least(greatest({a}, {b}), greatest({c}, {d}))")


def _density(s: str, t: str, p: str) -> str:
    a, b = seawater._P1, seawater._P2
    top = f"({a[0]!r} + {t}*({a[1]!r} + {t}*({a[2]!r} + {t}*({a[3]!r}))) + {s}*({a[4]!r} + ({a[5]!r})*{t} + {a[6]!r}*{s}) + {p}*({a[7]!r} + {a[8]!r}*{t}*{t} + {a[9]!r}*{s} + {p}*({a[10]!r} + ({a[11]!r})*{t}*{t})))"
    low = f"({b[0]!r} + {t}*({b[1]!r} + {t}*({b[2]!r} + {t}*({b[3]!r} + {t}*({b[4]!r})))) + {s}*({b[5]!r} + {t}*({b[6]!r} + ({b[7]!r})*{t}*{t})) + {s}*sqrt({s})*({b[8]!r} + {b[9]!r}*{t}*{t}) + {p}*({b[10]!r} + {p}*{t}*(({b[11]!r})*{t}*{t} + ({b[12]!r})*{p})))"
    return f"({top} / ({low} + 1e-20))"


def _theta(s: str, t: str, p: str) -> str:
    c = seawater._THETA
    return f"({t} + {p}*({c[0]!r} + ({c[1]!r})*{s} + ({c[2]!r})*{p} + ({c[3]!r})*{t} + ({c[4]!r})*{s}*{t} + ({c[5]!r})*{t}*{t} + ({c[6]!r})*{t}*{p}))"


_SPIKE = "abs(t - (t_p1 + t_n1) / 2) - abs((t_n1 - t_p1) / 2)"
_M5, _M3 = median5("t_p2", "t_p1", "t", "t_n1", "t_n2"), median3("t_p1", "t", "t_n1")
_OFF5, _OFF3 = "abs(t - (t_p2 + t_p1 + t_n1 + t_n2) / 4)", "abs(t - (t_p1 + t_n1) / 2)"
_GOOD = "coalesce(t >= -2.4 AND t <= 32 AND coalesce(abs(t - t_p1), 0) < 0.1 AND coalesce(abs(t_n1 - t), 0) < 0.1, FALSE)"
_DATABASE = "CASE probe WHEN 1 THEN 'MBT' WHEN 2 THEN 'XBT' WHEN 3 THEN 'MBT' WHEN 4 THEN 'CTD' WHEN 5 THEN 'OSD' WHEN 6 THEN 'OSD' WHEN 7 THEN 'OSD' WHEN 8 THEN 'SUR' WHEN 9 THEN 'PFL' WHEN 10 THEN 'MRB' WHEN 11 THEN 'DRB' WHEN 12 THEN 'UOR' WHEN 13 THEN 'APB' WHEN 14 THEN 'OSD' WHEN 15 THEN 'GLD' WHEN 16 THEN 'MBT' ELSE 'UNK' END"

#: Predicates over a level and its neighbours.
LOCAL = {
    "a01_gross_range": "coalesce(t < -2.5 OR t > 40, FALSE) OR coalesce(z < 0 OR z > 2000, FALSE)",
    "a02_constant": "n_t <> 1 AND min_t = max_t",
    "a03_gradient": _both("({zb} <> {za} AND (({tb} - {ta} < 0 AND abs(({tb} - {ta}) / ({zb} - {za})) > 1) OR ({tb} - {ta} >= 0 AND ({tb} - {ta}) / ({zb} - {za}) > 0.2)))"),
    "a04_spike": f"n >= 3 AND CASE WHEN i >= 2 AND i <= n - 3 THEN {{bround}}(abs(t - {_M5}), 2) <> 0 AND {{bround}}({_OFF5}, 2) > 0.3 AND t_p2 IS NOT NULL AND t_p1 IS NOT NULL AND t_n1 IS NOT NULL AND t_n2 IS NOT NULL"
    f" WHEN i = 1 OR i = n - 2 THEN {{bround}}(abs(t - {_M3}), 2) <> 0 AND {{bround}}({_OFF3}, 2) > 0.3 AND t_p1 IS NOT NULL AND t_n1 IS NOT NULL ELSE FALSE END",
    "r01_global_range": "coalesce(t < -2.5 OR t > 40, FALSE) OR coalesce(pr < -5, FALSE)",
    "r02_gradient": "abs(t - (t_p1 + t_n1) / 2) > CASE WHEN pr < 500 THEN 9 ELSE 3 END AND pr IS NOT NULL",
    "r03_spike": f"{_SPIKE} > CASE WHEN pr < 500 THEN 6 ELSE 2 END AND pr IS NOT NULL",
    "s01_constant_bottom": "probe = 2 AND n >= 2 AND i = n - 1 AND t = t_p1 AND lat > -40 AND z - z_p1 > 30",
    "s02_depth": "probe = 2 AND z < 3.6",
    "s04_short_gradient": "t_n1 <> t AND ((t_n1 - t > 0.5 AND z_n1 - z < 30) OR abs((z_n1 - z) / nullif(t_n1 - t, 0)) < 0.4 OR ((z_n1 - z) / nullif(t_n1 - t, 0) > 0 AND (z_n1 - z) / nullif(t_n1 - t, 0) < 12.5)) AND abs(t_n1 - t) > 0.4",
    "t01_gradient": "abs(t - (t_p1 + t_n1) / 2) > 9.0",
    "t02_gradient_strict": "abs(t - (t_p1 + t_n1) / 2) > 10.0",
    "t03_spike": f"abs({_SPIKE}) > 6.0",
    "t04_spike_strict": f"abs({_SPIKE}) > 2.0",
    "t05_global_range": "t < -2 OR t > 40",
    "t07_rate_of_change": "abs(t - t_p1) > 4.0",
    "t08_digit_roll_over": "abs(t - t_p1) > 10.0",
    "t13_density_inversion": f"{_density('s', 't', '0.0')} - {_density('s_p1', 't_p1', '0.0')} < -0.03",
    "e01_range": "t < -4 OR t > 40",
    "o02_gross_range": "t < -4 OR t > 100",
    "o03_gradient": _both("({zb} - {za} > 0 AND (({tb} - {ta}) / greatest({zb} - {za}, 3.0) > 0.3 OR ({tb} - {ta}) / greatest({zb} - {za}, 3.0) < -0.7))"),
    "i01_level_order": "z < 0",
    "i04_max_depth": f"z >= CASE WHEN {_DATABASE} IN ('OSD', 'CTD') THEN 9000.0 WHEN {_DATABASE} = 'PFL' THEN 2020.0 WHEN {_DATABASE} = 'APB' THEN 1200.0 WHEN {_DATABASE} = 'MBT' AND country = 'JP' THEN 295.00001 WHEN {_DATABASE} = 'XBT' THEN 1900.0 END",
}

_LEVELS_ALL = "(SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lev) - 1 AS i, count(*) OVER (PARTITION BY uid) AS n FROM {levels})"
#: Rows with depth and temperature at or below the surface, in order of depth; ties keep the level order.
_ORDERED = """(SELECT l.uid, l.lev, l.z, l.t, p.probe, p.country, row_number() OVER (PARTITION BY l.uid ORDER BY l.z, l.lev) - 1 AS j, count(*) OVER (PARTITION BY l.uid) AS m
  FROM {levels} l LEFT JOIN {profiles} p ON l.uid = p.uid WHERE l.z >= 0 AND l.t IS NOT NULL)"""
_BACK = "SELECT l.uid, l.lev, coalesce(q.flag, FALSE) AS flag FROM {{levels}} l LEFT JOIN ({0}) q ON l.uid = q.uid AND l.lev = q.lev"

# Temperature boxes, each with the least depth from which its temperatures are rejected (down to 9000 m).
_BOX_T = (-3.5, -2.5, -2.3, -2.0, -1.4, -1.0, -0.8, -0.5, -0.4, 3.0, 5.0, 5.5, 6.0, 7.0, 7.5, 8.8, 9.5, 10.0, 11.0, 12.0, 12.8, 13.5, 14.75, 15.0, 16.0, 17.5, 18.5, 19.0, 20.0, 21.4, 22.4, 23.0, 24.0, 26.0, 28.0, 31.0, 32.0, 35.0)
_BOX_Z = (0.0, 500.0, 1200.0, 2000.0, 3800.0, 4200.0, 5000.0, 6000.0, 9000.0, 7500.0, 4400.0, 1950.0, 1900.0, 1800.0, 1700.0, 2200.0, 1700.0, 5200.0, 1600.0, 1400.0, 3600.0, 5200.0, 1000.0, 800.0, 1800.0, 800.0, 600.0, 400.0, 350.0, 2400.0, 400.0, 350.0, 300.0, 250.0, 200.0, 100.0, 50.0)
_BOXES = " OR ".join(f"(t >= {a} AND t <= {b} AND z >= {z})" for a, b, z in zip(_BOX_T, _BOX_T[1:], _BOX_Z, strict=False))


def stability_sql(seen: str, carried: str = "") -> str:
    """The check e06 over levels with their neighbours, with columns of these carried along."""
    return f"""
WITH a AS (SELECT uid, lev, i, n, s, t{carried}, CASE WHEN n_p = 0 THEN pr ELSE p END AS q FROM ({seen}) v),
b AS (SELECT *, {_theta("s", "t", "q")} AS th, s IS NOT NULL AND t IS NOT NULL AND q IS NOT NULL AS ok FROM a),
c AS (SELECT uid, lev, i, n, ok, s, th, q{carried}, lag(s) OVER w AS s_p, lag(th) OVER w AS th_p, coalesce(lag(ok) OVER w, FALSE) AS ok_p, coalesce(lag(ok, 2) OVER w, FALSE) AS ok_pp, coalesce(lead(ok) OVER w, FALSE) AS ok_n FROM b WINDOW w AS (PARTITION BY uid ORDER BY i)),
d AS (SELECT *, {_density("s", "th", "q")} - {_density("s_p", "th_p", "q")} AS d FROM c),
e AS (SELECT *, lag(d) OVER w AS d_p, lead(d) OVER w AS d_n FROM d WINDOW w AS (PARTITION BY uid ORDER BY i)),
f AS (SELECT *, i >= 2 AND i <= n - 2 AND ok AND ok_p AND ok_pp AND coalesce(d < -0.03, FALSE) AS bad, coalesce(abs(d_p + d) < 0.25 * abs(d_p - d), FALSE) AS before, coalesce(abs(d + d_n) < 0.25 * abs(d - d_n), FALSE) AS after FROM e),
g AS (SELECT *, bad AND NOT before AND ok_n AS own, bad AND (before OR (ok_n AND NOT after)) AS above FROM f),
h AS (SELECT uid, lev, n{carried}, own OR coalesce(lead(above) OVER (PARTITION BY uid ORDER BY i), FALSE) OR (i = n - 1 AND ok AND ok_p AND coalesce(d < -0.03, FALSE)) AS flag FROM g)
SELECT uid, lev, flag OR sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY uid) >= greatest(2, n / 4.0) AS flag{carried} FROM h"""


#: Checks that take several steps.
STEPS = {
    "r04_depth_increasing": f"""
WITH a AS (SELECT uid, lev, z, i, max(z) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {_LEVELS_ALL} x),
b AS (SELECT uid, lev, z, i, CASE WHEN z IS NOT NULL AND (top IS NULL OR z > top) THEN 1 ELSE 0 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b)
SELECT uid, lev, coalesce(z IS NOT NULL AND ((new = 0) OR min(z) OVER (PARTITION BY uid, g) < z), FALSE) AS flag FROM c""",
    "s03_long_gradient": f"""
WITH a AS (SELECT uid, lev, i, z, t, lead(z) OVER (PARTITION BY uid ORDER BY i) AS z_n, lead(t) OVER (PARTITION BY uid ORDER BY i) AS t_n FROM {_LEVELS_ALL} x),
b AS (SELECT uid, lev, i, z, t, CASE WHEN z >= 5 AND z_n IS NOT NULL AND t_n > t THEN 1 WHEN z >= 5 AND z_n IS NOT NULL AND t_n < t THEN -1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, max(CASE WHEN turn <> 0 THEN i * 4 + turn + 1 END) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 4 - 1 AS prior FROM b),
d AS (SELECT *, max(CASE WHEN turn = 1 AND coalesce(prior, 0) <> 1 THEN i END) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM c),
f AS (SELECT e.uid, s.lev FROM d e JOIN d s ON s.uid = e.uid AND s.i = e.start WHERE e.turn = -1 AND e.prior = 1 AND e.t <> s.t AND abs((e.z - s.z) / nullif(e.t - s.t, 0)) < 4)
SELECT l.uid, l.lev, f.uid IS NOT NULL AS flag FROM {{levels}} l LEFT JOIN f ON l.uid = f.uid AND l.lev = f.lev""",
    "s05_surface_spikes": f"""
WITH a AS (SELECT x.uid, x.lev, x.i, x.n, x.z, p.probe, coalesce(lead(x.z) OVER (PARTITION BY x.uid ORDER BY x.i), 0) AS z_n,
  max(CASE WHEN x.z >= 4 OR (x.z IS NOT NULL AND x.i = x.n - 1) THEN 1 ELSE 0 END) OVER (PARTITION BY x.uid ORDER BY x.i) AS over FROM {_LEVELS_ALL} x LEFT JOIN {{profiles}} p ON x.uid = p.uid)
SELECT uid, lev, coalesce(probe = 2 AND over = 0 AND z IS NOT NULL AND z_n < 8, FALSE) AS flag FROM a""",
    "s06_wire_break": f"""
WITH a AS (SELECT uid, lev, probe, i, max(CASE WHEN {_GOOD} THEN i END) OVER (PARTITION BY uid) AS last FROM ({neighbours()}) v)
SELECT uid, lev, coalesce(probe = 2 AND i > last, FALSE) AS flag FROM a""",
    "e02_constant_value": """
WITH a AS (SELECT uid, t, count(*) AS c, max_by(z, lev) FILTER (WHERE z IS NOT NULL) - min_by(z, lev) FILTER (WHERE z IS NOT NULL) AS span FROM {levels} WHERE t IS NOT NULL GROUP BY uid, t),
b AS (SELECT a.uid FROM a JOIN (SELECT uid, count(*) AS n FROM {levels} GROUP BY uid) m ON a.uid = m.uid WHERE a.c >= 0.9 * m.n AND a.span >= 100 GROUP BY a.uid)
SELECT l.uid, l.lev, b.uid IS NOT NULL AS flag FROM {levels} l LEFT JOIN b ON l.uid = b.uid""",
    "e06_stability": stability_sql(neighbours()),
    "t09_smooth_residual": f"""
WITH a AS (SELECT uid, lev, i, t, CASE WHEN t_p2 IS NOT NULL AND t_p1 IS NOT NULL AND t IS NOT NULL AND t_n1 IS NOT NULL AND t_n2 IS NOT NULL THEN {_M5} END AS u FROM ({neighbours()}) v),
b AS (SELECT *, lag(u) OVER w AS u_p, lead(u) OVER w AS u_n FROM a WINDOW w AS (PARTITION BY uid ORDER BY i)),
c AS (SELECT uid, lev, i, t, CASE WHEN u_p IS NOT NULL AND u IS NOT NULL AND u_n IS NOT NULL THEN {median3("u_p", "u", "u_n")} END AS v FROM b),
d AS (SELECT *, (lag(v) OVER w + 2 * v + lead(v) OVER w) / 4 AS x FROM c WINDOW w AS (PARTITION BY uid ORDER BY i))
SELECT uid, lev, coalesce(abs(t - x) > 6, FALSE) AS flag FROM d""",
    "t10_scaled_residual": f"""
WITH a AS (SELECT uid, lev, i, t, CASE WHEN t_p2 IS NOT NULL AND t_p1 IS NOT NULL AND t IS NOT NULL AND t_n1 IS NOT NULL AND t_n2 IS NOT NULL THEN {_M5} END AS u FROM ({neighbours()}) v),
b AS (SELECT *, lag(u) OVER w AS u_p, lead(u) OVER w AS u_n FROM a WINDOW w AS (PARTITION BY uid ORDER BY i)),
c AS (SELECT uid, lev, i, t, CASE WHEN u_p IS NOT NULL AND u IS NOT NULL AND u_n IS NOT NULL THEN {median3("u_p", "u", "u_n")} END AS v FROM b),
d AS (SELECT *, (lag(v) OVER w + 2 * v + lead(v) OVER w) / 4 AS x, stddev_pop(t) OVER (PARTITION BY uid) AS sd FROM c WINDOW w AS (PARTITION BY uid ORDER BY i))
SELECT uid, lev, coalesce(sd > 0 AND abs(t - x) / nullif(sd, 0) > 0.35, FALSE) AS flag FROM d""",
    "i02_crude_range": _BACK.format(f"SELECT uid, lev, t < -2.3 OR t > 33 OR (z <= 9000 AND ({_BOXES})) AS flag FROM {_ORDERED} o"),
    "i06_many_extrema": _BACK.format(
        f"""WITH o AS (SELECT * FROM {_ORDERED} y), k AS (SELECT uid, t, lag(t) OVER (PARTITION BY uid ORDER BY j) AS a, lead(t) OVER (PARTITION BY uid ORDER BY j) AS b FROM o WHERE m > 6 AND t > -2.3 AND t <= 33),
c AS (SELECT uid FROM k GROUP BY uid HAVING count(*) >= 6 AND sum(CASE WHEN (t - a > 0.5 AND t - b > 0.5) OR (a - t > 0.5 AND b - t > 0.5) THEN 1 ELSE 0 END) > 4)
SELECT o.uid, o.lev, TRUE AS flag FROM o JOIN c ON o.uid = c.uid"""
    ),
    "i07_spike": _BACK.format(
        f"""SELECT uid, lev, coalesce(abs(t - (a + b) / 2) - abs((b - a) / 2) > CASE WHEN z > 2000 THEN 2 WHEN z > 1000 THEN 3 ELSE 4 END, FALSE) AS flag
FROM (SELECT uid, lev, z, t, lag(t) OVER (PARTITION BY uid ORDER BY j) AS a, lead(t) OVER (PARTITION BY uid ORDER BY j) AS b FROM {_ORDERED} o WHERE t > -2.3 AND t < 33) k"""
    ),
    "i08_gradient": _BACK.format(
        f"""WITH k AS (SELECT uid, lev, j, z, t, lead(t) OVER (PARTITION BY uid ORDER BY j) AS t_n, lead(z) OVER (PARTITION BY uid ORDER BY j) AS z_n FROM {_ORDERED} o),
g AS (SELECT uid, lev, j, coalesce(z_n > z AND t > -2.3 AND t < 33 AND t_n > -2.3 AND t_n < 33 AND ((t_n - t) / nullif(z_n - z, 0) < greatest(-150 / greatest((z + z_n) / 2, 1) - 0.01, -4) OR (t_n - t) / nullif(z_n - z, 0) > least(100 / greatest((z + z_n) / 2, 1) + 0.015, 1.5)), FALSE) AS bad FROM k)
SELECT uid, lev, bad OR coalesce(lag(bad) OVER (PARTITION BY uid ORDER BY j), FALSE) AS flag FROM g"""
    ),
}

#: What Spark runs instead of a check's steps: s03 with no join of levels, as at most one turn back follows a start before the next.
IN_ONE_PASS = {
    "s03_long_gradient": """
WITH a AS (SELECT uid, lev, z, t, lead(z) OVER w AS z_n, lead(t) OVER w AS t_n FROM {levels} WINDOW w AS (PARTITION BY uid ORDER BY lev)),
b AS (SELECT uid, lev, z, t, CASE WHEN z >= 5 AND z_n IS NOT NULL AND t_n > t THEN 1 WHEN z >= 5 AND z_n IS NOT NULL AND t_n < t THEN -1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, last_value(nullif(turn, 0)) IGNORE NULLS OVER (PARTITION BY uid ORDER BY lev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM b),
d AS (SELECT *, turn = 1 AND coalesce(prior, 0) <> 1 AS first FROM c),
e AS (SELECT *, last_value(CASE WHEN first THEN struct(lev, z, t) END) IGNORE NULLS OVER (PARTITION BY uid ORDER BY lev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM d),
f AS (SELECT uid, lev, first, s.lev AS start, coalesce(turn = -1 AND prior = 1 AND t <> s.t AND abs((z - s.z) / nullif(t - s.t, 0)) < 4, FALSE) AS hit FROM e)
SELECT uid, lev, coalesce(first AND max(hit) OVER (PARTITION BY uid, start), FALSE) AS flag FROM f""",
}

#: Checks of the header, which flag all levels.
HEADER = {
    "r06_impossible_date": "(year < 1700 OR coalesce(month < 1 OR month > 12, TRUE) OR coalesce(day < 1 OR day > CASE WHEN month IN (4, 6, 9, 11) THEN 30 WHEN month = 2 THEN CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END, TRUE) OR coalesce(time < 0 OR time >= 24, FALSE))",
    "r07_impossible_location": "(coalesce(lat < -90 OR lat > 90, FALSE) OR coalesce(lon < -180 OR lon > 180, FALSE))",
}


@dataclass(frozen=True)
class Dialect:
    bround: str
    #: What the levels of a profile are ordered by; Spark does not know that ``i`` numbers them by ``lev`` and would sort them again.
    place: str


SPARK, DUCK = Dialect("bround", "lev"), Dialect("round_even", "i")


def check_sql(name: str, dialect: Dialect) -> str:
    """A check as a query with ``{levels}`` and ``{profiles}`` in it."""
    if name in LOCAL:
        return f"SELECT uid, lev, coalesce({LOCAL[name].replace('{bround}', dialect.bround)}, FALSE) AS flag FROM ({neighbours()}) v"
    if name in HEADER:
        return f"SELECT l.uid, l.lev, coalesce(p.uid IS NOT NULL AND {HEADER[name]}, FALSE) AS flag FROM {{levels}} l LEFT JOIN {{profiles}} p ON l.uid = p.uid"
    return STEPS[name].replace("ORDER BY i", f"ORDER BY {dialect.place}").replace("ORDER BY x.i", f"ORDER BY x.{dialect.place}")


NAMES = (*LOCAL, *STEPS, *HEADER)


def run(name: str, levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, flag`` of one check."""
    if name == "e02_constant_value":
        return _if_constant(levels.select("uid", "lev", F.lit(False).alias("flag")), levels)
    sql = IN_ONE_PASS.get(name) or check_sql(name, SPARK)
    return levels.sparkSession.sql(sql, **{k: v for k, v in (("levels", levels), ("profiles", merged_headers(profiles))) if f"{{{k}}}" in sql})


def run_local(levels: DataFrame, profiles: DataFrame, names: tuple[str, ...] = tuple(LOCAL), carried: tuple[str, ...] = (), headers: tuple[str, ...] = ()) -> DataFrame:
    """``uid, lev``, carried columns of the levels and headers (probe, lat, lon, country), and a flag column per named
    neighbour check: one exchange and one sort for all of them."""
    seen = levels.sparkSession.sql(neighbours(*carried), levels=levels, profiles=merged_headers(profiles))
    return seen.select("uid", "lev", *carried, *headers, *(F.expr(f"coalesce({LOCAL[n].replace('{bround}', SPARK.bround)}, FALSE)").alias(n) for n in names))


def constant_profiles(levels: DataFrame) -> DataFrame:
    """``uid`` of the profiles that e02 flags, from one pass: only a profile's most frequent temperature can make 90 % of its levels."""
    return levels.sparkSession.sql(
        """
SELECT uid FROM (SELECT uid, sum(c) AS n, max(c) FILTER (WHERE t IS NOT NULL) AS c, max_by(span, c) FILTER (WHERE t IS NOT NULL) AS span FROM
 (SELECT uid, t, count(*) AS c, max_by(z, lev) FILTER (WHERE z IS NOT NULL) - min_by(z, lev) FILTER (WHERE z IS NOT NULL) AS span FROM {levels} GROUP BY uid, t) GROUP BY uid)
WHERE c >= 0.9 * n AND span >= 100""",
        levels=levels,
    )


def _if_constant(flags: DataFrame, levels: DataFrame) -> DataFrame:
    """Flags with those of e02 added."""
    found = constant_profiles(levels).withColumn("_constant", F.lit(True))
    return flags.join(found.hint("merge"), "uid", "left").select("uid", "lev", (F.col("flag") | F.col("_constant").isNotNull()).alias("flag"))


def run_any(names: Sequence[str], levels: DataFrame, profiles: DataFrame) -> DataFrame:
    """``uid, lev, flag``: whether any of the named checks flags a level.

    Neighbour checks and e06 share one pass over the levels, e02 adds its profiles; other checks are united with these.
    """
    near, own = [n for n in names if n in LOCAL], "e06_stability" in names
    others = [n for n in names if n not in (*near, "e06_stability", "e02_constant_value")]
    parts = [run(n, levels, profiles) for n in others]
    if near or own:
        hit = " OR ".join([f"coalesce({LOCAL[n].replace('{bround}', SPARK.bround)}, FALSE)" for n in near] or ["FALSE"])
        seen = f"SELECT *, {hit} AS hit FROM ({neighbours()}) v0"
        sql = stability_sql(seen, ", hit").replace("ORDER BY i", f"ORDER BY {SPARK.place}") if own else f"SELECT uid, lev, FALSE AS flag, hit FROM ({seen}) v"
        flags = levels.sparkSession.sql(sql, levels=levels, profiles=merged_headers(profiles)).select("uid", "lev", (F.col("flag") | F.col("hit")).alias("flag"))
        parts.append(_if_constant(flags, levels) if "e02_constant_value" in names else flags)
    elif "e02_constant_value" in names:
        parts.append(run("e02_constant_value", levels, profiles))
    return parts[0] if len(parts) == 1 else any_flag(parts)
