"""Registered queries of the profile operators over views of the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage, schema
from .plans import registry
from .sources import ingest, store
from .operators import buddy, gridded, local, rates, rules, selection, sequential, track

_VIEWS = f"WITH levels AS ({schema.LEVELS_SQL}), profiles AS ({schema.PROFILES_SQL}), tracks AS ({schema.TRACKS_SQL})"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def duck(sql: str) -> str:
    """A query over ``{levels}`` and ``{profiles}`` as DuckDB SQL over the driver's tables."""
    return f"{_VIEWS} SELECT * FROM ({sql.replace('{levels}', 'levels').replace('{profiles}', 'profiles').replace('{tracks}', 'tracks')}) q"


def _check(name: str) -> None:
    _QUERIES[f"check_{name}"] = lambda s, d: local.run(name, schema.levels(s, d), schema.profiles(s, d))
    _ORACLES[f"check_{name}"] = duck(local.check_sql(name, local.DUCK))


for _name in local.NAMES:
    _check(_name)


#: Checks of the decision table.
CHECKS = ("a01_gross_range", "a03_gradient", "a04_spike", "e01_range", "o03_gradient", "r02_gradient", "s04_short_gradient", "t07_rate_of_change")


def flagged_levels(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = CHECKS) -> DataFrame:
    """Levels with their truth, probe and a column per check, from one pass over the neighbour windows."""
    return local.run_local(schema.levels(spark, sf_dir), schema.profiles(spark, sf_dir), names, ("truth",), ("probe",))


def _decisions(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = CHECKS) -> DataFrame:
    return rules.decisions(flagged_levels(spark, sf_dir, names), list(names))


_FLAGGED = "SELECT v.uid, v.lev, v.truth, v.probe, " + ", ".join(f"coalesce({local.LOCAL[n].replace('{bround}', local.DUCK.bround)}, FALSE) AS {n}" for n in CHECKS) + f" FROM ({local.neighbours('truth')}) v"
_DECIDED = "SELECT uid, coalesce(bool_or(truth IN (3, 4)), FALSE) AS truth, " + ", ".join(f"bool_or({n}) AS {n}" for n in CHECKS) + f" FROM ({_FLAGGED}) f GROUP BY uid"


def _rate_sql(names: tuple[str, ...]) -> str:
    one = "SELECT '{0}' AS \"check\", sum({0}::INT)::BIGINT AS fails, round(100.0 * count_if({0} AND truth) / nullif(count_if(truth), 0), 6) AS tpr, round(100.0 * count_if({0} AND NOT truth) / nullif(count_if(NOT truth), 0), 6) AS fpr, round(100.0 * count_if(NOT {0} AND NOT truth) / nullif(count_if(NOT truth), 0), 6) AS tnr, round(100.0 * count_if(NOT {0} AND truth) / nullif(count_if(truth), 0), 6) AS fnr FROM d"
    return f"WITH d AS ({_DECIDED}) " + " UNION ALL ".join(one.format(n) for n in names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails and rates of every check of the decision table and of the truth itself."""
    return _rounded(rates.rates(_decisions(spark, sf_dir), list(CHECKS), include_truth=True))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema))


def _add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql:
        _ORACLES[name] = duck(sql)


_add("summary_rates", flagship, _rate_sql(("truth", *CHECKS)))
_add("decisions", _decisions, _DECIDED)
_add("checks_in_one_pass", lambda s, d: flagged_levels(s, d).drop("truth", "probe"), f"SELECT * EXCLUDE (truth, probe) FROM ({_FLAGGED}) f")


def _rule_query(rule: str, pad: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flags = local.run("e01_range", schema.levels(spark, sf_dir), schema.profiles(spark, sf_dir))
        hit = flags.withColumn("gone", rules.removal(rule, F.col("flag"), F.col("lev")))
        if pad:
            from pyspark.sql import Window

            hit = hit.withColumn("gone", F.max("gone").over(Window.partitionBy("uid").orderBy("lev").rowsBetween(-pad, pad)))
        return hit.select("uid", "lev", F.col("gone").alias("removed"))

    return run


_RULE_SQL = {
    "above": "coalesce(lev <= max(CASE WHEN flag THEN lev END) OVER (PARTITION BY uid), FALSE)",
    "below": "coalesce(lev >= min(CASE WHEN flag THEN lev END) OVER (PARTITION BY uid), FALSE)",
    "profile": "bool_or(flag) OVER (PARTITION BY uid)",
    "levels": "flag",
}
for _rule, _text in _RULE_SQL.items():
    for _pad in (0, 2):
        _inner = f"SELECT uid, lev, {_text} AS gone FROM ({local.check_sql('e01_range', local.DUCK)}) c"
        _out = "gone" if not _pad else f"max(gone::INT) OVER (PARTITION BY uid ORDER BY lev ROWS BETWEEN {_pad} PRECEDING AND {_pad} FOLLOWING) = 1"
        _add(f"rule_{_rule}" + f"_pad{_pad}" * bool(_pad), _rule_query(_rule, _pad), f"SELECT uid, lev, {_out} AS removed FROM ({_inner}) g")


def _rules_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(flagged_levels(spark, sf_dir), [("o03_gradient", "below"), ("a04_spike", "levels")], xbt_below=True)
    return out.select("uid", "lev", "truth")


_add(
    "rules_in_turn",
    _rules_in_turn,
    f"""WITH f AS ({_FLAGGED}), a AS (SELECT *, coalesce(lev >= min(CASE WHEN o03_gradient THEN lev END) OVER (PARTITION BY uid), FALSE) AS g FROM f),
b AS (SELECT *, bool_and(g) OVER (PARTITION BY uid) AS dead FROM a), c AS (SELECT * FROM b WHERE NOT g OR dead),
d AS (SELECT *, CASE WHEN probe = 2 THEN coalesce(lev >= min(CASE WHEN a04_spike THEN lev END) OVER (PARTITION BY uid), FALSE) ELSE a04_spike END AS h FROM c),
e AS (SELECT *, bool_and(h) OVER (PARTITION BY uid) AS all_h FROM d) SELECT uid, lev, truth FROM e WHERE NOT h AND NOT dead AND NOT all_h""",
)
_COUNT = f"SELECT uid, coalesce(min(CASE WHEN flag THEN lev END), count(*))::BIGINT AS before_first, -coalesce(count(*) - 1 - max(CASE WHEN flag THEN lev END), count(*))::BIGINT AS after_last FROM ({local.check_sql('e01_range', local.DUCK)}) c GROUP BY uid"
_add(
    "levels_around_flags",
    lambda s, d: local.run("e01_range", schema.levels(s, d), schema.profiles(s, d)).groupBy("uid").agg(rules.levels_before_first_flag().alias("before_first"), rules.levels_after_last_flag().alias("after_last")),
    _COUNT,
)
_MASK = " + ".join(f"CASE WHEN {n} THEN {1 << k} ELSE 0 END" for k, n in enumerate(CHECKS))
_PATTERNS = f"SELECT truth, ({_MASK})::BIGINT AS mask, count(*) AS n FROM ({_DECIDED}) d GROUP BY ALL"
_add("patterns", lambda s, d: selection.patterns(_decisions(s, d), CHECKS), _PATTERNS)
_add(
    "subset_rates",
    lambda s, d: _rounded(selection.subset_rates(selection.patterns(_decisions(s, d), CHECKS), len(CHECKS))),
    f"""WITH p AS ({_PATTERNS}), m AS (SELECT range AS subset FROM range(1, {1 << len(CHECKS)}))
SELECT subset, bit_count(subset)::INT AS size, round(100.0 * sum(CASE WHEN truth AND (mask & subset) = subset THEN n ELSE 0 END) / nullif(sum(CASE WHEN truth THEN n ELSE 0 END), 0), 6) AS tpr,
round(100.0 * sum(CASE WHEN NOT truth AND (mask & subset) = subset THEN n ELSE 0 END) / nullif(sum(CASE WHEN NOT truth THEN n ELSE 0 END), 0), 6) AS fpr FROM p CROSS JOIN m GROUP BY subset""",
)
#: Checks whose sets are rated all.
MANY = tuple(n for n in local.NAMES if n in local.LOCAL)[:14]
_MANY = "SELECT uid, coalesce(bool_or(truth IN (3, 4)), FALSE) AS truth, " + " + ".join(f"CASE WHEN bool_or({n}) THEN {1 << k} ELSE 0 END" for k, n in enumerate(MANY)) + " AS mask FROM (SELECT v.uid, v.truth, " + ", ".join(f"coalesce({local.LOCAL[n].replace('{bround}', local.DUCK.bround)}, FALSE) AS {n}" for n in MANY) + f" FROM ({local.neighbours('truth')}) v) f GROUP BY uid"
_add(
    "subset_rates_of_many_checks",
    lambda s, d: _rounded(selection.subset_rates(selection.patterns(_decisions(s, d, MANY), MANY), len(MANY))),
    f"""WITH p AS MATERIALIZED (SELECT truth, mask, count(*) AS n FROM ({_MANY}) d GROUP BY ALL), m AS (SELECT range AS subset FROM range(1, {1 << len(MANY)}))
SELECT subset, bit_count(subset)::INT AS size, round(100.0 * sum(CASE WHEN truth AND (mask & subset) = subset THEN n ELSE 0 END) / nullif(sum(CASE WHEN truth THEN n ELSE 0 END), 0), 6) AS tpr,
round(100.0 * sum(CASE WHEN NOT truth AND (mask & subset) = subset THEN n ELSE 0 END) / nullif(sum(CASE WHEN NOT truth THEN n ELSE 0 END), 0), 6) AS fpr FROM p CROSS JOIN m GROUP BY subset""",
)
_PARTED = f"""g AS (SELECT 1 AS i, [1::BIGINT] AS groups UNION ALL SELECT i + 1, CASE WHEN k.k <= len(groups) THEN list_transform(groups, lambda x, j: CASE WHEN j = k.k THEN x + (1 << i) ELSE x END) ELSE list_append(groups, (1 << i)::BIGINT) END
FROM g JOIN range(1, {len(CHECKS) + 1}) AS k(k) ON k.k <= len(groups) + 1 WHERE i < {len(CHECKS)})"""
_add(
    "partition_rates",
    lambda s, d: _rounded(selection.partition_rates(selection.patterns(_decisions(s, d), CHECKS), len(CHECKS))),
    f"""WITH RECURSIVE p AS MATERIALIZED ({_PATTERNS}), {_PARTED}, h AS (SELECT groups, truth, n, len(list_filter(groups, lambda x: (mask & x) = x)) > 0 AS hit FROM g CROSS JOIN p WHERE i = {len(CHECKS)})
SELECT array_to_string(list_transform(groups, lambda x: array_to_string(list_filter(range({len(CHECKS)}), lambda k: (x >> k) & 1 = 1), '&')), '|') AS "partition", len(groups)::INT AS groups,
round(100.0 * sum(CASE WHEN truth AND hit THEN n ELSE 0 END) / nullif(sum(CASE WHEN truth THEN n ELSE 0 END), 0), 6) AS tpr, round(100.0 * sum(CASE WHEN NOT truth AND hit THEN n ELSE 0 END) / nullif(sum(CASE WHEN NOT truth THEN n ELSE 0 END), 0), 6) AS fpr FROM h GROUP BY groups""",
)
_add("effective_checks", lambda s, d: _rounded(rates.effective(rates.rates(_decisions(s, d), list(CHECKS)), 0.8)), f"SELECT * FROM ({_rate_sql(CHECKS)}) r WHERE tpr > 0 AND (fpr <= 0 OR tpr >= 0.8 * fpr)")
_add(
    "best_checks",
    lambda s, d: _rounded(rates.best(rates.rates(_decisions(s, d), list(CHECKS)))),
    f"""WITH r AS ({_rate_sql(CHECKS)}) SELECT * FROM (SELECT 'lowest_fpr' AS criterion, "check", tpr, fpr FROM r WHERE tpr > 0 ORDER BY fpr, "check" LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'highest_tpr', "check", tpr, fpr FROM r WHERE fpr < 100 ORDER BY tpr DESC, "check" LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'nearest', "check", tpr, fpr FROM r ORDER BY fpr * fpr + (100 - tpr) * (100 - tpr), "check" LIMIT 1)""",
)


def _grown(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    table = selection.patterns(_decisions(spark, sf_dir), CHECKS).cache()
    points = selection.grow_roc(table, selection.pairings(table, CHECKS), **how)
    return spark.createDataFrame([(p["pos"], p["check"], round(p["tpr"], 6), round(p["fpr"], 6), p["enforced"]) for p in points], "pos int, check string, tpr double, fpr double, enforced boolean")


_GROUPS = {"range": ["a01_gross_range", "e01_range"], "gradient": ["a03_gradient", "o03_gradient", "r02_gradient"]}
_add("grow_roc", lambda s, d: _grown(s, d, ratio=(0.6, 0.4)))
_add("grow_roc_groups", lambda s, d: _grown(s, d, groups=_GROUPS))
_add("grow_roc_ordered", lambda s, d: _grown(s, d, groups=_GROUPS, ordered=True, gain=0.1))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.cover(selection.patterns(_decisions(spark, sf_dir), CHECKS).cache(), CHECKS, least=0.5)
    return spark.createDataFrame([(k, n, found["missed"]) for k, n in enumerate(found["tests"])], "pos int, check string, missed long")


_add("cover", _covered)


_RATIO = (0.9, 0.5)


def _grown_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = selection.grow_by_levels(flagged_levels(spark, sf_dir), CHECKS, ratio=_RATIO, most=2)
    return spark.createDataFrame([(p["pos"], p["check"], round(p["tpr"], 6), round(p["fpr"], 6)) for p in points], "pos int, check string, tpr double, fpr double")


def _choice_sql(levels: str, pos: int, without: str = "") -> str:
    """SQL of one round: rates of the checks on the levels that are left, and the cheapest of them."""
    parts = " + ".join(f"{w} * ((100 - tpr) * cos(atan({r})) + fpr * sin(atan({r})))" for w, r in zip(("(100 - tpr) / 100", "tpr / 100"), _RATIO, strict=True))
    anew = " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS c, truth, bool_or({n}) AS hit FROM b GROUP BY uid, truth" for k, n in enumerate(CHECKS))
    rated = f"SELECT k, c, 100.0 * count_if(hit AND truth) / greatest(count_if(truth), 1) AS tpr, 100.0 * count_if(hit AND NOT truth) / greatest(count_if(NOT truth), 1) AS fpr FROM ({anew}) r GROUP BY k, c"
    return f"""SELECT {pos} AS pos, c AS "check", tpr, fpr FROM (WITH b AS (SELECT *, bool_or(coalesce(truth IN (3, 4), FALSE)) OVER (PARTITION BY uid) AS bad FROM ({levels}) l0), x AS (SELECT * REPLACE (bad AS truth) FROM b)
SELECT k, c, tpr, fpr, {parts} AS cost FROM ({rated.replace("FROM b", "FROM x").replace("(" + anew, "(" + anew.replace("FROM b", "FROM x"))}) y) z
WHERE NOT (tpr = 0 AND fpr = 0) AND NOT (tpr = 100 AND fpr = 100) AND cost <= 100 * cos(atan({_RATIO[0]})) {without} ORDER BY cost, k LIMIT 1"""


_LEFT = f"""SELECT * FROM (SELECT *, bool_and(gone) OVER (PARTITION BY uid) AS lost FROM (SELECT *, max(hit::INT) OVER (PARTITION BY uid ORDER BY lev ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS gone FROM
(SELECT *, CASE WHEN probe = 2 THEN coalesce(lev >= min(CASE WHEN own THEN lev END) OVER (PARTITION BY uid), FALSE) ELSE own END AS hit FROM (SELECT f.*, CASE one."check" {" ".join(f"WHEN '{n}' THEN {n}" for n in CHECKS)} END AS own FROM f CROSS JOIN one) l1) l2) l3) l4 WHERE NOT gone AND NOT lost"""
_add(
    "grow_by_levels",
    _grown_by_levels,
    f"""WITH f AS MATERIALIZED ({_FLAGGED}), one AS MATERIALIZED ({_choice_sql("SELECT * FROM f", 0)}), two AS ({_choice_sql(_LEFT, 1, 'AND c <> (SELECT "check" FROM one)')})
SELECT pos, "check", round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT * FROM one UNION ALL SELECT * FROM two) a""",
)


_TOLERANCE = "5.0 * CASE WHEN {0} > 600 THEN 0.3 WHEN {0} > 500 THEN 0.4 WHEN {0} > b + 100 THEN 0.5 WHEN {0} > b THEN 1.0 - 0.005 * ({0} - b) ELSE 1.0 END"
#: The state machine of spikes and steps as a recursive query, a level of every profile at a time. ``a`` is the step before the
#: level above, ``g`` the step to the level itself; a step of a spike that was found is NULL from then on.
_SPIKES = f"""WITH RECURSIVE v AS (SELECT l.uid, l.lev, l.z, l.t, p.lat, CASE WHEN abs(p.lat) < 20 THEN 300.0 ELSE 200.0 END AS b, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l.uid) AS n,
lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2 FROM {{levels}} l LEFT JOIN {{profiles}} p ON p.uid = l.uid WINDOW w AS (PARTITION BY l.uid ORDER BY l.lev)),
k AS (SELECT *, CASE WHEN z - z1 <= 50 OR (z >= 350 AND z - z1 <= 100) THEN t - t1 END AS step, CASE WHEN z - z1 <= 50 OR (z >= 350 AND z - z1 <= 100) THEN (t - t1) / greatest(10.0, z - z1) END AS slope,
z IS NOT NULL AND t IS NOT NULL AND z1 IS NOT NULL AND t1 IS NOT NULL AND (i < 2 OR (z2 IS NOT NULL AND t2 IS NOT NULL)) AS held, CASE WHEN i >= 2 AND z - z2 >= 5 THEN (z1 - z2) / (z - z2) ELSE 0.5 END AS wt, {_TOLERANCE.format('z1')} AS most FROM v),
x AS (SELECT *, lag(slope) OVER (PARTITION BY uid ORDER BY i) AS slope1 FROM k),
m AS (SELECT uid, 0::BIGINT AS i, NULL::DOUBLE AS g, FALSE AS reject1, FALSE AS suspect1, FALSE AS suspect2 FROM x WHERE i = 0 UNION ALL
SELECT uid, i, CASE WHEN NOT held THEN step WHEN cold OR large OR small THEN NULL ELSE step END, held AND NOT cold AND ((large AND spike) OR small),
  held AND (cold OR (stepped AND i > 1)), held AND NOT cold AND stepped AND i > 1 FROM
 (SELECT *, coalesce(NOT cold AND NOT large AND NOT small AND abs(a) > most AND NOT coalesce(z1 <= 250 AND a > -3 * most AND a < -most, FALSE)
   AND NOT coalesce(i > 1 AND z - z2 > 0 AND abs(t1 - ((z1 - z2) / nullif(z - z2, 0) * (t - t2) + t2)) < 0.5 * most, FALSE), FALSE) AS stepped FROM
  (SELECT *, coalesce(NOT cold AND NOT large AND greatest(abs(a), abs(step)) > 0.5 * most AND a IS NOT NULL AND step IS NOT NULL AND slope IS NOT NULL AND slope1 IS NOT NULL AND greatest(abs(slope), abs(slope1)) > 0.05 AND abs(a + step) < 0.25 * abs(step - a), FALSE) AS small FROM
   (SELECT *, coalesce(NOT cold AND a IS NOT NULL AND step IS NOT NULL AND greatest(abs(a), abs(step)) > most AND (spike OR abs((1 - wt) * a - wt * step) < 0.5 * most), FALSE) AS large FROM
    (SELECT x.*, m.g AS a, coalesce(abs(x.lat) < 20 AND x.z1 < 1000 AND x.t1 < 1, FALSE) AS cold, coalesce(abs(m.g + x.step) < 0.5 * x.most, FALSE) AS spike FROM m JOIN x ON x.uid = m.uid AND x.i = m.i + 1) q1) q2) q3) q4),
f AS (SELECT x.uid, x.lev, x.n, coalesce(lead(m.reject1) OVER w, FALSE) AS reject, coalesce(lead(m.suspect1) OVER w, FALSE) OR coalesce(lead(m.suspect2, 2) OVER w, FALSE)
  OR (x.i = x.n - 1 AND (coalesce(x.z IS NOT NULL AND x.t IS NOT NULL AND abs(m.g) > {_TOLERANCE.format('x.z')}, FALSE) OR coalesce(x.t = 0, FALSE))) AS suspect FROM x JOIN m ON m.uid = x.uid AND m.i = x.i WINDOW w AS (PARTITION BY x.uid ORDER BY x.i)),
c AS (SELECT uid, count_if(reject) AS c FROM f GROUP BY uid)
SELECT f.uid, f.lev, f.reject OR c.c >= 4 OR c.c > f.n / 2.0 AS reject, f.suspect FROM f JOIN c ON c.uid = f.uid"""
_add("check_e03_e04_spike_and_step", lambda s, d: sequential.spike_and_step(schema.levels(s, d), schema.profiles(s, d)), _SPIKES)
#: Depths out of order: of each profile the list of levels that are gone grows by a level, or a lone pair, a step.
_DISORDER = f"""WITH RECURSIVE sp AS MATERIALIZED (SELECT uid, lev, reject FROM ({_SPIKES}) e03), v AS MATERIALIZED (SELECT l.uid, l.lev, l.z, row_number() OVER (PARTITION BY l.uid ORDER BY l.lev) AS i, sp.reject FROM {{levels}} l JOIN sp ON sp.uid = l.uid AND sp.lev = l.lev),
flat AS (SELECT uid FROM v GROUP BY uid HAVING count(*) > 1 AND min(coalesce(z, 0)) = max(coalesce(z, 0))),
ok AS MATERIALIZED (SELECT * FROM v WHERE z >= 0 AND z <= 11000 AND uid NOT IN (SELECT uid FROM flat)),
pair AS MATERIALIZED (SELECT a.uid, a.i AS x, b.i AS y, a.reject AS sx, b.reject AS sy FROM ok a JOIN ok b ON a.uid = b.uid AND ((a.i < b.i AND a.z >= b.z) OR (a.i > b.i AND a.z <= b.z))),
w AS (SELECT DISTINCT uid, []::BIGINT[] AS gone FROM pair UNION ALL
SELECT uid, list_concat(gone, CASE WHEN m.c > 1 THEN [m.x] WHEN m.sx AND m.sy THEN [m.x, m.y] WHEN m.sx THEN [m.x] WHEN m.sy THEN [m.y] ELSE [m.x, m.y] END) FROM (
 SELECT uid, gone, max(struct_pack(c := c, x := x, y := y, sx := sx, sy := sy)) AS m FROM (
  SELECT w.uid, w.gone, p.x, count(*) AS c, max(p.y) AS y, bool_or(p.sx) AS sx, bool_or(p.sy) AS sy FROM w JOIN pair p ON p.uid = w.uid WHERE NOT list_contains(w.gone, p.x) AND NOT list_contains(w.gone, p.y) GROUP BY w.uid, w.gone, p.x) q1 GROUP BY uid, gone) q2),
g AS (SELECT uid, arg_max(gone, len(gone)) AS gone FROM w GROUP BY uid)
SELECT v.uid, v.lev, coalesce(v.z < 0 OR v.z > 11000, FALSE) OR v.uid IN (SELECT uid FROM flat) OR coalesce(list_contains(g.gone, v.i), FALSE) AS flag FROM v LEFT JOIN g ON g.uid = v.uid"""
_add("check_e05_increasing_depth", lambda s, d: sequential.increasing_depth(schema.levels(s, d), schema.profiles(s, d)), _DISORDER)
_LEAST = "CASE probe WHEN 1 THEN 7 WHEN 2 THEN 20 WHEN 3 THEN 7 WHEN 4 THEN 50 WHEN 5 THEN 7 WHEN 6 THEN 7 WHEN 7 THEN 7 WHEN 9 THEN 20 WHEN 13 THEN 20 WHEN 14 THEN 7 WHEN 16 THEN 7 END"
_add(
    "check_i05_stuck_value",
    lambda s, d: sequential.stuck_value(schema.levels(s, d), schema.profiles(s, d)),
    f"""WITH o AS (SELECT l.uid, l.lev, l.z, l.t, p.least, row_number() OVER (PARTITION BY l.uid ORDER BY l.z, l.lev) - 1 AS j, count(*) OVER (PARTITION BY l.uid) AS m FROM {{levels}} l JOIN (SELECT uid, {_LEAST} AS least FROM {{profiles}}) p ON p.uid = l.uid WHERE l.z >= 0 AND l.t IS NOT NULL AND p.least IS NOT NULL),
r AS (SELECT a.uid, a.j, a.z, a.m, a.least, coalesce(min(b.j) FILTER (abs(b.t - a.t) > 1e-4), a.m) - a.j AS run FROM o a LEFT JOIN o b ON b.uid = a.uid AND b.j > a.j WHERE a.m > a.least GROUP BY a.uid, a.j, a.z, a.m, a.least),
s AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY run DESC, j) AS place FROM (SELECT uid, j, z, least, CASE WHEN j < m - least THEN run ELSE 1 END AS run FROM r) q),
h AS (SELECT s.uid, s.j, s.run FROM s JOIN o ON o.uid = s.uid AND o.j = s.j + s.run - 1 WHERE s.place = 1 AND s.run >= s.least AND o.z - s.z >= 200)
SELECT l.uid, l.lev, h.uid IS NOT NULL AS flag FROM {{levels}} l LEFT JOIN o ON o.uid = l.uid AND o.lev = l.lev LEFT JOIN h ON h.uid = l.uid AND o.j >= h.j AND o.j < h.j + h.run""",
)

_add("check_e10_track", lambda s, d: track.track_check(schema.tracks(s, d)))
_METRES = "2 * 6367000.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(o)) / 2), 2))))"
_add(
    "track_speeds",
    lambda s, d: track.segments(schema.tracks(s, d)).select("uid", F.round("speed", 4).alias("speed")),
    f"SELECT uid, round(CASE WHEN b IS NOT NULL THEN ({_METRES} - 20000) / greatest(floor(epoch(ts)) - floor(epoch(b)), 600) END, 4) AS speed FROM (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o, lag(ts) OVER w AS b FROM {{tracks}} WINDOW w AS (PARTITION BY country, cruise, ocruise ORDER BY ts, uid)) x",
)


# Reference grids by arithmetic; the same text runs in both engines. They meet all levels of the derived views.
BACKGROUND_SQL = """SELECT CAST(floor(c.id / 36) AS INT) AS ilat, CAST(c.id % 36 AS INT) AS ilon, CAST(d.k * 100 AS DOUBLE) AS depth,
  CAST(24 - 2 * d.k + c.id % 3 AS DOUBLE) AS clim, CAST(1 + c.id % 2 AS DOUBLE) AS bgev, CAST(0.5 AS DOUBLE) AS obev
  FROM range(0, 684) AS c(id) CROSS JOIN range(0, 13) AS d(k) WHERE c.id % 7 <> 0 AND d.k <= 5 + c.id % 8"""
RELIEF_SQL = "SELECT CAST(floor(c.id / 36) AS INT) AS ilat, CAST(c.id % 36 AS INT) AS ilon, CAST(CASE WHEN floor(c.id / 36) < 6 THEN 300 ELSE -50 - (c.id * 37) % 1200 END AS DOUBLE) AS height FROM range(0, 684) AS c(id)"
REGIONS_SQL = "SELECT CAST(floor(c.id / 360) AS DOUBLE) - 89.5 AS glat, CAST(c.id % 360 AS DOUBLE) - 179.5 AS glon, CAST(c.id % 5 AS INT) AS region FROM range(0, 64800) AS c(id)"
RANGES_SQL = "SELECT CAST(r.id AS INT) AS region, CAST(d.k * 150 AS DOUBLE) AS depth, CAST(20 - 3 * d.k + r.id AS DOUBLE) AS tmin, CAST(30 - 3 * d.k + r.id AS DOUBLE) AS tmax FROM range(0, 5) AS r(id) CROSS JOIN range(0, 8) AS d(k)"
EDGES = (0.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0)
_BINS = "CASE " + " ".join(f"WHEN z >= {a} AND z < {b} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END"
MONTHLY_SQL = """SELECT DISTINCT CAST(floor((lon + 180) / 0.5) AS INT) AS ix, CAST(floor((90 - lat) / 0.5) AS INT) AS iy, CAST(d.k AS INT) AS k, month,
  CAST(25 - 4 * d.k AS DOUBLE) AS med, CAST(CASE WHEN (month + d.k) % 4 = 0 THEN -1 ELSE 0.5 * d.k END AS DOUBLE) AS amd FROM {profiles} CROSS JOIN range(0, 6) AS d(k) WHERE month BETWEEN 1 AND 12"""
ANNUAL_SQL = """SELECT DISTINCT CAST(floor((lon + 180) / 0.5) AS INT) AS ix, CAST(floor((90 - lat) / 0.5) AS INT) AS iy, CAST(d.k AS INT) AS k,
  CAST(24 - 4 * d.k AS DOUBLE) AS med, CAST(1 + d.k AS DOUBLE) AS amd FROM {profiles} CROSS JOIN range(0, 6) AS d(k)"""
_TENS = ((-90.0, 10.0, 19), (0.0, 10.0, 36))


def _grid(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def _with(fn: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: fn(s, schema.levels(s, d), schema.profiles(s, d))


_CELL = "CAST(CASE WHEN round_even((round(degrees(asin(sin(radians(lat)))), 6) + 90) / 10, 0) = 19 THEN 18 ELSE round_even((round(degrees(asin(sin(radians(lat)))), 6) + 90) / 10, 0) END AS INT) AS ilat, CAST((round_even(lon / 10, 0)::INT % 36 + 36) % 36 AS INT) AS ilon"
_ON_CELL = f"SELECT l.uid, l.lev, l.z, l.t, p.ilat, p.ilon, p.lat, p.lon FROM {{levels}} l JOIN (SELECT uid, lat, lon, {_CELL} FROM {{profiles}}) p ON l.uid = p.uid"
_add("nearest_cells", _with(lambda s, lv, pr: gridded.nearest_cells(pr, *_TENS).select("uid", "ilat", "ilon")), f"SELECT uid, {_CELL} FROM {{profiles}}")
_add(
    "check_e08_background_available",
    _with(lambda s, lv, pr: gridded.background_available(lv, pr, _grid(s, BACKGROUND_SQL))),
    f"SELECT x.uid, x.lev, coalesce(g.deep IS NULL OR (x.t IS NOT NULL AND x.z > g.deep), FALSE) AS flag FROM ({_ON_CELL}) x LEFT JOIN (SELECT ilat, ilon, max(depth) AS deep FROM ({BACKGROUND_SQL}) b GROUP BY ilat, ilon) g ON g.ilat = x.ilat AND g.ilon = x.ilon",
)


def _e07(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    return _rounded(gridded.background(lv, pr, _grid(s, BACKGROUND_SQL), sequential.spike_and_step(lv, pr)))


def interpolated(levels: str, grid: str, keys: tuple[str, ...], fields: tuple[str, ...]) -> str:
    """SQL of the values of a depth column at each level: linear between depths, the first value above, NULL below."""
    on = " AND ".join(f"g.{k} = x.{k}" for k in keys)
    full = " AND ".join(f"{f} IS NOT NULL" for f in ("depth", *fields))
    ends = ", ".join(f"arg_max(g.{f}, g.depth) FILTER (g.depth <= x.z) AS {f}_lo, arg_min(g.{f}, g.depth) FILTER (g.depth >= x.z) AS {f}_hi" for f in fields)
    value = lambda f: f"CASE WHEN hi IS NULL THEN NULL WHEN lo IS NULL THEN {f}_hi WHEN lo = hi THEN {f}_lo ELSE (z - lo) / (hi - lo) * ({f}_hi - {f}_lo) + {f}_lo END AS {f}"
    return f"""SELECT uid, lev, z, t, {", ".join(map(value, fields))} FROM (SELECT x.uid, x.lev, x.z, x.t, max(g.depth) FILTER (g.depth <= x.z) AS lo, min(g.depth) FILTER (g.depth >= x.z) AS hi, {ends}
FROM ({levels}) x LEFT JOIN (SELECT * FROM ({grid}) g0 WHERE {full}) g ON {on} GROUP BY x.uid, x.lev, x.z, x.t) y"""


def _lapse_sql(t: str, ds: str, p: str) -> str:
    cubic, square = f"((-2.1687e-16 * {t} + 1.8676e-14) * {t} - 4.6206e-13)", f"((2.7759e-12 * {t} - 1.1351e-10) * {ds} + ((-5.4481e-14 * {t} + 8.733e-12) * {t} - 6.7795e-10) * {t} + 1.8741e-8)"
    return f"(({cubic} * {p} + {square}) * {p} + (-4.2393e-8 * {t} + 1.8932e-6) * {ds} + ((6.6228e-10 * {t} - 6.836e-8) * {t} + 8.5258e-6) * {t} + 3.5803e-5)"


_GROSS = "(CASE WHEN {0} IN (1, 2, 3, 13, 16) THEN 0.05 ELSE 0.01 END)::DOUBLE"
_GOOD = "exp(-0.5 * least(pow({0}, 2) / ({1}), 160.0)) / sqrt(6.283185307179586 * ({1}))"
#: Potential temperature by steps of 1 dbar to the surface, each level's steps as a fold over a list, and the posterior of e07.
_BACKGROUND = f"""WITH RECURSIVE sp AS MATERIALIZED (SELECT uid, lev, suspect FROM ({_SPIKES}) e04), v AS ({interpolated(_ON_CELL, BACKGROUND_SQL, ("ilat", "ilon"), ("clim", "bgev", "obev"))}),
w0 AS (SELECT v.uid, v.lev, v.z, v.t, v.clim, v.bgev, v.obev, coalesce(l.s, 35.0) - 35.0 AS ds, p.lat, p.probe, sp.suspect, 5.92e-3 + 5.25e-3 * pow(sin(radians(p.lat)), 2) AS c1
FROM v JOIN {{levels}} l ON l.uid = v.uid AND l.lev = v.lev JOIN {{profiles}} p ON p.uid = v.uid JOIN sp ON sp.uid = v.uid AND sp.lev = v.lev WHERE v.t IS NOT NULL AND v.z IS NOT NULL AND v.clim IS NOT NULL),
w1 AS (SELECT *, {local.PRESSURE} AS pr FROM w0), w2 AS (SELECT *, struct_pack(p := pr, b := t + {_lapse_sql('t', 'ds', 'pr')}, n := t, ds := ds) AS start FROM w1),
w3 AS (SELECT *, CASE WHEN pr > 0 AND pr <= 20000 THEN list_reduce(list_prepend(start, list_transform(range(ceil(pr)::BIGINT), lambda x: start)), lambda a, x: struct_pack(p := a.p - 1, b := a.n, n := a.b - 2 * {_lapse_sql('a.n', 'a.ds', 'a.p')}, ds := a.ds)) END AS last FROM w2),
w4 AS (SELECT *, CASE WHEN pr = 0 THEN t ELSE (last.p + 1) * last.n - last.p * last.b END AS theta, 4.0 * bgev * CASE WHEN abs(lat) < 10 THEN 2.25 ELSE 1.0 END + obev AS var, CASE WHEN suspect THEN 0.5 + 0.5 * {_GROSS.format('probe')} ELSE {_GROSS.format('probe')} END AS guess FROM w3),
w5 AS (SELECT *, {_GOOD.format('theta - clim', 'var')} AS good FROM w4), w6 AS (SELECT *, CASE WHEN theta IS NOT NULL THEN 0.1 * guess / (0.1 * guess + good * (1 - guess)) END AS pge FROM w5)
SELECT l.uid, l.lev, coalesce(w6.pge >= 0.5, FALSE) AS flag, w6.pge, w6.theta, w6.clim FROM {{levels}} l LEFT JOIN w6 ON w6.uid = l.uid AND w6.lev = l.lev"""
_add("check_e07_background", _with(_e07), f"SELECT uid, lev, flag, round(pge, 6) AS pge, round(theta, 6) AS theta, round(clim, 6) AS clim FROM ({_BACKGROUND}) e07")


def _posterior(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    """The posterior of e07 with temperatures as they are for potential ones, and t07 for the suspects."""
    suspects = local.run_local(lv, pr, ("t07_rate_of_change",), ("z", "t")).withColumnRenamed("t07_rate_of_change", "suspect")
    at = lambda f: gridded.between(F.col("around"), F.col("z"), f).alias(f)
    met = gridded.on_background(suspects, pr, _grid(s, BACKGROUND_SQL)).select("*", gridded.once(gridded.around_depth(F.col("col"), F.col("z"))).alias("around"))
    on = met.select("uid", "lev", "t", "probe", "suspect", at("clim"), at("bgev"), at("obev"))
    pge = gridded.posterior_error(F.col("t") - F.col("clim"), 4.0 * F.col("bgev") + F.col("obev"), gridded.gross_error(F.col("probe"), F.col("suspect")))
    return _rounded(on.select("uid", "lev", "clim", "bgev", pge.alias("pge")))


_GUESS = "(CASE WHEN probe IN (1, 2, 3, 13, 16) THEN 0.05 ELSE 0.01 END)::DOUBLE"
_add(
    "background_posterior",
    _with(_posterior),
    f"""WITH v AS ({interpolated(_ON_CELL, BACKGROUND_SQL, ("ilat", "ilon"), ("clim", "bgev", "obev"))}), f AS ({local.check_sql("t07_rate_of_change", local.DUCK)}),
w AS (SELECT v.*, 4.0 * bgev + obev AS var, CASE WHEN f.flag THEN 0.5 + 0.5 * {_GUESS} ELSE {_GUESS} END AS guess FROM v JOIN f ON f.uid = v.uid AND f.lev = v.lev JOIN {{profiles}} p ON p.uid = v.uid),
q AS (SELECT *, exp(-0.5 * least(pow(t - clim, 2) / var, 160.0)) / sqrt(6.283185307179586 * var) AS good FROM w)
SELECT uid, lev, round(clim, 6) AS clim, round(bgev, 6) AS bgev, CASE WHEN t IS NOT NULL AND clim IS NOT NULL THEN round(0.1 * guess / (0.1 * guess + good * (1 - guess)), 6) END AS pge FROM q""",
)
_add(
    "check_o01_below_bottom",
    _with(lambda s, lv, pr: gridded.below_bottom(lv, pr, _grid(s, RELIEF_SQL), *_TENS)),
    f"SELECT x.uid, x.lev, coalesce(x.z > -r.height, FALSE) AS flag FROM ({_ON_CELL}) x LEFT JOIN ({RELIEF_SQL}) r ON r.ilat = x.ilat AND r.ilon = x.ilon",
)
for _name, _reach in (("o05_land_around", 2), ("t14_land", 0)):
    _add(
        f"check_{_name}",
        _with(lambda s, lv, pr, k=_reach: gridded.at_sea(lv, pr, _grid(s, RELIEF_SQL), *_TENS, reach=k)),
        f"""WITH r AS ({RELIEF_SQL}), n AS (SELECT a.ilat, a.ilon, min(b.height) >= 0 AND count(*) = {(2 * _reach + 1) ** 2} AS land FROM r a JOIN r b ON abs(a.ilat - b.ilat) <= {_reach} AND least((a.ilon - b.ilon + 36) % 36, (b.ilon - a.ilon + 36) % 36) <= {_reach} GROUP BY ALL)
SELECT x.uid, x.lev, coalesce(x.lon < -180 OR x.lon >= 360 OR x.lat < -90 OR x.lat > 90 OR n.land, FALSE) AS flag FROM ({_ON_CELL}) x LEFT JOIN n ON n.ilat = x.ilat AND n.ilon = x.ilon""",
    )
_add(
    "check_o04_region_range",
    _with(lambda s, lv, pr: gridded.region_range(lv, pr, _grid(s, REGIONS_SQL), _grid(s, RANGES_SQL))),
    f"""WITH spot AS (SELECT uid, region FROM (SELECT uid, ((round_even(lat - 0.5, 0) + 90.5) % 180 + 180) % 180 - 90 AS glat, ((round_even(lon - 0.5, 0) + 180.5) % 360 + 360) % 360 - 180 AS glon FROM {{profiles}}) p JOIN ({REGIONS_SQL}) c ON c.glat = p.glat AND c.glon = p.glon),
r AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY region ORDER BY depth), -1e9) AS above FROM ({RANGES_SQL}) q), l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lev) AS i FROM {{levels}})
SELECT l.uid, l.lev, coalesce(l.i > 1 AND (l.t < r.tmin OR l.t > r.tmax), FALSE) AS flag FROM l LEFT JOIN spot ON spot.uid = l.uid LEFT JOIN r ON r.region = spot.region AND l.z > r.above AND l.z <= r.depth""",
)
_FIT = "k <= 3 AND m_amd >= 0 AND m_med >= -2.3"
_add(
    "check_i09_local_climatology",
    _with(lambda s, lv, pr: gridded.local_climatology(lv, pr, _grid(s, MONTHLY_SQL, profiles=pr), _grid(s, ANNUAL_SQL, profiles=pr), EDGES, 3)),
    f"""WITH l AS (SELECT uid, lev, t, CAST({_BINS} AS INT) AS k FROM {{levels}} WHERE z >= 0 AND t IS NOT NULL), p AS (SELECT uid, month, CAST(floor((lon + 180) / 0.5) AS INT) AS ix, CAST(floor((90 - lat) / 0.5) AS INT) AS iy FROM {{profiles}}
WHERE NOT ((lat BETWEEN 35 AND 45 AND lon BETWEEN 45 AND 60) OR (lat BETWEEN 40 AND 50 AND lon BETWEEN -95 AND -75))),
j AS (SELECT l.uid, l.lev, l.t, l.k, m.med AS m_med, m.amd AS m_amd, y.med AS y_med, y.amd AS y_amd FROM l JOIN p ON p.uid = l.uid LEFT JOIN ({MONTHLY_SQL}) m ON m.ix = p.ix AND m.iy = p.iy AND m.k = l.k AND m.month = p.month LEFT JOIN ({ANNUAL_SQL}) y ON y.ix = p.ix AND y.iy = p.iy AND y.k = l.k),
c AS (SELECT uid, lev, t, CASE WHEN {_FIT} THEN m_med WHEN y_amd >= 0 AND y_med >= -2.3 THEN y_med END AS med, CASE WHEN {_FIT} THEN m_amd WHEN y_amd >= 0 AND y_med >= -2.3 THEN y_amd END AS amd0 FROM j),
f AS (SELECT uid, lev, t < greatest(med - 3 * amd, -2.3) OR t > least(med + 3 * amd, 33.0) AS flag FROM (SELECT *, CASE WHEN amd0 > 0 AND amd0 < 0.05 THEN 0.05 ELSE amd0 END AS amd FROM c) c2 WHERE med IS NOT NULL)
SELECT o.uid, o.lev, coalesce(f.flag, FALSE) AS flag FROM {{levels}} o LEFT JOIN f ON f.uid = o.uid AND f.lev = o.lev""",
)


def _i10(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    lon = "CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END"
    cells = f"SELECT DISTINCT CAST(bround(({lon} + 180) / 0.5) AS INT) AS i, CAST(bround((90 - lat) / 0.5) AS INT) AS j, month FROM {{profiles}}"
    grid = _grid(s, f"SELECT i, j, month, CAST(d.k AS INT) AS k, CAST(CASE WHEN (i + d.k) % 9 <> 0 THEN 18 - 3 * d.k END AS DOUBLE) AS tmin, CAST(29 - 2 * d.k AS DOUBLE) AS tmax FROM ({cells}) c CROSS JOIN range(0, 7) AS d(k)", profiles=pr)
    annual = grid.groupBy("i", "j", "k").agg(F.lit(10.0).alias("tmin"), F.lit(30.0).alias("tmax"))
    return gridded.two_bin_climatology(lv, pr, grid.where("month BETWEEN 1 AND 12"), annual, EDGES, 4)


_TURNED = "CASE WHEN lon >= 180 AND lon < 360 THEN lon - 360 ELSE lon END"
_I10_CELL = f"CAST(round_even(({_TURNED} + 180) / 0.5, 0) AS INT) AS i, CAST(round_even((90 - lat) / 0.5, 0) AS INT) AS j"
_LOWEST, _HIGHEST = ("CASE WHEN k < 4 AND m0.tmin IS NOT NULL AND m1.tmin IS NOT NULL AND m0.tmax IS NOT NULL AND m1.tmax IS NOT NULL THEN {0}(m0.{1}, m1.{1}) WHEN y0.i IS NOT NULL AND y1.i IS NOT NULL THEN {2} ELSE {3} END".format(*x) for x in (("least", "tmin", 10.0, -2.0), ("greatest", "tmax", 30.0, 33.0)))
_add(
    "check_i10_two_bin_climatology",
    _with(_i10),
    f"""WITH c AS (SELECT DISTINCT CAST(round_even((CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END + 180) / 0.5, 0) AS INT) AS i, CAST(round_even((90 - lat) / 0.5, 0) AS INT) AS j, month FROM {{profiles}}),
g AS (SELECT i, j, month, d.k AS gk, CASE WHEN (i + d.k) % 9 <> 0 THEN 18 - 3 * d.k END::DOUBLE AS tmin, (29 - 2 * d.k)::DOUBLE AS tmax FROM c CROSS JOIN range(0, 7) AS d(k)),
m AS (SELECT * FROM g WHERE month BETWEEN 1 AND 12), y AS (SELECT DISTINCT i, j, gk FROM g),
l AS (SELECT l.uid, l.lev, l.t, CAST({_BINS} AS INT) AS k, p.i, p.j, p.month FROM {{levels}} l JOIN (SELECT uid, month, {_I10_CELL} FROM {{profiles}}) p ON p.uid = l.uid WHERE z IS NOT NULL AND t IS NOT NULL AND p.i BETWEEN 0 AND 720 AND p.j BETWEEN 0 AND 360),
f AS (SELECT uid, lev, t < {_LOWEST} OR t > {_HIGHEST} AS flag FROM l LEFT JOIN m m0 ON m0.i = l.i AND m0.j = l.j AND m0.month = l.month AND m0.gk = l.k LEFT JOIN m m1 ON m1.i = l.i AND m1.j = l.j AND m1.month = l.month AND m1.gk = l.k + 1
LEFT JOIN y y0 ON y0.i = l.i AND y0.j = l.j AND y0.gk = l.k LEFT JOIN y y1 ON y1.i = l.i AND y1.j = l.j AND y1.gk = l.k + 1 WHERE k IS NOT NULL)
SELECT o.uid, o.lev, coalesce(f.flag, FALSE) AS flag FROM {{levels}} o LEFT JOIN f ON f.uid = o.uid AND f.lev = o.lev""",
)


def _on_map(lat: str, lon: str) -> tuple[str, str]:
    r, a = f"(12734000.0 * sin(radians(90 - {lat}) / 2))", f"radians({lon} + 40)"
    return f"({r} * sin({a}))", f"(-{r} * cos({a}))"


def _inside_sql(lats: tuple[float, ...], lons: tuple[float, ...]) -> str:
    """SQL of a point-in-polygon test by crossed edges on the polar map."""
    x, y = _on_map("lat", "lon")
    corners = [_on_map(str(a), str(o)) for a, o in zip(lats, lons, strict=True)]
    edges = zip(corners, corners[1:] + corners[:1], strict=True)
    return "(" + " + ".join(f"(({y1} > {y}) <> ({y2} > {y}) AND {x} < {x1} + ({y} - {y1}) / ({y2} - {y1}) * ({x2} - {x1}))::INT" for (x1, y1), (x2, y2) in edges) + ") % 2 = 1"


_add(
    "check_r05_regional_range",
    _with(lambda s, lv, pr: gridded.regional_range(lv, pr)),
    f"""WITH p AS (SELECT uid, {_inside_sql(*gridded.RED_SEA)} AS red, {_inside_sql(*gridded.MEDITERRANEAN)} AS med FROM {{profiles}})
SELECT l.uid, l.lev, coalesce((red AND (t < 21.7 OR t > 40)) OR (med AND (t < 10 OR t > 40)), FALSE) AS flag FROM {{levels}} l LEFT JOIN p ON p.uid = l.uid""",
)
_ENVELOPE = ((-1.0, 100.0, 5.0, 28.0), (100.0, 400.0, 0.0, 26.0), (400.0, 2000.0, -2.0, 20.0))
_add(
    "check_t06_envelope",
    _with(lambda s, lv, pr: gridded.envelope(lv, _ENVELOPE)),
    "SELECT uid, lev, coalesce(" + " OR ".join(f"(z > {a} AND z <= {b} AND (t < {c} OR t > {e}))" for a, b, c, e in _ENVELOPE) + ", FALSE) AS flag FROM {levels}",
)


POINTS_SQL = "SELECT DISTINCT floor(lat / 0.25) * 0.25 AS lat, floor(lon / 0.25) * 0.25 AS lon, CAST(d.k * 200 AS DOUBLE) AS depth, CAST(24 - 3 * d.k AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS sd FROM {profiles} CROSS JOIN range(0, 8) AS d(k) WHERE uid % 3 <> 0"


def _points(s: SparkSession, pr: DataFrame) -> DataFrame:
    return _grid(s, POINTS_SQL, profiles=pr)


_TURN = "g.lon + CASE WHEN g.lon - p.lon > 180 THEN -360.0 WHEN g.lon - p.lon < -180 THEN 360.0 ELSE 0.0 END"
_NEAR_POINT = f"""SELECT uid, glat, glon FROM (SELECT uid, glat, glon, row_number() OVER (PARTITION BY uid ORDER BY away, glat, glon) AS r FROM
(SELECT p.uid, g.lat AS glat, g.lon AS glon, sqrt(pow(g.lat - p.lat, 2) + pow({_TURN} - p.lon, 2)) AS away FROM {{profiles}} p JOIN (SELECT DISTINCT lat, lon FROM ({POINTS_SQL}) g0) g ON abs(g.lat - p.lat) <= 0.25) a WHERE away <= 0.25) b WHERE r = 1"""
_AT_POINT = f"SELECT l.uid, l.lev, l.z, l.t, n.glat, n.glon FROM {{levels}} l LEFT JOIN ({_NEAR_POINT}) n ON n.uid = l.uid"
_MEANS = interpolated(_AT_POINT, f"SELECT lat AS glat, lon AS glon, depth, mean, sd FROM ({POINTS_SQL}) g1", ("glat", "glon"), ("mean", "sd"))
for _name, _most in (("a05_climatology", 5.0), ("t11_climatology_bias", 3.0), ("t12_climatology_bias_wide", 6.0)):
    _add(
        f"check_{_name}",
        _with(lambda s, lv, pr, m=_most: gridded.climatology(lv, pr, _points(s, pr), m)),
        f"SELECT uid, lev, coalesce(sd > 0 AND abs(t - mean) / nullif(sd, 0) > {_most}, FALSE) AS flag FROM ({_MEANS}) v",
    )


def _o06(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    cells = _grid(s, "SELECT CAST(id AS INT) AS cell, CAST(floor(id / 36) * 10 - 85 AS DOUBLE) AS lat, CAST(id % 36 * 10 - 175 AS DOUBLE) AS lon FROM range(0, 648) AS c(id)")
    square = F.array(*(F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + b).alias("lon")) for a, b in ((-5, -5), (-5, 5), (5, 5), (5, -5))))
    bounds = _grid(s, "SELECT CAST(c.id AS INT) AS cell, CAST(d.k * 200 AS DOUBLE) AS lo, CAST(d.k * 200 + 200 AS DOUBLE) AS hi, CAST(20 - 4 * d.k AS DOUBLE) AS tmin, CAST(30 - 2 * d.k AS DOUBLE) AS tmax FROM range(0, 648) AS c(id) CROSS JOIN range(0, 8) AS d(k)")
    return gridded.min_max(lv, pr, cells.withColumn("corners", square), bounds)


_ANGLE = "2 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))))"
_add(
    "check_o06_min_max",
    _with(_o06),
    f"""WITH c AS (SELECT id AS cell, floor(id / 36) * 10 - 85.0 AS lat, id % 36 * 10 - 175.0 AS lon FROM range(0, 648) AS r(id)),
n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY angle, cell) AS r FROM (SELECT p.uid, p.lat AS y, p.lon AS x, c.cell, c.lat, c.lon, round(degrees({_ANGLE}), 9) AS angle FROM {{profiles}} p JOIN c ON TRUE) a),
h AS (SELECT uid, y, cell, row_number() OVER (PARTITION BY uid ORDER BY r) AS one FROM n WHERE r <= 3 AND y >= lat - 5 AND y < lat + 5 AND CASE WHEN x < -180 THEN x + 360 WHEN x >= 180 THEN x - 360 ELSE x END >= lon - 5 AND CASE WHEN x < -180 THEN x + 360 WHEN x >= 180 THEN x - 360 ELSE x END < lon + 5),
c1 AS (SELECT l.uid, l.lev, l.t, l.z, h.cell, 5.92e-3 + 5.25e-3 * sin(radians(h.y)) * sin(radians(h.y)) AS c1 FROM {{levels}} l LEFT JOIN h ON h.uid = l.uid AND h.one = 1),
q AS (SELECT uid, lev, t, cell, {local.PRESSURE} AS pr FROM c1)
SELECT q.uid, q.lev, coalesce(q.t < 20 - 4 * d.k OR q.t > 30 - 2 * d.k, FALSE) AS flag FROM q
LEFT JOIN range(0, 8) AS d(k) ON q.cell IS NOT NULL AND d.k * 200 < q.pr AND q.pr <= d.k * 200 + 200""",
)

LAWS = {"gradient": (1.0, 1.0, 0.0, 0.6), "spike": (1.5, 0.8, 0.0, 0.5), "rate": (1.0, 1.0, 0.1, 0.8)}
MEMBERSHIPS = {
    "gradient": {"low": (1.5, 0.5), "medium": (0.5, 1.5, 3.0, 9.0), "high": (3.0, 9.0)},
    "spike": {"low": (1.0, 0.2), "medium": (0.2, 1.0, 2.0, 6.0), "high": (2.0, 6.0)},
    "rate": {"low": (2.0, 0.5), "medium": (0.5, 2.0, 3.0, 4.0), "high": (3.0, 4.0)},
}
NARROW = {
    "gradient": {"low": (1.0, 0.5), "medium": (0.5, 1.0, 1.5, 4.0), "high": (1.5, 4.0)},
    "spike": {"low": (0.6, 0.2), "medium": (0.2, 0.6, 1.0, 3.0), "high": (1.0, 3.0)},
    "rate": {"low": (1.0, 0.5), "medium": (0.5, 1.0, 2.0, 4.0), "high": (2.0, 4.0)},
}
_FEATURES = """SELECT uid, lev, abs(t - (a + b) / 2) AS gradient, abs(abs(t - (a + b) / 2) - abs((b - a) / 2)) AS spike, abs(t - a) AS rate
FROM (SELECT uid, lev, t, lag(t) OVER w AS a, lead(t) OVER w AS b FROM {levels} WINDOW w AS (PARTITION BY uid ORDER BY lev)) x"""


def _law_sql(name: str, law: tuple[float, float, float, float]) -> str:
    shape, power, place, scale = law
    return f"coalesce(CASE WHEN {name} IS NOT NULL THEN ln(greatest(1 - pow(1 - exp(-pow(greatest(({name} - {place}) / {scale}, 0.0), {power})), {shape}), 1e-300)) END, 0)"


def _over_sql(x: str, corners) -> str:
    ramp = lambda a, b: f"greatest(0.0, least(1.0, ({x} - {a}) / ({b - a})))"
    return ramp(*corners) if len(corners) == 2 else f"least({ramp(corners[0], corners[1])}, {ramp(corners[3], corners[2])})"


def _fuzzy_sql(memberships: dict) -> str:
    """Rule strengths, the output sets on a grid, and where their union is halved."""
    own = lambda level: "[" + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {_over_sql(n, m[level])} END" for n, m in memberships.items()) + "]"
    rows = f"SELECT uid, lev, list_avg({own('low')}) AS low, list_avg({own('medium')}) AS medium, list_max({own('high')}) AS high FROM ({_FEATURES}) f"
    height = "greatest(" + ", ".join(f"least({n}, {_over_sql('(k / 50.0)', c)})" for n, c in gridded.UNCERTAINTY.items()) + ")"
    run = f"SELECT uid, lev, k, sum(h) OVER (PARTITION BY uid, lev ORDER BY k) AS upto, sum(h) OVER (PARTITION BY uid, lev) AS whole FROM (SELECT uid, lev, k, {height} AS h FROM ({rows}) r CROSS JOIN range(0, 51) AS g(k) WHERE low IS NOT NULL) a"
    return f"""WITH u AS (SELECT uid, lev, min(k) / 50.0 AS u FROM ({run}) b WHERE whole > 0 AND upto >= whole / 2 - 1e-9 GROUP BY uid, lev)
SELECT l.uid, l.lev, coalesce(u.u > 0.34, FALSE) AS flag FROM {{levels}} l LEFT JOIN u ON u.uid = l.uid AND u.lev = l.lev"""


_add("check_t15_anomaly", _with(lambda s, lv, pr: gridded.anomaly(*gridded.features(lv), LAWS)), f"SELECT uid, lev, {' + '.join(_law_sql(n, x) for n, x in LAWS.items())} < -18 AS flag FROM ({_FEATURES}) f")
_add("check_t16_fuzzy", _with(lambda s, lv, pr: gridded.fuzzy(*gridded.features(lv), MEMBERSHIPS)), _fuzzy_sql(MEMBERSHIPS))
_add("check_t17_fuzzy_narrow", _with(lambda s, lv, pr: gridded.fuzzy(*gridded.features(lv), NARROW)), _fuzzy_sql(NARROW))
DEPTHS = tuple(float(d) for d in (5, 15, 25, 50, 75, 100, 150, 200, 300, 400, 500, 600, 800, 1000, 1200))
_PAIR = "a.uid <> b.uid AND a.year = b.year AND a.month = b.month AND a.cruise <> b.cruise AND abs(a.lat - b.lat) <= 5"
_GREAT = "2 * 6367000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_add(
    "buddies",
    _with(lambda s, lv, pr: _rounded(buddy.buddies(pr).withColumn("metres", F.round("metres", 2)))),
    f"SELECT uid, buddy, round(metres, 2) AS metres FROM (SELECT a.uid, b.uid AS buddy, {_GREAT} AS metres, row_number() OVER (PARTITION BY a.uid ORDER BY round({_GREAT}, 3), b.uid) AS r FROM {{profiles}} a JOIN {{profiles}} b ON {_PAIR}) x WHERE r = 1 AND metres <= 400000",
)


_NEAREST = f"list_position(list_transform({list(DEPTHS)}, lambda d: abs(d - z)), list_min(list_transform({list(DEPTHS)}, lambda d: abs(d - z)))) - 1"
_add(
    "standard_levels",
    _with(lambda s, lv, pr: _rounded(buddy.standard_levels(lv.withColumn("diff", F.col("t")), DEPTHS))),
    f"SELECT uid, ({_NEAREST})::INT AS k, round(avg(t), 6) AS diff, count(*) AS n FROM {{levels}} WHERE t IS NOT NULL AND z IS NOT NULL GROUP BY ALL",
)
_SIX = ("e01_range", "e02_constant_value", "e06_stability")
_add(
    "union_of_flags",
    _with(lambda s, lv, pr: local.run_any(_SIX, lv, pr)),
    "SELECT uid, lev, bool_or(flag) AS flag FROM (" + " UNION ALL ".join(f"SELECT * FROM ({local.check_sql(n, local.DUCK)}) q_{n}" for n in _SIX) + ") a GROUP BY uid, lev",
)
_add(
    "levels_that_pass",
    _with(lambda s, lv, pr: rules.passed(lv, local.run_any(_SIX, lv, pr)).select("uid", "lev", "z")),
    "SELECT uid, lev, z FROM {levels} SEMI JOIN (SELECT uid, lev FROM (" + " UNION ALL ".join(f"SELECT * FROM ({local.check_sql(n, local.DUCK)}) q_{n}" for n in _SIX) + ") a GROUP BY uid, lev HAVING NOT bool_or(flag)) b USING (uid, lev)",
)


_WHEN = "CASE WHEN {0}month BETWEEN 1 AND 12 AND {0}day <= day(last_day(make_date({0}year, {0}month, 1))) THEN epoch(make_date({0}year, {0}month, {0}day)) + CASE WHEN {0}time >= 0 AND {0}time < 24 THEN {0}time * 3600 ELSE 0 END END"
_STD_CELL = f"SELECT p.uid, d.k AS lev, d.depth AS z, NULL::DOUBLE AS t, p.ilat, p.ilon FROM (SELECT uid, {_CELL} FROM {{profiles}}) p CROSS JOIN (VALUES {', '.join(f'({k}, {d})' for k, d in enumerate(DEPTHS))}) AS d(k, depth)"
_BUDDY_SQL = f"SELECT uid, buddy, metres FROM (SELECT a.uid, b.uid AS buddy, {_GREAT} AS metres, row_number() OVER (PARTITION BY a.uid ORDER BY round({_GREAT}, 3), b.uid) AS r FROM {{profiles}} a JOIN {{profiles}} b ON {_PAIR}) x WHERE r = 1 AND metres <= 400000"
_PGE = lambda d, var, probe: f"0.1 * {_GROSS.format(probe)} / (0.1 * {_GROSS.format(probe)} + {_GOOD.format(d, var)} * (1 - {_GROSS.format(probe)}))"
_PART = "sqrt(bgev / 2 * bgev2 / 2) * (1 + metres / {0}.0) * exp(-metres / {0}.0 - pow(gap / 432000.0, 2))"
_STANDARD = f"""WITH RECURSIVE near AS MATERIALIZED ({_BACKGROUND}), prior AS (SELECT uid, lev, bool_or(flag) AS flag FROM (SELECT uid, lev, flag FROM near UNION ALL SELECT uid, lev, reject AS flag FROM ({_SPIKES}) b1 UNION ALL SELECT * FROM ({_DISORDER}) b2
 UNION ALL {' UNION ALL '.join(f"SELECT uid, lev, flag FROM ({local.check_sql(n, local.DUCK)}) b_{n}" for n in _SIX)}) b GROUP BY uid, lev),
lv AS (SELECT l.uid, l.lev, CASE WHEN diff IS NOT NULL THEN k END AS k, diff FROM (SELECT l.uid, l.lev, ({_NEAREST})::INT AS k, CASE WHEN NOT prior.flag THEN near.theta - near.clim END AS diff FROM {{levels}} l JOIN near ON near.uid = l.uid AND near.lev = l.lev JOIN prior ON prior.uid = l.uid AND prior.lev = l.lev) l),
std AS (SELECT uid, k, avg(diff) AS diff FROM lv WHERE diff IS NOT NULL GROUP BY uid, k),
err AS (SELECT uid, lev AS k, clim, bgev, obev FROM ({interpolated(_STD_CELL, BACKGROUND_SQL, ("ilat", "ilon"), ("clim", "bgev", "obev"))}) i WHERE clim IS NOT NULL),
bud AS MATERIALIZED ({_BUDDY_SQL}), both_ AS (SELECT s.uid, s.k, s.diff, e.clim, e.bgev, e.obev, p.lat, p.probe, o.diff AS diff2, oe.bgev AS bgev2, bud.metres, q.lat AS blat, q.probe AS bprobe, abs(({_WHEN.format('p.')}) - ({_WHEN.format('q.')})) AS gap
 FROM std s JOIN err e ON e.uid = s.uid AND e.k = s.k JOIN {{profiles}} p ON p.uid = s.uid LEFT JOIN bud ON bud.uid = s.uid LEFT JOIN (std o JOIN err oe ON oe.uid = o.uid AND oe.k = o.k) ON o.uid = bud.buddy AND o.k = s.k LEFT JOIN {{profiles}} q ON q.uid = bud.buddy),
c1 AS (SELECT *, {_PGE('diff', 'obev + bgev * CASE WHEN abs(lat) < 10 THEN 2.25 ELSE 1.0 END', 'probe')} AS pge0, {_PGE('diff', 'obev + bgev2 * CASE WHEN abs(blat) < 10 THEN 2.25 ELSE 1.0 END', 'bprobe')} AS heard, {_PART.format(100000)} + {_PART.format(400000)} AS cov, obev + bgev AS va, obev + bgev2 AS vb FROM both_),
c2 AS (SELECT *, cov * cov / (va * vb) AS rho FROM c1),
c3 AS (SELECT *, greatest(-80.0, least(80.0, -0.5 * ln(1 - rho) - 0.5 * rho / (1 - rho) * (diff * diff / va + diff2 * diff2 / vb - 2 * diff * diff2 / cov))) AS logq FROM c2),
c4 AS (SELECT *, CASE WHEN diff2 IS NOT NULL AND gap IS NOT NULL THEN 1.0 / nullif(1 - (1 - pge0) * (1 - heard) * (1 - logq), 0) END AS zz FROM c3),
c5 AS (SELECT uid, k, lat, diff + clim AS value, coalesce(pge0 * sqrt(CASE WHEN zz < 0 THEN 1.0 ELSE zz END), pge0) AS pge FROM c4),
c6 AS (SELECT *, CASE WHEN lag(k) OVER w - k = -1 AND lag(pge) OVER w < 0.5 THEN lag(value) OVER w END AS above, CASE WHEN lead(k) OVER w - k = 1 AND lead(pge) OVER w < 0.5 THEN lead(value) OVER w END AS below, {list(DEPTHS)}[k + 1] AS depth, CASE WHEN abs(lat) < 20 THEN 300.0 ELSE 200.0 END AS base FROM c5 WINDOW w AS (PARTITION BY uid ORDER BY k)),
c7 AS (SELECT *, 0.5 * CASE WHEN depth > base + 100 THEN 0.5 WHEN depth > base THEN 1.0 - 0.005 * (depth - base) ELSE 1.0 END AS slack FROM c6),
c8 AS (SELECT uid, k, pge >= 0.5 AND NOT coalesce(value BETWEEN coalesce(below, above) - slack AND coalesce(above, below) + slack, FALSE) AS bad FROM c7)
SELECT l.uid, l.lev, coalesce(c8.bad, FALSE) AS flag FROM lv l LEFT JOIN c8 ON c8.uid = l.uid AND c8.k = l.k"""
_add("check_e09_standard_levels_and_buddies", _with(lambda s, lv, pr: buddy.standard_level_check(lv, pr, _grid(s, BACKGROUND_SQL), DEPTHS)), _STANDARD)


_FULL = "SELECT *, CAST(uid % 9 AS INT) AS profile_type, CAST(uid % 17 AS INT) AS orig_flag_type FROM {profiles}"


def _screened(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    full = pr.withColumn("profile_type", (F.col("uid") % 9).cast("int")).withColumn("orig_flag_type", (F.col("uid") % 17).cast("int"))
    kept, coded = ingest.ingest(full, lv, local.run("s06_wire_break", lv, pr))
    return kept.select("uid", "flagged")


_BREAK = local.check_sql("s06_wire_break", local.DUCK)
_INGEST = f"""WITH a AS (SELECT uid, count(t) AS n_t, count(*) AS n, bool_and(coalesce(z < 0.1, FALSE)) AS shallow, bool_or(t IS NOT NULL AND coalesce(truth, 0) <= 0) AS unjudged FROM {{levels}} GROUP BY uid),
k AS (SELECT p.uid FROM ({_FULL}) p JOIN a ON a.uid = p.uid WHERE p.profile_type <> 1 AND p.month BETWEEN 1 AND 12 AND p.orig_flag_type BETWEEN 1 AND 14 AND n_t > 0 AND NOT (n > 1 AND shallow) AND NOT unjudged),
b AS (SELECT l.uid, l.truth, max(w.flag::INT) OVER (PARTITION BY l.uid ORDER BY l.lev) AS gone FROM {{levels}} l JOIN ({_BREAK}) w ON w.uid = l.uid AND w.lev = l.lev)
SELECT k.uid, coalesce(bool_or(b.gone = 0 AND b.truth IN (3, 4)), FALSE)::INT AS flagged FROM k LEFT JOIN b ON b.uid = k.uid GROUP BY k.uid"""
_add("ingest", _with(_screened), _INGEST)
_add("ingest_counts", _with(lambda s, lv, pr: ingest.ingest_counts(_screened(s, lv, pr))), f"SELECT count_if(flagged = 0)::BIGINT AS clean, count_if(flagged = 1)::BIGINT AS flagged, count(*) AS total FROM ({_INGEST}) i")
_add(
    "split_by_cruise",
    _with(lambda s, lv, pr: ingest.split_by_cruise(pr.join(lv.groupBy("uid").agg(F.count("*").alias("size")), "uid"), 10).select("uid", "part")),
    """WITH RECURSIVE c AS (SELECT p.cruise, count(*) AS s, row_number() OVER (ORDER BY p.cruise) AS i FROM {profiles} p JOIN {levels} l ON l.uid = p.uid GROUP BY p.cruise), share AS (SELECT ceil(sum(s) / 10.0) AS share FROM c),
walk AS (SELECT cruise, i, 0 AS part, s AS filled FROM c WHERE i = 1 UNION ALL SELECT c.cruise, c.i, w.part + (w.filled > share)::INT, CASE WHEN w.filled > share THEN c.s ELSE w.filled + c.s END FROM walk w JOIN c ON c.i = w.i + 1 CROSS JOIN share)
SELECT p.uid, walk.part FROM {profiles} p JOIN walk ON walk.cruise = p.cruise WHERE p.uid IN (SELECT uid FROM {levels})""",
)
_FLAGGED_UIDS = "SELECT uid, max((truth = 4)::INT) AS flagged FROM {levels} GROUP BY uid"
_add(
    "balanced_sample",
    _with(lambda s, lv, pr: ingest.balanced_sample(lv.groupBy("uid").agg(F.max((F.col("truth") == 4).cast("int")).alias("flagged")), 100)),
    f"SELECT uid, flagged FROM (SELECT uid, flagged, row_number() OVER (PARTITION BY flagged ORDER BY md5(uid || '-0'), uid) AS r FROM ({_FLAGGED_UIDS}) x WHERE flagged IN (0, 1)) y WHERE r <= 100",
)
_add(
    "batch",
    _with(lambda s, lv, pr: ingest.batch(pr, 2, 150).select("uid", "cruise")),
    "SELECT uid, cruise FROM (SELECT uid, cruise, row_number() OVER (ORDER BY uid) AS r FROM {profiles}) x WHERE r > 300 AND r <= 450",
)
_add(
    "held_out_profiles",
    _with(lambda s, lv, pr: ingest.held_out(ingest.mark_training(pr, pr.where("uid % 4 = 1"))).select("uid", "training")),
    "SELECT uid, 0 AS training FROM {profiles} WHERE uid % 4 <> 1",
)
_add("run_checks", _with(lambda s, lv, pr: registry.run_checks(lv, pr, ("a03_gradient", "e01_range", "s06_wire_break", "r06_impossible_date")).groupBy("check").agg(F.count_if("flag").alias("flagged"), F.count("*").alias("levels"))),
     " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count_if(flag)::BIGINT AS flagged, count(*) AS levels FROM ({local.check_sql(n, local.DUCK)}) q_{n}" for n in ("a03_gradient", "e01_range", "s06_wire_break", "r06_impossible_date")))
_add("masked_sentinels", _with(lambda s, lv, pr: lv.select("uid", "lev", ingest.mask_sentinels(F.col("t") + 72).alias("t"), ingest.encode_truth(F.col("t") + 72, F.col("truth")).alias("truth"))),
     "SELECT uid, lev, CASE WHEN NOT (t + 72 >= 99 AND t + 72 < 100) THEN t + 72 END AS t, CASE WHEN t + 72 > 99 AND t + 72 < 100 THEN 99 ELSE truth END AS truth FROM {levels}")


_SHARED = ("e01_range", "e02_constant_value", "e03_spike_and_step", "e04_spike_and_step_suspect", "e05_increasing_depth", "e06_stability")
_COUNTED = "SELECT '{0}' AS \"check\", count_if({1})::BIGINT AS flagged, count(*) AS levels FROM ({2}) q_{0}"
_BY_CHECK = lambda df: df.groupBy("check").agg(F.count_if("flag").alias("flagged"), F.count("*").alias("levels"))
_add(
    "run_shared_checks",
    _with(lambda s, lv, pr: _BY_CHECK(registry.run_checks(lv, pr, _SHARED))),
    " UNION ALL ".join(
        [_COUNTED.format(n, "flag", local.check_sql(n, local.DUCK)) for n in ("e01_range", "e02_constant_value", "e06_stability")]
        + [_COUNTED.format("e03_spike_and_step", "reject", _SPIKES), _COUNTED.format("e04_spike_and_step_suspect", "suspect", _SPIKES), _COUNTED.format("e05_increasing_depth", "flag", _DISORDER)]
    ),
)
_add(
    "run_dependent_checks",
    _with(lambda s, lv, pr: _BY_CHECK(registry.run_checks(lv, pr, ("e03_spike_and_step", "e05_increasing_depth", "e07_background", "e09_standard_levels_and_buddies"), {"background": _grid(s, BACKGROUND_SQL), "standard_depths": DEPTHS}))),
    " UNION ALL ".join(_COUNTED.format(n, c, q) for n, c, q in (("e03_spike_and_step", "reject", _SPIKES), ("e05_increasing_depth", "flag", _DISORDER), ("e07_background", "flag", _BACKGROUND), ("e09_standard_levels_and_buddies", "flag", _STANDARD))),
)


def _stored_by_profile(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    """Levels and the flags of a check as tables by profile, and from these what is flagged of each profile: no exchange by ``uid``."""
    put = lambda df, what: store.save_by_profile(df, (path := lineage.fresh(s, what)).rpartition("/")[2].replace("-", "_"), path, 16)
    levels, flags = put(lv, "levels"), put(local.run("e01_range", lv, pr), "flags")
    on = levels.join(flags, ["uid", "lev"])
    return on.groupBy("uid").agg(F.count("*").alias("levels"), F.count_if("flag").alias("flagged"), F.min(F.when(F.col("flag"), F.col("z"))).alias("shallowest"))


_add(
    "stored_by_profile",
    _with(_stored_by_profile),
    f"SELECT l.uid, count(*) AS levels, count_if(c.flag)::BIGINT AS flagged, min(CASE WHEN c.flag THEN l.z END) AS shallowest FROM {{levels}} l JOIN ({local.check_sql('e01_range', local.DUCK)}) c ON c.uid = l.uid AND c.lev = l.lev GROUP BY l.uid",
)
#: A climatology's columns as whole numbers, by arithmetic over the rows of a table.
_STATED = """CAST(l_partkey % 180 AS INT) - 90 AS lat, CAST(l_suppkey % 360 AS INT) - 180 AS lon, CAST(l_linenumber * 10 AS INT) AS depth, CAST(l_orderkey % 14 AS INT) + 1 AS month, CAST(l_quantity AS INT) % 25 - 3 AS q1,
CAST(l_quantity AS INT) % 25 - 3 + CAST(l_linenumber AS INT) AS q3, CAST(l_quantity AS INT) % 25 - 2 AS median, CAST(l_partkey % 3 AS INT) - 1 AS medcouple"""


def _climatology_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges fitted to lines of text, published by month and read again."""
    names = ("lat", "lon", "depth", "month", "q1", "q3", "median", "medcouple")
    lines = spark.sql(f"SELECT concat('  ', concat_ws('   ', {', '.join(names)}), ' ') AS value FROM (SELECT {_STATED} FROM {{source}})", source=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    path = lineage.fresh(spark, "lines")
    lines.write.text(path)
    return _rounded(ingest.prepared_climatology(spark, lineage.fresh(spark, "climatology"), path, {n: k for k, n in enumerate(names)})).select("lat", "lon", "depth", F.coalesce("month", F.lit(0)).alias("month"), "tmin", "tmax")


_add(
    "climatology_ranges",
    _climatology_ranges,
    f"""SELECT lat::DOUBLE AS lat, lon::DOUBLE AS lon, depth::DOUBLE AS depth, CASE WHEN month <= 12 THEN month ELSE 0 END AS month,
round(CASE WHEN median <= -2 THEN -2.0 ELSE greatest(q1 - 1.5 * (q3 - q1) * exp(CASE WHEN medcouple >= 0 THEN -4.0 ELSE -3.0 END * medcouple), -2.0) END, 6) AS tmin,
round(CASE WHEN median <= -2 THEN 33.0 ELSE least(q3 + 1.5 * (q3 - q1) * exp(CASE WHEN medcouple >= 0 THEN 3.0 ELSE 4.0 END * medcouple), 33.0) END, 6) AS tmax FROM (SELECT {_STATED} FROM lineitem) s""",
)


_FORMULA = "a01_gross_range&a03_gradient|e01_range|o03_gradient&r02_gradient"
_add(
    "confusion_of_formula",
    lambda s, d: _decisions(s, d).select("uid", rates.confusion(F.col("truth"), selection.formula(_FORMULA)).alias("kind")),
    f"SELECT uid, CASE WHEN truth AND hit THEN 'TP' WHEN truth THEN 'FN' WHEN hit THEN 'FP' ELSE 'TN' END AS kind FROM (SELECT uid, truth, {' OR '.join('(' + t.replace('&', ' AND ') + ')' for t in _FORMULA.split('|'))} AS hit FROM ({_DECIDED}) d) x",
)


def _varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.varying(_decisions(spark, sf_dir).withColumn("always", F.lit(True)))
    return spark.createDataFrame([(c,) for c in found.columns], "name string")


_add("varying_columns", _varying, f"WITH d AS (SELECT *, TRUE AS always FROM ({_DECIDED}) d0) " + " UNION ALL ".join(f"SELECT '{c}' AS name FROM d HAVING count(DISTINCT {c}) > 1" for c in ("uid", "truth", *CHECKS, "always")))


def _reused(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    stored = local.run("e01_range", lv, pr).where("uid % 3 = 0").withColumn("flag", F.when(F.col("uid") % 2 == 0, F.col("flag")))
    return ingest.reuse(lv, stored, local.run("a03_gradient", lv, pr))


_add(
    "reused_flags",
    _with(_reused),
    f"SELECT l.uid, l.lev, coalesce(o.flag, c.flag, FALSE) AS flag FROM {{levels}} l LEFT JOIN (SELECT uid, lev, CASE WHEN uid % 2 = 0 THEN flag END AS flag FROM ({local.check_sql('e01_range', local.DUCK)}) e WHERE uid % 3 = 0) o ON o.uid = l.uid AND o.lev = l.lev LEFT JOIN ({local.check_sql('a03_gradient', local.DUCK)}) c ON c.uid = l.uid AND c.lev = l.lev",
)
_add("without_listed", _with(lambda s, lv, pr: ingest.without(lv, pr.where("probe = 2")).select("uid", "lev", "t")), "SELECT uid, lev, t FROM {levels} WHERE uid NOT IN (SELECT uid FROM {profiles} WHERE probe = 2)")
_add(
    "spurious_positions",
    _with(lambda s, lv, pr: ingest.drop_spurious_positions(pr.select("uid", (F.col("lat") * 12).alias("lat"), (F.col("lon") * 6).alias("lon")))),
    "SELECT uid, CASE WHEN abs(y) <= 999 AND abs(x) <= 999 THEN y END AS lat, CASE WHEN abs(y) <= 999 AND abs(x) <= 999 THEN x END AS lon FROM (SELECT uid, lat * 12 AS y, lon * 6 AS x FROM {profiles}) q",
)
_add("first_of_each", _with(lambda s, lv, pr: ingest.first_of_each(lv.where("t > 15"), "lev").select("uid", "lev", "z")), "SELECT uid, lev, z FROM {levels} WHERE t > 15 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY lev) = 1")


def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.search_table(_decisions(spark, sf_dir), CHECKS, with_inverted=True)[0]


_add("inverted_patterns", _inverted, f"SELECT truth, (({_MASK}) + {1 << len(CHECKS)}::BIGINT * ({(1 << len(CHECKS)) - 1} - ({_MASK})))::BIGINT AS mask, count(*) AS n FROM ({_DECIDED}) d GROUP BY ALL")
#: Terms of a selection in their order.
CHOSEN = ("r02_gradient&t07_rate_of_change", "e01_range", "a03_gradient&o03_gradient", "a04_spike")


def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored selection: its points, cut where the FPR reaches 60."""
    masks = [(c, sum(1 << CHECKS.index(x) for x in c.split("&"))) for c in CHOSEN]
    points = selection.roc_points(selection.patterns(_decisions(spark, sf_dir), CHECKS), masks)
    table = spark.createDataFrame([(k, c, t, f) for k, ((c, _), (t, f)) in enumerate(zip(masks, points, strict=True))], "pos int, check string, tpr double, fpr double")
    return _rounded(rates.cut_roc(table, 60.0))


_HELD = [" OR ".join("(" + t.replace("&", " AND ") + ")" for t in CHOSEN[: k + 1]) for k in range(len(CHOSEN))]
_add(
    "roc_points",
    _roc,
    f"WITH d AS ({_DECIDED}), p AS (" + " UNION ALL ".join(f"SELECT {k} AS pos, '{c}' AS \"check\", 100.0 * count_if(truth AND ({h})) / count_if(truth) AS tpr, 100.0 * count_if(NOT truth AND ({h})) / count_if(NOT truth) AS fpr FROM d" for k, (c, h) in enumerate(zip(CHOSEN, _HELD, strict=True)))
    + ') SELECT pos, "check", round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT *, max((fpr >= 60)::INT) OVER (ORDER BY pos) AS over FROM p) q WHERE pos = 0 OR over = 0',
)


def _covariances(s: SparkSession, lv: DataFrame, pr: DataFrame) -> DataFrame:
    """Covariance of the background errors of each profile and the one of the next uid."""
    from .functions import geo

    one = pr.select("uid", "year", "month", "day", "time", "lat", "lon", (1.0 + F.col("uid") % 3).alias("bgev"))
    two = one.select((F.col("uid") - 1).alias("uid"), *(F.col(c).alias(f"{c}2") for c in ("year", "month", "day", "time", "lat", "lon", "bgev")))
    both = one.join(two, "uid").withColumn("metres", geo.distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / 100.0)
    gap = geo.time_apart(tuple(F.col(c) for c in ("year", "month", "day", "time")), tuple(F.col(f"{c}2") for c in ("year", "month", "day", "time"))) / 2000.0
    return both.select("uid", F.round("metres", 3).alias("metres"), gap.alias("seconds"), F.round(buddy.covariance(F.col("metres"), gap, F.col("bgev"), F.col("bgev2")), 9).alias("covariance"))


_add(
    "buddy_covariances",
    _with(_covariances),
    f"""WITH x AS (SELECT p.uid, p.lat AS lat, p.lon AS lon, q.lat AS a, q.lon AS o, abs(({_WHEN.format('p.')}) - ({_WHEN.format('q.')})) / 2000.0 AS seconds, 1.0 + p.uid % 3 AS va, 1.0 + q.uid % 3 AS vb FROM {{profiles}} p JOIN {{profiles}} q ON q.uid = p.uid + 1),
y AS (SELECT *, {_METRES} / 100.0 AS metres FROM x)
SELECT uid, round(metres, 3) AS metres, seconds, round(sqrt(va / 2 * vb / 2) * ((1 + metres / 100000.0) * exp(-metres / 100000.0 - pow(seconds / 432000.0, 2)) + (1 + metres / 400000.0) * exp(-metres / 400000.0 - pow(seconds / 432000.0, 2))), 9) AS covariance FROM y""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
