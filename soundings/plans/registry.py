"""Checks by name: built in or registered, run over levels, profiles and reference tables.

Some checks use others or share a pass with them. A run builds such shared results as nodes, each once: the pass over whole
profiles (e03 to e05, e07 and e09 need it), the pass over neighbours, the background comparison (e07, e09), the flags of single
checks that others take in. What more than one of the requested checks needs is cached; the rest is part of one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buddy, gridded, local, sequential, track

#: What a check may ask for: reference tables, and parameters that go with them.
Refs = Mapping[str, object]
Check = Callable[[DataFrame, DataFrame, Refs], DataFrame]
LEVELS = ("level", "profile", "track")
_CHECKS: dict[str, tuple[Check, str]] = {}
#: Outputs of the pass over whole profiles, by check.
SEQUENTIAL = {"e03_spike_and_step": "reject", "e04_spike_and_step_suspect": "suspect", "e05_increasing_depth": "disorder"}


#: The checks that the check of standard levels takes in, besides the passes named below.
PRIOR = ("e01_range", "e02_constant_value", "e06_stability")
#: Checks made of other results, and which: passes ("neighbours", "sequential", "background") or checks.
DERIVED: dict[str, tuple[str, ...]] = {"e07_background": ("background",), "e09_standard_levels_and_buddies": ("background", "sequential", *PRIOR)}
PASSES: dict[str, tuple[str, ...]] = {"neighbours": (), "sequential": (), "background": ("sequential",)}


def register_check(name: str, fn: Check, level: str = "level") -> None:
    """Add a check: ``fn(levels, profiles, refs)`` gives ``uid, lev, flag``, or ``uid, flag`` if it judges whole profiles
    (``level`` is then "profile", or "track" if it compares the profiles of a cruise)."""
    if name in _CHECKS:
        raise ValueError(f"check {name} is registered already")
    if level not in LEVELS:
        raise ValueError(f"a check judges one of {LEVELS}")
    _CHECKS[name] = (fn, level)


def _refs(refs: Refs, *names: str) -> list:
    if missing := [n for n in names if n not in refs]:
        raise KeyError(f"missing reference data: {missing}")
    return [refs[n] for n in names]


def _built_in() -> None:
    for name in local.NAMES:
        register_check(name, lambda lv, pr, refs, n=name: local.run(n, lv, pr))
    for name in (*SEQUENTIAL, *DERIVED):
        register_check(name, lambda lv, pr, refs, n=name: CheckRun(lv, pr, [n], refs).flags_of(n))
    register_check("i05_stuck_value", lambda lv, pr, refs: sequential.stuck_value(lv, pr))
    for name, most in (("a05_climatology", 5.0), ("t11_climatology_bias", 3.0), ("t12_climatology_bias_wide", 6.0)):
        register_check(name, lambda lv, pr, refs, m=most: gridded.climatology(lv, pr, *_refs(refs, "climatology"), m))
    register_check("r05_regional_range", lambda lv, pr, refs: gridded.regional_range(lv, pr))
    register_check("t06_envelope", lambda lv, pr, refs: gridded.envelope(lv, *_refs(refs, "envelope")))
    for name, reach in (("t14_land", 0), ("o05_land_around", 2)):
        register_check(name, lambda lv, pr, refs, k=reach: gridded.at_sea(lv, pr, *_refs(refs, "relief"), *_refs(refs, "relief_axes")[0], reach=k))
    register_check("o01_below_bottom", lambda lv, pr, refs: gridded.below_bottom(lv, pr, *_refs(refs, "relief"), *_refs(refs, "relief_axes")[0]))
    register_check("t15_anomaly", lambda lv, pr, refs: gridded.anomaly(*gridded.features(lv), *_refs(refs, "laws")))
    register_check("t16_fuzzy", lambda lv, pr, refs: gridded.fuzzy(*gridded.features(lv), *_refs(refs, "memberships")))
    register_check("t17_fuzzy_narrow", lambda lv, pr, refs: gridded.fuzzy(*gridded.features(lv), *_refs(refs, "narrow_memberships")))
    register_check("e08_background_available", lambda lv, pr, refs: gridded.background_available(lv, pr, *_refs(refs, "background")))
    register_check("e10_track", lambda lv, pr, refs: track.track_check(track.dated(pr)), "track")
    register_check("i09_local_climatology", lambda lv, pr, refs: gridded.local_climatology(lv, pr, *_refs(refs, "monthly", "annual", "depth_edges")))
    register_check("i10_two_bin_climatology", lambda lv, pr, refs: gridded.two_bin_climatology(lv, pr, *_refs(refs, "monthly_ranges", "annual_ranges", "depth_edges")))
    register_check("o04_region_range", lambda lv, pr, refs: gridded.region_range(lv, pr, *_refs(refs, "regions", "region_ranges")))
    register_check("o06_min_max", lambda lv, pr, refs: gridded.min_max(lv, pr, *_refs(refs, "cells", "cell_ranges")))



def names() -> list[str]:
    return sorted(_CHECKS)


class CheckRun:
    """One run of some checks: its nodes, made on demand and once each.

    ``release`` lets go of what has been cached, when the flags have been used.
    """

    def __init__(self, levels: DataFrame, profiles: DataFrame, checks: Sequence[str], refs: Refs | None = None):
        if unknown := [c for c in checks if c not in _CHECKS]:
            raise KeyError(f"unknown checks: {unknown}")
        self.levels, self.profiles, self.refs = levels, profiles, refs or {}
        self.checks = list(dict.fromkeys(checks))
        wanted = dict.fromkeys(self.checks)
        for c in self.checks:
            wanted |= dict.fromkeys(x for x in DERIVED.get(c, ()) if x not in PASSES)
        self.near = tuple(c for c in wanted if c in local.LOCAL)
        self.uses = self._uses()
        self._made: dict[str, DataFrame] = {}
        self._cached: list[DataFrame] = []

    def needs(self, name: str) -> tuple[str, ...]:
        """The nodes that a node is made of."""
        if name in PASSES:
            return PASSES[name]
        if name in DERIVED:
            return DERIVED[name]
        return ("sequential",) if name in SEQUENTIAL else ("neighbours",) if name in self.near else ()

    def _uses(self) -> dict[str, int]:
        """How many nodes, or the result, use each node; checks of one pass that are asked for count as one use of it."""
        uses: dict[str, int] = {}
        seen: set[str] = set()

        def visit(name: str) -> None:
            if name not in seen:
                seen.add(name)
                for x in self.needs(name):
                    uses[x] = uses.get(x, 0) + 1
                    visit(x)

        for name in (c for c in self.checks if c not in self.near and c not in SEQUENTIAL):
            uses[name] = uses.get(name, 0) + 1
            visit(name)
        for one_pass, asked in (("neighbours", self.near), ("sequential", SEQUENTIAL)):
            if any(c in asked for c in self.checks):
                uses[one_pass] = uses.get(one_pass, 0) + 1
                visit(one_pass)
        return uses

    def node(self, name: str) -> DataFrame:
        """The table of a node; cached if the run uses it more than once."""
        if name not in self._made:
            made = self._make(name)
            if self.uses.get(name, 0) > 1:
                made = made.persist()
                self._cached.append(made)
            self._made[name] = made
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name == "neighbours":
            return local.run_local(self.levels, self.profiles, self.near)
        if name == "sequential":
            return sequential.sequential_flags(self.levels, self.profiles)
        if name == "background":
            return gridded.background(self.levels, self.profiles, *_refs(self.refs, "background"), self.node("sequential"))
        if name == "e07_background":
            return self.node("background").select("uid", "lev", "flag")
        if name == "e09_standard_levels_and_buddies":
            grid, depths = _refs(self.refs, "background", "standard_depths")
            near, found = self.node("background"), self.node("sequential")
            prior = buddy.union_of_prior(near, found, [self.flags_of(c) for c in PRIOR])
            return buddy.standard_level_check(self.levels, self.profiles, grid, depths, near=near, prior=prior)
        if name in self.near:
            return self.node("neighbours").select("uid", "lev", F.col(name).alias("flag"))
        if name in SEQUENTIAL:
            return self.node("sequential").select("uid", "lev", F.col(SEQUENTIAL[name]).alias("flag"))
        fn, level = _CHECKS[name]
        flags = fn(self.levels, self.profiles, self.refs)
        if level != "level":
            whole = flags.groupBy("uid").agg(F.bool_or("flag").alias("flag"))
            flags = self.levels.select("uid", "lev").join(whole, "uid", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
        return flags.select("uid", "lev", "flag")

    def flags_of(self, name: str) -> DataFrame:
        """``uid, lev, flag`` of one check."""
        return self.node(name)

    def flags(self) -> DataFrame:
        """Long flags of the checks that were asked for."""
        parts = [self.levels.sparkSession.createDataFrame([], "uid long, lev int, check string, flag boolean")]
        near, stepwise = [c for c in self.checks if c in self.near], [c for c in self.checks if c in SEQUENTIAL]
        if near:
            parts.append(self.node("neighbours").select("uid", "lev", *near).unpivot(["uid", "lev"], near, "check", "flag"))
        if stepwise:
            found = self.node("sequential").select("uid", "lev", *(F.col(SEQUENTIAL[c]).alias(c) for c in stepwise))
            parts.append(found.unpivot(["uid", "lev"], stepwise, "check", "flag"))
        for name in self.checks:
            if name not in near and name not in stepwise:
                parts.append(self.flags_of(name).select("uid", "lev", F.lit(name).alias("check"), "flag"))
        return reduce(DataFrame.unionByName, parts)

    def release(self) -> None:
        while self._cached:
            self._cached.pop().unpersist()


def run_checks(levels: DataFrame, profiles: DataFrame, checks: Sequence[str], refs: Refs | None = None) -> DataFrame:
    """Long flags ``uid, lev, check, flag``; none for an empty list of checks.

    Neighbour checks share one window pass, those of whole profiles one pass over these, and checks that use others take their results
    from the same run. Shared results stay cached; a ``CheckRun`` can release them.
    """
    return CheckRun(levels, profiles, checks, refs).flags()


_built_in()
