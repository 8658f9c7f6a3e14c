"""Choosing combinations of checks, on a small table of decision patterns.

Profiles fold to distinct (truth, decisions) patterns with counts: one shuffle of partial sums, whatever the number of
profiles. Every round of a search is then one aggregate over the cached patterns that evaluates all candidates; only
rates reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import levelmaps


#: Of how many checks all sets may be rated: there are two to that power.
MOST_CHECKS = 24
#: How many checks one round of the sums over supersets deals with.
BITS_A_ROUND = 4
#: Of how many checks all partitions may be listed: 1.4 billion, spread over tasks by their numbers.
MOST_PARTED = 15


def patterns(decisions: DataFrame, checks: Sequence[str], truth: str = "truth") -> DataFrame:
    """``truth, mask, n``: bit k of the mask is the decision of check k (63 checks at most)."""
    if len(checks) > 63:
        raise ValueError("a mask holds 63 checks at most")
    mask = reduce(lambda a, b: a + b, (F.when(F.col(c), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(checks)))
    return decisions.select(F.col(truth).alias("truth"), mask.alias("mask")).groupBy("truth", "mask").agg(F.count("*").alias("n"))


def combine(partition: Sequence[Sequence[Column]], inner_and: bool = True) -> Column:
    """OR of ANDs of decision columns, or AND of ORs."""
    both, either = (lambda a, b: a & b), (lambda a, b: a | b)
    inner, outer = (both, either) if inner_and else (either, both)
    return reduce(outer, (reduce(inner, group) for group in partition))


def combination_label(partition: Sequence[Sequence[int]], inner_and: bool = True) -> str:
    inner, outer = (" AND ", " OR ") if inner_and else (" OR ", " AND ")
    return outer.join(f"({inner.join(map(str, g))})" if len(g) > 1 else str(g[0]) for g in partition)


def formula(text: str) -> Column:
    """The decision of a stored formula: terms joined by ``|``, each of checks joined by ``&``."""
    return combine([[F.col(c) for c in term.split("&")] for term in text.split("|")])


def inverted(decisions: DataFrame, checks: Sequence[str]) -> DataFrame:
    """The table with a negated copy of each check, its name led by ``r``."""
    return decisions.select("*", *((~F.col(c)).alias(f"r{c}") for c in checks))


def search_table(decisions: DataFrame, checks: Sequence[str], with_inverted: bool = False) -> tuple[DataFrame, list[str]]:
    """The pattern table of a search and the names of its checks, if asked for with their inverted copies."""
    names = [*checks, *(f"r{c}" for c in checks if with_inverted)]
    return patterns(inverted(decisions, checks) if with_inverted else decisions, names), names


def subsets(spark, n: int, size: int | None = None) -> DataFrame:
    """``subset``: all non-empty sets of n checks as masks, or those of one size."""
    found = spark.range(1, 1 << n).withColumnRenamed("id", "subset")
    return found if size is None else found.where(F.bit_count("subset") == size)


def superset_sums(table: DataFrame, n: int, bits: int = BITS_A_ROUND) -> DataFrame:
    """``mask, bad, good``: for each set of ``n`` checks the profiles that all of its checks flag; sets of none are left out.

    A zeta transform over supersets: a round deals with a few checks, each row adding its counts to the sets that lack some of
    these. So all sets are summed by ``n / bits`` aggregates of at most two to the ``n`` rows, instead of every set meeting every pattern.
    """
    count = lambda bad: F.sum(F.when(F.col("truth") == bad, F.col("n")).otherwise(0))
    now = table.groupBy(F.col("mask").bitwiseAND(F.lit((1 << n) - 1)).alias("mask")).agg(count(True).alias("bad"), count(False).alias("good"))
    for low in range(0, n, bits):
        width = min(bits, n - low)
        taken = F.sequence(F.lit(0), F.lit((1 << width) - 1))
        own = F.shiftright("mask", low).bitwiseAND(F.lit((1 << width) - 1))
        lacking = F.transform(F.filter(taken, lambda x: x.bitwiseAND(own) == x), lambda x: F.col("mask") - x.cast("long") * F.lit(1 << low))
        now = now.select(F.explode(lacking).alias("mask"), "bad", "good").groupBy("mask").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return now


def _totals(table: DataFrame) -> list[Column]:
    """The numbers of bad and of good profiles, as scalar subqueries."""
    count = lambda bad: F.sum(F.when(F.col("truth") == bad, F.col("n")).otherwise(0)).alias("n")
    return [table.agg(count(bad)).scalar() for bad in (True, False)]


def subset_rates(table: DataFrame, n: int, size: int | None = None) -> DataFrame:
    """``subset, size, tpr, fpr`` of the AND of each set of ``n`` checks, at most ``MOST_CHECKS``, from one sum over supersets."""
    if n > MOST_CHECKS:
        raise ValueError(f"the sets of more than {MOST_CHECKS} checks are too many; search them by grow_roc")
    sums = superset_sums(table, n).withColumnRenamed("mask", "subset")
    bad, good = _totals(table)
    rate = lambda c, of: F.try_divide(100.0 * F.coalesce(F.col(c), F.lit(0)), of)
    rated = subsets(table.sparkSession, n, size).join(sums, "subset", "left")
    return rated.select("subset", F.bit_count("subset").alias("size"), rate("bad", bad).alias("tpr"), rate("good", good).alias("fpr"))


def _completions(n: int) -> list[list[int]]:
    """How many ways ``r`` more checks can be dealt when there are ``m`` groups: rows r, columns m (a Bell triangle)."""
    rows = [[1] * (n + 1)]
    for _ in range(n):
        last = rows[-1]
        rows.append([m * last[m] + last[m + 1] for m in range(len(last) - 1)])
    return rows


def partitions(spark, n: int, sizes: Sequence[int] | None = None) -> DataFrame:
    """``id, groups``: every way to part ``n`` checks into groups, each group as a mask, in order of its first check.

    A partition is the string of its checks' group numbers, in which a new number is one above the largest so far; the ``id``-th
    such string is made from the number alone, so the rows need no search and spread over tasks. With ``sizes`` only those whose
    groups have these sizes, in any order.
    """
    if not 1 <= n <= MOST_PARTED:
        raise ValueError(f"partitions of 1 to {MOST_PARTED} checks only")
    ways = _completions(n)
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in [*row, *[0] * (n + 2 - len(row))])) for row in ways))

    def deal(held: Column, check: Column) -> Column:
        used, rest = F.size(held["groups"]), F.lit(n - 1) - check
        each = F.get(F.get(table, rest), used)
        group = F.least(F.floor(held["left"] / each), used.cast("long")).cast("int")
        own = F.call_function("shiftleft", F.lit(1).cast("long"), check)
        groups = F.when(group < used, F.transform(held["groups"], lambda g, k: F.when(k == group, g + own).otherwise(g))).otherwise(F.concat(held["groups"], F.array(own)))
        return F.struct((held["left"] - group * each).alias("left"), groups.alias("groups"))

    start = F.struct(F.col("id").alias("left"), F.array(F.lit(1).cast("long")).alias("groups"))
    checks = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    dealt = F.aggregate(checks, start, deal, lambda x: x["groups"])
    found = spark.range(ways[n - 1][1]).select("id", dealt.alias("groups"))
    if sizes is None:
        return found
    return found.where(F.sort_array(F.transform("groups", lambda g: F.bit_count(g))) == F.array(*(F.lit(x) for x in sorted(sizes))))


def partition_rates(table: DataFrame, n: int, sizes: Sequence[int] | None = None) -> DataFrame:
    """``partition, groups, tpr, fpr``: rates of the OR over groups of the AND of their checks, for every partition of ``n`` checks.

    Patterns meet partitions by equal masks of groups: a pattern has the groups that are sets of its checks, so nothing is paired
    that does not hit. A partition that a pattern hits by several groups counts it once.
    """
    base = table.groupBy("truth", F.col("mask").bitwiseAND(F.lit((1 << n) - 1)).alias("mask")).agg(F.sum("n").alias("n"))
    held = partitions(table.sparkSession, n, sizes)
    inside = F.filter(F.sequence(F.lit(1).cast("long"), F.lit((1 << n) - 1).cast("long")), lambda x: x.bitwiseAND(F.col("mask")) == x)
    by_group = base.where("mask <> 0").select("truth", "mask", "n", F.explode(inside).alias("group"))
    hits = held.select("id", F.explode("groups").alias("group")).join(by_group, "group").groupBy("id", "truth", "mask").agg(F.first("n").alias("n"))
    count = lambda bad: F.sum(F.when(F.col("truth") == bad, F.col("n")).otherwise(0))
    sums = hits.groupBy("id").agg(count(True).alias("bad"), count(False).alias("good"))
    bad, good = _totals(table)
    rate = lambda c, of: F.try_divide(100.0 * F.coalesce(F.col(c), F.lit(0)), of)
    members = lambda g: F.array_join(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.getbit(g, k) == 1), "&")
    return held.join(sums, "id", "left").select(F.array_join(F.transform("groups", members), "|").alias("partition"), F.size("groups").alias("groups"), rate("bad", bad).alias("tpr"), rate("good", good).alias("fpr"))


def cost(ratio: tuple[float, float], tpr: float, fpr: float) -> float:
    """Distance from the ideal corner along two directions, blended by the TPR."""
    parts = [(100.0 - tpr) * math.cos(a) + fpr * math.sin(a) for a in map(math.atan, ratio)]
    return (100.0 - tpr) / 100.0 * parts[0] + tpr / 100.0 * parts[1]


def cost_column(ratio: tuple[float, float], tpr: Column, fpr: Column) -> Column:
    parts = [(100.0 - tpr) * F.cos(F.atan(F.lit(float(r)))) + fpr * F.sin(F.atan(F.lit(float(r)))) for r in ratio]
    return (100.0 - tpr) / 100.0 * parts[0] + tpr / 100.0 * parts[1]


Candidate = tuple[str, int]  # a name of checks joined by & and the mask that its AND needs


def _evaluate(table: DataFrame, chosen: list[int], masks: Iterable[int]) -> list[tuple[float, float]]:
    """(TPR, FPR) of the chosen masks together with each candidate, in one aggregate."""
    masks = list(masks)
    hit = lambda m: (F.col("mask").bitwiseAND(F.lit(m)) == m)
    held = reduce(lambda a, b: a | b, map(hit, chosen), F.lit(False))
    cells = []
    for k, m in enumerate(masks):
        for bad, c in ((True, "t"), (False, "f")):
            cells.append(F.sum(F.when((held | hit(m)) & (F.col("truth") == bad), F.col("n")).otherwise(0)).alias(f"{c}{k}"))
    totals = [F.sum(F.when(F.col("truth") == bad, F.col("n")).otherwise(0)).alias(c) for bad, c in ((True, "p"), (False, "q"))]
    r = table.agg(*cells, *totals).first()
    share = lambda x, of: 100.0 * (x or 0) / of if of else 0.0
    return [(share(r[f"t{k}"], r["p"]), share(r[f"f{k}"], r["q"])) for k in range(len(masks))]


def pairings(table: DataFrame, names: Sequence[str], rounds: int = 1) -> list[Candidate]:
    """Checks and their ANDs: each round joins all pairs so far; those without a true positive are left out."""
    found: dict[str, int] = {n: 1 << k for k, n in enumerate(names)}
    for _ in range(min(rounds, 2)):
        new: dict[str, int] = {}
        held = list(found)
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                name = "&".join(sorted(f"{a}&{b}".split("&")))
                if name not in found and name not in new:
                    new[name] = found[a] | found[b]
        for at in range(0, len(new), 200):
            part = list(new.items())[at : at + 200]
            found |= {n: m for (n, m), (tpr, _) in zip(part, _evaluate(table, [], [m for _, m in part]), strict=True) if tpr > 0}
    return list(found.items())


def _pick(scored: list[tuple[Candidate, float, float]], ratio, now: tuple[float, float], ceiling: float, gain: float):
    best, key = None, (ceiling, 0.0, math.inf)
    for candidate, tpr, fpr in scored:
        c, d, size = cost(ratio, tpr, fpr), tpr - now[0], candidate[0].count("&") + 1
        if c <= key[0] and d >= gain and d > 0 and (c < key[0] or d > key[1] or (d == key[1] and size < key[2])):
            best, key = (candidate, tpr, fpr), (c, d, size)
    return best


def grow_roc(table: DataFrame, candidates: list[Candidate], ratio=(2.5, 1.0), gain: float = 0.0, groups: dict[str, list[str]] | None = None, ordered: bool = False) -> list[dict]:
    """Greedy growth of an OR of candidates: ``pos, check, tpr, fpr, enforced`` for each choice.

    With ``groups``, one check of each group comes first: the cheapest over all groups that remain, or, if ``ordered``,
    the cheapest of each group in turn, as long as it gains enough. The table should be cached.
    """
    chosen: list[int] = []
    now, out, left = (0.0, 0.0), [], list(candidates)

    def take(best, enforced: bool) -> None:
        nonlocal now
        candidate, tpr, fpr = best
        chosen.append(candidate[1])
        left.remove(candidate)
        now = (tpr, fpr)
        out.append({"pos": len(out), "check": candidate[0], "tpr": tpr, "fpr": fpr, "enforced": enforced})

    def scored(pool: list[Candidate]) -> list[tuple[Candidate, float, float]]:
        return [(c, *r) for c, r in zip(pool, _evaluate(table, chosen, [m for _, m in pool]), strict=True)] if pool else []

    waiting = dict(groups or {})
    while waiting:
        names = list(waiting)[:1] if ordered else list(waiting)
        pool = [c for g in names for n in waiting[g] for c in left if c[0] == n]
        found = min(scored(pool), key=lambda x: cost(ratio, x[1], x[2]), default=None)
        if found is None:
            for g in names:
                del waiting[g]
            continue
        group = next(g for g in names if found[0][0] in waiting[g])
        del waiting[group]
        if not ordered or (found[1] - now[0] >= gain and found[1] > now[0]):
            take(found, True)
    ceiling = cost(ratio, *now)
    while left and (best := _pick(scored(left), ratio, now, ceiling, gain)):
        ceiling = cost(ratio, best[1], best[2])
        take(best, False)
    return out


def grow_by_levels(levels: DataFrame, checks: Sequence[str], groups: dict[str, list[str]] | None = None, steps: Sequence[tuple[str, str]] = (), ratio=(2.5, 1.0), gain: float = 0.0, pad: int = 2, most: int | None = None) -> list[dict]:
    """Growth by levels: ``pos, check, tpr, fpr, enforced`` for each choice, ``most`` of them if given.

    After each choice the levels that it flags are removed (for expendable probes all below, with ``pad`` levels around), and
    the next check is rated on what is left. A check of each group comes first, in order; then any, as long as its cost is not above
    that of doing nothing and its TPR is at least ``gain``. Checks that flag all or no profiles are left out. ``levels`` has a
    column per check, ``uid``, ``lev``, ``truth`` and ``probe``; ``steps`` are rules that hold from the start.

    Levels are packed once, a bit set per level; a round is a scan of the packed profiles that makes a small table of patterns.
    """
    number = {c: k for k, c in enumerate(dict.fromkeys([*checks, *(c for c, _ in steps)]))}
    packed = levelmaps.pack(levels, list(number)).cache()
    state = packed
    for check, rule in steps:
        state = levelmaps.remove(state, number[check], rule, pad, xbt_below=True)
    names = [c for c in checks if c not in {c for c, _ in steps}]
    out: list[dict] = []
    waiting = list((groups or {}).items())
    try:
        while most is None or len(out) < most:
            group, pool = waiting.pop(0) if waiting else (None, list(checks))
            scored = []
            if names:
                bits = [1 << number[n] for n in names]
                found = _evaluate(levelmaps.patterns(state, sum(bits)), [], bits)
                scored = [(n, tpr, fpr) for n, (tpr, fpr) in zip(names, found, strict=True) if n in pool and (tpr, fpr) not in ((0.0, 0.0), (100.0, 100.0))]
            best = min(scored, key=lambda x: cost(ratio, x[1], x[2]), default=None)
            if best and group is None and (cost(ratio, 0.0, 0.0) < cost(ratio, best[1], best[2]) or best[1] < gain):
                best = None
            if best and cost(ratio, best[1], best[2]) < cost(ratio, 0.0, 100.0):
                names.remove(best[0])
                state = levelmaps.remove(state, number[best[0]], "levels", pad, xbt_below=True)
                out.append({"pos": len(out), "check": best[0], "tpr": best[1], "fpr": best[2], "enforced": group is not None})
            elif group is None:
                break
    finally:
        packed.unpersist()
    return out


def roc_points(table: DataFrame, chosen: list[Candidate]) -> list[tuple[float, float]]:
    """(TPR, FPR) after each choice, from one aggregate with a prefix per point."""
    hit = lambda m: (F.col("mask").bitwiseAND(F.lit(m)) == m)
    cells, held = [], F.lit(False)
    for k, (_, m) in enumerate(chosen):
        held = held | hit(m)
        cells += [F.sum(F.when(held & (F.col("truth") == bad), F.col("n")).otherwise(0)).alias(f"{c}{k}") for bad, c in ((True, "t"), (False, "f"))]
    r = table.agg(*cells, *(F.sum(F.when(F.col("truth") == bad, F.col("n")).otherwise(0)).alias(c) for bad, c in ((True, "p"), (False, "q")))).first()
    return [(100.0 * r[f"t{k}"] / (r["p"] or 1), 100.0 * r[f"f{k}"] / (r["q"] or 1)) for k in range(len(chosen))]


def cover(table: DataFrame, names: Sequence[str], least: float = 2.0) -> dict:
    """A set of checks and pairs that flags every bad profile that any of them flags.

    Checks without false positives come first. Then, round by round, a combination that alone flags some pattern of bad
    profiles is accepted, or else the one of highest FPR dropped. Patterns that nothing flags are counted as missed.
    """
    single = [(n, 1 << k) for k, n in enumerate(names)]
    scored = [(c, *r) for c, r in zip(single, _evaluate(table, [], [m for _, m in single]), strict=True)]
    scored = [s for s in scored if s[1] > 0 and (s[2] == 0 or s[1] / s[2] >= least)]
    accepted = [c for c, tpr, fpr in scored if fpr == 0]
    pool = [c for c, _, fpr in scored if fpr > 0]
    combos = pool + [(f"{a[0]}&{b[0]}", a[1] | b[1]) for i, a in enumerate(pool) for b in pool[i + 1 :]]
    rated = sorted(((c, *r) for at in range(0, len(combos), 200) for c, r in zip(combos[at : at + 200], _evaluate(table, [], [m for _, m in combos[at : at + 200]]), strict=True)), key=lambda x: x[2])
    free = lambda chosen: reduce(lambda a, c: a & (F.col("mask").bitwiseAND(F.lit(c[1])) != c[1]), chosen, F.col("truth"))
    usable = lambda pool: reduce(lambda a, c: a + (F.col("mask").bitwiseAND(F.lit(c[1])) == c[1]).cast("int"), pool, F.lit(0))
    every = accepted + [c for c, *_ in rated]
    missed = table.where(free(every)).agg(F.sum("n")).first()[0] or 0
    live = [c for c, *_ in rated]
    while live:
        open_rows = table.where(free(accepted) & (usable(live) > 0))
        if open_rows.isEmpty():
            break
        lone = open_rows.where(usable(live) == 1).orderBy("mask").first()
        if lone is None:
            live.pop()
            continue
        winner = next(c for c in live if lone["mask"] & c[1] == c[1])
        accepted.append(winner)
        live.remove(winner)
    return {"tests": [n for n, _ in accepted], "missed": missed}
