"""Secrets found through a trigram inverted index.

1. Each rule's regex is turned into a Boolean query: an OR of alternatives, each an AND of trigrams that every match
   must contain. A rule without mandatory trigrams (a bare character class) has none and scans every document.
2. The index holds a posting (trigram, document) for each trigram that some rule asks for. ``trigram_postings`` gives it as a
   table for use over and over; for one pass, a row carries its own postings as an array.
3. Postings of one document are intersected and tested against the queries, which gives each rule its candidates.
4. Candidates are verified by the regex itself, over the whole text, and their offsets computed.

All of it is built-in DataFrame functions. Some rule scans every text anyway, so index, test and verification work row by row
and nothing is shuffled; postings are a fixed number per document at most.

A null or empty text has no spans. Repeated rows, those without an id and those of one id with other texts each get their own
result; an empty table gives an empty one. Spans of one rule never overlap; those of different rules are all kept and ordered
by start, then by the rules' order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (the same in Python and Java), the group whose length counts and the least length."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base rules, which stay as they are, then those that the method adds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + ADDED_RULES


def _exact(tree) -> set[str] | None:
    """All strings that a piece of a regex can match, lower-cased; None if they are too many."""
    out = {""}
    for op, arg in tree:
        if op is C.LITERAL:
            part: set[str] | None = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            part = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            part = {chr(v).lower() for _, v in arg}
        elif op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            inner = _exact(arg[2])
            part = None if inner is None else {"", *inner}
        else:
            part = None
        if part is None or len(out) * len(part) > _MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, one of which must be there in full (in lower case) for the regex to match at all."""
    best: set[str] | None = None
    run: list = []
    for node in [*_parser.parse(regex), None]:
        if node is not None and _exact([*run, node]) is not None:
            run.append(node)
            continue
        found = _exact(run)
        if found and min(map(len, found)) >= 3 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found
        run = [node] if node is not None and _exact([node]) is not None else []
    if best is None:
        return None
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _once(column: Column) -> Column:
    """A value that is computed once per row, however often it is used later: a projection would be copied to each use."""
    return F.explode(F.array(column))


def _postings(low: Column, rules: tuple[Rule, ...]) -> Column:
    """The trigrams of the rules' queries that a lower-cased text holds."""
    asked = sorted({g for r in rules for c in trigram_query(r.regex) or () for g in c})
    return F.filter(F.array(*map(F.lit, asked)), lambda g: F.contains(low, g))


def _satisfied(held: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds of the rules whose queries the postings of a document satisfy."""
    tests = []
    for r in rules:
        if (query := trigram_query(r.regex)) is not None:
            hit = F.lit(False)
            for clause in query:
                hit |= F.size(F.array_except(F.array(*map(F.lit, sorted(clause))), held)) == 0
            tests.append(F.when(hit, F.lit(r.kind)))
    return F.array_compact(F.array(*tests))


def trigram_postings(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, ``id_col``) for each trigram of the rules' queries that a text holds, whatever its case: the index as a table."""
    low = df.select(F.col(id_col), _once(F.lower(F.col(text_col).cast("string"))).alias("_low"))
    return low.select(id_col, F.explode(_postings(F.col("_low"), rules)).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, rules array<string>): the documents whose postings satisfy each rule's query."""
    held = postings.groupBy(id_col).agg(F.collect_set("trigram").alias("_held"))
    return held.select(id_col, _satisfied(F.col("_held"), rules).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule with their offsets in code points: the pieces between matches tell where each one starts."""
    grown = rule.group == 0 and rule.regex.endswith("+")  # one greedy run: the least length can be asked of the regex
    tail = re.search(r"^(.*?)(\[[^]]*\])\+$", rule.regex) if grown else None
    regex = rule.regex
    if tail and re.fullmatch(r"[A-Za-z]*", tail[1]):
        regex = f"{tail[1]}{tail[2]}{{{rule.least - len(tail[1])},}}"
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)), F.length) if rule.group else F.transform(hits, F.length)
    gaps = F.transform(F.split(text, regex, -1), F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("size"), sizes.alias("counted"))
    span = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("rank"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("out"))
    walk = F.aggregate(
        steps,
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["counted"] >= rule.least, F.concat(acc["out"], F.array(span(acc, x)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(hits) > 0, walk)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans array<struct<start,rank,end,kind>>`` ordered by start and rule, one row per input row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    low = docs.select("id", "text", _once(F.lower("text")).alias("low"))
    held = low.select("id", "text", _once(_postings(F.col("low"), rules)).alias("held"))
    found = held.select("id", "text", _once(_satisfied(F.col("held"), rules)).alias("rules"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(F.col("text"), r, i)
        if trigram_query(r.regex) is not None:
            spans = F.when(F.array_contains("rules", r.kind), spans)
        parts.append(F.coalesce(spans, none))
    return found.select(F.col("id").alias(id_col), _once(F.array_sort(F.concat(*parts))).alias("spans"))


def secrets_digest(df: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and the list of all spans."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(df).select(
        "doc_id",
        *(count(r.kind) for r in BASE_RULES),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )
