"""Repair of damaged conversations by cheapest edits, with an audit of them.

The rows of a conversation are taken by turn (nulls first; rows of one turn by role and text). A row's first fault counts: blank (no
character outside white space), duplicate (role and text stood before) or truncated (it ends in none of ``.!?``). A repair gives
every row an edit and may insert turns, so that the roles' initials become ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3,
Delete 4 (blank and duplicate rows have no other), Insert of an empty user or assistant turn 3, and a truncated row that is not
deleted 3. Of the cheapest repairs the one whose initials come first in ASCII order is taken.

What the roles must be next depends only on whether a system, user or assistant turn stands last, so a repair is a walk over four
states, and the best one up to each row and state is kept as a linked node that shares its prefix with all that grow from it. Nodes
carry their ancestors at powers of two and a rolling hash of their initials; of two repairs of one cost, the first difference is found
by a search over ancestors of equal depth. No two nodes have the same initials (initials determine state and parent), so equal
hashes of different nodes are collisions and count as a difference.

Equally dear repairs of the same rows are never prefixes of one another, since a longer one has more inserted turns. So a block of rows
is summed up by its best repair from each state to each, and blocks are joined by adding costs and texts: rows of a long conversation are
solved in blocks of ``BLOCK`` rows by different tasks, and joined ``FAN`` at a time. Only codes of a byte per row take part in this. The
repaired texts of a conversation are hashed in order as they pass, without being held; the audit itself, a character per edit, is the one
thing held whole, as it is a cell of the result.

Nulls of role and text count as a space, as do null ids and turns in the number that decides on damage; a null id is a
conversation of its own. A role without initial fits nowhere. Repeated rows are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import prepare, stored

BLOCK, FAN = 2000, 64
_SPACE = " \t\n\x0b\x0c\r"
_MOD, _BASE = (1 << 61) - 1, 1_000_003
#: States by what stands last: nothing, a system turn, a user turn, an assistant turn. Which initial leads where.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_INSERT = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))


class Node:
    """A repair up to some row: the last edit's initial, and the repair before it at steps of powers of two."""

    __slots__ = ("letter", "depth", "digest", "up")

    def __init__(self, parent: Node | None = None, letter: str = ""):
        self.letter, self.depth, self.digest, self.up = letter, 0, 0, []
        if parent is not None:
            self.depth, self.digest = parent.depth + 1, (parent.digest * _BASE + ord(letter)) % _MOD
            at, k, up = parent, 0, self.up
            up.append(at)
            while len(at.up) > k:
                at = at.up[k]
                up.append(at)
                k += 1

    def at_depth(self, depth: int) -> Node:
        node, rest = self, self.depth - depth
        while rest:
            k = rest.bit_length() - 1
            node = node.up[k]
            rest -= 1 << k
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def same(a: Node, b: Node) -> bool:
    """Whether two nodes of one depth have the same initials: their hashes differ, or else identity decides."""
    return a.digest == b.digest and a is b


def before(a: Node, b: Node) -> bool:
    """Whether the initials of ``a`` come before those of ``b``."""
    depth = min(a.depth, b.depth)
    x, y = a.at_depth(depth), b.at_depth(depth)
    if same(x, y):
        return a.depth < b.depth
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.letter < y.letter


def _offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = (cost, Node(parent, letter))
    elif cost == held[0]:
        node = Node(parent, letter)
        if before(node, held[1]):
            best[state] = (cost, node)


def _inserts(best: list) -> None:
    for state, then in _INSERT:
        if best[state] is not None:
            _offer(best, then, best[state][0] + 3, best[state][1], "I")


def solve(codes: str, state: int) -> list[tuple[int, str] | None]:
    """Cost and initials of the best repair of rows from a state to each of the four; None where there is none.

    A row's code is its role's initial, in upper case if it is truncated; ``-`` for a row that must go.
    """
    best: list = [None] * 4
    best[state] = (0, Node())
    _inserts(best)
    for code in codes:
        own: list = [None] * 4
        more, initial = 3 * code.isupper(), code.lower()
        for s, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _offer(own, s, cost + 4, node, "D")
            if code == "-":
                continue
            for letter, then in _NEXT[s].items():
                if letter == initial:
                    _offer(own, then, cost + more, node, "K")
                elif letter != "s":
                    _offer(own, then, cost + more + 3, node, "R")
        best = own
        _inserts(best)
    return [None if held is None else (held[0], held[1].text()) for held in best]


def join(a: list, b: list) -> list:
    """The sums of two neighbouring blocks, each a list by first state of lists by last state, as that of both."""
    out = []
    for row in a:
        best: list = [None] * 4
        for middle, held in enumerate(row):
            if held is None:
                continue
            for last, more in enumerate(b[middle]):
                if more is not None and (best[last] is None or (held[0] + more[0], held[1] + more[1]) < best[last]):
                    best[last] = (held[0] + more[0], held[1] + more[1])
        out.append(best)
    return out


def _damaged(rows: DataFrame) -> DataFrame:
    """The rows of a table after damage: ``conv_id, turn, role, text``."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"))
    kind = F.pmod(F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")), F.lit(20))
    hurt = base.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


#: Ascending, nulls first.
_ORDER = ("turn", "role", "text")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def coded(rows: DataFrame) -> DataFrame:
    """Each row of damaged conversations in order: ``conv_id, i`` (its place), ``turn, initial, fault, code``."""
    end = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    w = Window.partitionBy("conv_id").orderBy(*_ORDER)
    again = Window.partitionBy("conv_id", "role", "text").orderBy("i")
    marked = rows.select("conv_id", "turn", "role", "text", end.alias("_end")).withColumn("i", F.row_number().over(w) - 1)
    marked = marked.withColumn("_again", F.row_number().over(again) > 1)
    fault = F.when(F.col("_end") == "", "blank").when(F.col("_again"), "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated")
    out = marked.select("conv_id", "i", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), _initial().alias("_known"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("_known")).otherwise(F.col("_known"))
    return out.withColumn("code", code).drop("_known")


def _facts(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the counts of faults, of missing turns and of neighbours whose roles do not follow each other."""
    w = Window.partitionBy("conv_id").orderBy("i")
    step = F.concat(F.lag("initial").over(w), F.col("initial"))
    odd = F.lag("i").over(w).isNotNull() & ~step.isin("su", "ua", "au")
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(w) == F.col("turn"), F.lit(False))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("_new").cast("long")), F.lit(0)).cast("long")
    marked = rows.withColumn("_odd", odd).withColumn("_new", new)
    return marked.groupBy("conv_id").agg(gaps.alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("_odd")).alias("illegal"))


_SUM = "array<array<struct<cost:long,audit:string>>>"


def _packed(found: list) -> list:
    return [[None if x is None else {"cost": x[0], "audit": x[1]} for x in row] for row in found]


def _read(found: list) -> list:
    return [[None if x is None else (x["cost"], x["audit"]) for x in row] for row in found]


def _by_block(df: DataFrame, fn) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
        for b in batches:
            yield pa.record_batch([b["conv_id"], b["block"], pa.array([_packed(fn(x)) for x in b["given"].to_pylist()], kind)], names=["conv_id", "block", "best"])

    return df.mapInArrow(run, f"conv_id long, block long, best {_SUM}")


def _whole(found: list) -> list:
    out = _read(found[0]["best"])
    for more in found[1:]:
        out = join(out, _read(more["best"]))
    return out


def audits(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``conv_id, cost, audit`` of coded rows: blocks are solved apart and joined some at a time, until one is left of each conversation."""
    groups = rows.withColumn("block", F.floor(F.col("i") / block).cast("long")).select("conv_id", "block", "i", "code")
    given = groups.repartition("conv_id", "block").groupBy("conv_id", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]), "").alias("given"))
    found = stored(_by_block(given, lambda codes: [solve(codes, s) for s in range(4)]))
    while not found.where("block > 0").isEmpty():
        parts = found.select("conv_id", F.floor(F.col("block") / fan).cast("long").alias("up"), "block", "best")
        joined = parts.groupBy("conv_id", F.col("up").alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "best"))).alias("given"))
        found = stored(_by_block(joined, _whole))
    ends = F.array_min(F.filter(F.array(*(F.get(F.get("best", F.lit(START)), F.lit(s)) for s in (START, ASSISTANT))), lambda x: x.isNotNull()))
    return found.select("conv_id", ends.alias("_end")).select("conv_id", F.col("_end.cost").alias("cost"), F.col("_end.audit").alias("audit"))


class _Repair:
    """A conversation as its rows pass: which edits are left, which state it is in, and the hash so far."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.some = audit, 0, START, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        if self.some:
            self.digest.update(b"\n")
        self.some = True
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def _turn(self) -> str:
        """The role that is due, which is that of an inserted or reroled turn."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state][role[0]]
            self._line(role, text)
        elif edit == "R":
            self._line(self._turn(), text)

    def done(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


class _Passing(NamedTuple):
    conv_id: int | None
    repair: _Repair


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of the repaired rows, from damaged rows and audits.

    One exchange brings a conversation's audit and then its rows, in order, to one task, which hashes them as they pass: a hash of a
    whole text has no parts that could be computed apart.
    """
    none = F.lit(None)
    audit = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audit.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Passing | None = None
        for b in batches:
            ids, hashes = [], []
            for conv_id, kind, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    if now is not None:
                        ids.append(now.conv_id)
                        hashes.append(now.repair.done())
                    now = _Passing(conv_id, _Repair(text))
                else:
                    now.repair.row(role, text)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now.conv_id], pa.int64()), pa.array([now.repair.done()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(table: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Damage a table of conversations and repair it: a row per original ``conv_id`` with ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``; zeros, no edits and the hash of nothing where damage left no row."""
    rows = _damaged(table)
    codes = stored(coded(rows))
    found = stored(audits(codes, block, fan))
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = dict.fromkeys(numbers, "long") | {"audit": "string", "repaired_sha256": "string"}
    full = lambda df: df.select("conv_id", *(F.col(c) if c in df.columns else empty(c, k) for c, k in kinds.items()))
    every = full(table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    parts = every.unionByName(full(_facts(codes))).unionByName(full(found)).unionByName(full(repaired_hashes(rows, found)))
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in kinds))
