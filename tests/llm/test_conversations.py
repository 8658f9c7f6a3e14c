"""Repair of conversations against a plain search over whole texts of edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from soundings.llm import conversations as C


def plain(codes):
    """Cheapest cost and least text of edits, by keeping every state's whole texts."""
    best = {0: (0, "")}

    def closed(best):
        for _ in range(3):
            for state, then in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if state in best:
                    x = (best[state][0] + 3, best[state][1] + "I")
                    best[then] = min(best.get(then, x), x)
        return best

    best = closed(best)
    for code in codes:
        new = {}
        for s, (cost, text) in best.items():
            options = [(s, cost + 4, "D")]
            if code != "-":
                more, initial = 3 * code.isupper(), code.lower()
                for letter, then in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s].items():
                    if letter == initial:
                        options.append((then, cost + more, "K"))
                    elif letter != "s":
                        options.append((then, cost + more + 3, "R"))
            for then, c, letter in options:
                x = (c, text + letter)
                new[then] = min(new.get(then, x), x)
        best = closed(new)
    return min(best[s] for s in (0, 3) if s in best)


def whole(table):
    """The whole operator, a conversation at a time."""
    out = {}
    space = " \t\n\x0b\x0c\r"
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(space)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        codes = "".join("-" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "x").upper() if f == "truncated" else c if c in ("s", "u", "a") else "x" for f, c in zip(faults, initials))
        cost, audit = plain(codes)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit == "I":
                last = "a" if last == "u" else "u"
                lines.append(("user" if last == "u" else "assistant") + ":")
                continue
            _, role, text = rows[at]
            at += 1
            if edit == "K":
                last = role[:1]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                last = "a" if last == "u" else "u"
                lines.append(("user" if last == "u" else "assistant") + ":" + text)
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, cost string, `block` int"


def sample(rng):
    texts = ["Yes.", "No", "Why? ", " \t", "", None, "So be it!\n", "Yes.", "ünï"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 14)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.", "clash", 1))
    for turn in range(150):  # a long one with an alternating middle
        rows.append((777, turn, ("user", "assistant")[turn % 2] if turn % 11 else "system", rng.choice(["a.", "b", f"{turn}!"]), None, None))
    return rows + rows[:5]


def test_search_by_nodes_equals_whole_texts():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("suaxSUAX-ua") for _ in range(rng.randint(0, 14)))
        found = [x for x in (C.solve(codes, 0)[0], C.solve(codes, 0)[3]) if x]
        assert min(found) == plain(codes)


def test_blocks_join_to_the_same_repair():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("suaUAx-") for _ in range(rng.randint(1, 40)))
        size = rng.randint(1, 6)
        parts = [[C.solve(codes[i : i + size], s) for s in range(4)] for i in range(0, len(codes), size)]
        out = parts[0]
        for more in parts[1:]:
            out = C.join(out, more)
        assert min(x for x in (out[0][0], out[0][3]) if x) == plain(codes)


def test_first_difference_of_linked_nodes():
    rng = random.Random(3)
    nodes = [(C.Node(), "")]
    for _ in range(400):
        parent, text = rng.choice(nodes[-40:])
        letter = rng.choice("DIKR")
        if text + letter not in {t for _, t in nodes}:
            nodes.append((C.Node(parent, letter), text + letter))
    for _ in range(3000):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        if x != y:
            assert C.before(a, b) == (x < y)


@pytest.mark.parametrize("block,fan", [(2000, 64), (4, 3)])
def test_whole_tables(spark, block, fan):
    rows = sample(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(C.repair(df, block, fan)) == whole([r[:4] for r in rows])


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = rows_of(C.repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 1)], SCHEMA)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, 1, "user", "word " * 400_000 + "end.", "", 1), (1, 2, "assistant", "ok.", "", 1)], SCHEMA)
    got = rows_of(C.repair(df))
    assert got == whole([tuple(r)[:4] for r in df.collect()])
    assert df.where(F.col("conv_id").isNull()).count() == 0
