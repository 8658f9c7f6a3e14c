"""Phrase mining against plain counts of every phrase."""

import random
import re
from collections import Counter

import pytest

from soundings.llm import phrases as P


def counted(rows, least):
    found = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                found.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
            found[(lang or "und", "")] += len(words)
    return {k: n for k, n in found.items() if n >= least or (k[1] == "" and n)}


def plain(rows, least, top):
    f = counted(rows, least)
    out = []
    for lang in {k[0] for k in f}:
        own = {p: n for (g, p), n in f.items() if g == lang and p and n >= least}
        n = f[(lang, "")]
        best = []
        for p, a in own.items():
            w = p.split(" ")
            if len(w) < 2 or any(f" {p} " in f" {q} " and 100 * b >= 100 * a for q, b in own.items() if q.count(" ") > p.count(" ")):
                continue
            score, _, left, right = min((1000 * a * n // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k, own[" ".join(w[:k])], own[" ".join(w[k:])]) for k in range(1, len(w)))
            best.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, n long, words string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [a + b for a in ("ka", "Lo", "mi", "é", "x\xa0y") for b in ("po", "ne", "di")]
    stock = [" ".join(rng.choice(words) for _ in range(k)) for k in (2, 3, 4, 5, 6, 9)]
    out = []
    for k in range(160):
        parts = [rng.choice(stock) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\x0b", "\n", "\x00 "]) for p in parts)
        out.append((k, text, rng.choice(["en", "fr", None, "und", "a\nb"]), 1, "x"))
    out += [(None, None, "en", 1, "x"), (500, "", None, 1, "x"), (None, "Lopo " * 3000, "en", 1, "x"), (7, "one, two; three.", "de", 1, "x")]
    return out + out[:3]


def test_frequent_phrases_whatever_the_sample(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = counted([r[1:3] for r in rows], 12)
    notes = []
    for share, sample_least in ((1, 1), (4, 3), (8, 40), (1000, 5)):
        seen = {}
        got = P.frequent(df, 12, share, sample_least, lambda what, n: seen.setdefault(what, []).append(n))  # noqa: B023
        found = [((r["lang"], r["phrase"]), r["n"]) for r in got.collect()]
        assert len(found) == len(dict(found)) and dict(found) == want
        notes.append(seen)
    assert notes[0]["failures"] == [0] and notes[3]["proposed"] == [0] and notes[3]["failures"][0] > 0


def test_collocations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for least, top in ((12, 2000), (8, 5)):
        got = sorted(tuple(r) for r in P.collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain([r[1:3] for r in rows], least, top)


def test_chunks_and_shared_bits(spark, rows, monkeypatch):
    """Long texts in parts, and a table of bits that is full: nothing changes."""
    want = counted([r[1:3] for r in rows], 20)
    hasher = P.WordHasher()
    for size in (7, 64):
        for lang in ("en", "und"):
            every = P.tokens_of([t for _, t, g, *_ in rows if (g or "und") == lang])
            found = Counter()
            for i in range(0, len(every), size):
                part = every[i : i + size + 4]
                for names, n in P.counts(part, min(size, len(part)), P.seed_of(lang), hasher, P.Proposed(), None, range(1, 6)):
                    found.update({x.decode(): int(c) for x, c in zip(names, n, strict=True)})
            assert {p: n for p, n in found.items() if n >= 20} == {p: n for (g, p), n in want.items() if g == lang and p and n >= 20}


def test_exact_scores_and_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    from pyspark.sql import functions as F

    big = spark.range(1).select(F.lit(3_000_000_000_007).alias("a"), F.lit(90_000_000_000_001).alias("total"), F.lit(3_000_000_000_011).alias("l"), F.lit(3_000_000_000_007).alias("r"))
    assert big.select(P.score_of()).first()[0] == 1000 * 3_000_000_000_007 * 90_000_000_000_001 // (3_000_000_000_011 * 3_000_000_000_007)
