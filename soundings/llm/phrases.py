"""Phrases that recur, by Toivonen's method: a sample proposes them, full passes count them exactly.

A text is lower-cased in ``A-Z`` and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words ``[^\\x20\\x09]+``. A phrase is one to
``LONGEST`` words of a piece in a row; it is counted per language, with overlaps.

1. About one document of ``SHARE`` is counted with a lowered threshold; what passes it is proposed.
2. A full pass counts, exactly, all proposed phrases and their negative border: the phrases that are not proposed though both
   their parts without the last and without the first word are (a single word has no such parts, so all words are counted).
3. A phrase of the border that is frequent after all is a failure: phrases around it may not have been counted. Then another full
   pass counts those whose parts are proposed, failures or counted in that same pass, and have not been counted before; so until
   no failure is left open.

Any frequent phrase has only frequent parts, so each one is counted in the end, whatever the sample was; the sample only decides how many
passes it takes.

What is proposed reaches the tasks as a table of ``BITS`` bits by hash, of a fixed size: phrases that share a bit with a proposed one
are counted too, which costs rows but changes no result. Counts are sums by the phrase itself, added up within a batch and within a
task before they are shuffled. Batches are bounded by bytes, a text longer than ``CHUNK`` words is counted in parts that overlap by a
phrase's length.

Null texts are empty, a null language is ``und``. Repeated rows and rows without an id count like any others; the ids only deal out
the sample. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_batch, stored
from .shingles import WordHasher, mix

LONGEST, LEAST, TOP = 5, 100, 2000
SHARE, SAMPLE_LEAST = 8, 6
BITS, CHUNK = 1 << 26, 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE = b"\xff"  # no byte of UTF-8
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def tokens_of(texts: list[str | None]) -> list[bytes]:
    """The words of texts, with ``_EDGE`` between pieces."""
    raw = "\n".join(t for t in texts if t).encode("utf-8", "surrogatepass").lower().translate(_SPLIT)
    return raw.replace(b"\n", b" \xff ").split()


class Proposed:
    """A set of phrases by hash; without a table it holds every phrase."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = table

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(len(h), bool)
        at = h % np.uint64(BITS)
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are a word longer."""
    with np.errstate(over="ignore"):
        return mix(h * _STEP + word)


def hash_of(lang: str, words: list[bytes], hasher: WordHasher) -> np.uint64:
    h = np.array([seed_of(lang)])
    for x in hasher(words):
        h = extend(h, np.array([x]))
    return h[0]


def counts(tokens: list[bytes], starts: int, seed: np.uint64, hasher: WordHasher, now: Proposed, before: Proposed | None, emit: range, follow: int = LONGEST + 1) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases that begin at the first ``starts`` places and their numbers, by length, as far as a pass counts them.

    A phrase is counted if both its parts are in ``now`` and, with ``before``, not both are in that; phrases that no pass has counted
    before are then followed to any length, as are those of ``follow`` words or more. Lengths outside ``emit`` are not counted.
    """
    names = list(dict.fromkeys(tokens))
    number = {x: k for k, x in enumerate(names)}
    code = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    word, edge = hasher(names), number.get(_EDGE, -1)
    at = np.flatnonzero(code != edge)
    gram, h = code.copy(), np.zeros(len(code), np.uint64)
    h[at] = extend(np.full(len(at), seed), word[code[at]])
    if before is None and 1 in emit:
        seen = np.bincount(code[at[at < starts]], minlength=len(names))
        some = np.flatnonzero(seen)
        yield [names[k] for k in some], seen[some]
    live, old = np.zeros(len(code), bool), np.zeros(len(code), bool)
    live[at] = now(h[at])
    if before is not None:
        old[at] = before(h[at])
    for k in range(2, emit.stop):
        fit = live[:-1] & live[1:]
        known = old[:-1] & old[1:] if before is not None else np.zeros(len(fit), bool)
        at = np.flatnonzero(fit[: len(code) - k + 1])
        pair = gram[at] * len(names) + code[at + k - 1]
        distinct, first, back = np.unique(pair, return_index=True, return_inverse=True)
        new = ~known[at]
        if k in emit and len(at):
            seen = np.bincount(back[new & (at < starts)], minlength=len(distinct))
            some = np.flatnonzero(seen)
            yield [b" ".join(tokens[p : p + k]) for p in at[first[some]].tolist()], seen[some]
        gram = np.full(len(code), -1, np.int64)
        gram[at] = back
        h[at] = extend(h[at], word[code[at + k - 1]])
        live, held = np.zeros(len(code), bool), now(h[at])
        live[at] = held | new if before is not None or k >= follow else held
        if before is not None:
            old = np.zeros(len(code), bool)
            old[at] = known[at] & before(h[at])


def _counted(docs: DataFrame, now: Proposed, before: Proposed | None, emit: range, follow: int = LONGEST + 1) -> DataFrame:
    """``key, n``: numbers of the phrases of a pass; the key is the language, a line feed and the phrase, which has none itself.

    The phrase is empty for the number of all words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((now.table, None if before is None else before.table))
    hasher: list[WordHasher] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not hasher:
            hasher.append(WordHasher())
        tables = shared.value
        sets = Proposed(tables[0]), None if before is None else Proposed(tables[1])
        keys, sums = [], []
        by_lang: dict[str, list[str | None]] = {}
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            every, head = tokens_of(texts), lang.encode("utf-8", "surrogatepass") + b"\n"
            for i in range(0, len(every), CHUNK):
                part = every[i : i + CHUNK + LONGEST - 1]
                starts = min(CHUNK, len(part))
                if before is None and 1 in emit:
                    keys.append([head])
                    sums.append(np.array([starts - part[:starts].count(_EDGE)]))
                for names, n in counts(part, starts, seed_of(lang), hasher[0], *sets, emit, follow):
                    keys.append([head + x for x in names])
                    sums.append(n)
        flat = pa.array([x for some in keys for x in some], pa.binary()).cast(pa.string(), safe=False) if keys else pa.array([], pa.string())
        return pa.record_batch([flat, pa.array(np.concatenate([np.zeros(0, np.int64), *sums]).astype(np.int64))], names=["key", "n"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return by_batch(rows, "key string, n long", run, done=hasher.clear).groupBy("key").agg(F.sum("n").alias("n"))


def _hashes(keys: list[str], hasher: WordHasher) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for i, key in enumerate(keys):
        lang, _, phrase = key.rpartition("\n")
        out[i] = hash_of(lang, phrase.encode("utf-8", "surrogatepass").split(b" "), hasher)
    return out


def propose(phrases: DataFrame, onto: Proposed | None = None) -> Proposed:
    """The phrases of a table (``key``) as a set, with those of another one. At most ``BITS / 64`` numbers reach the driver."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = _hashes(b["key"].to_pylist(), WordHasher()) % np.uint64(BITS)
        bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
        return pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["place", "bits"])

    found = by_batch(phrases.select("key"), "place long, bits long", run).groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64) if onto is None or onto.table is None else onto.table.copy()
    table[found["place"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)
    return Proposed(table)


def _not_in(phrases: DataFrame, held: Proposed) -> DataFrame:
    """The rows of a table of phrases that a set does not hold."""
    shared = phrases.sparkSession.sparkContext.broadcast(held.table)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(~Proposed(shared.value)(_hashes(b["key"].to_pylist(), WordHasher()))))

    return by_batch(phrases.select("key", "n"), "key string, n long", run)


def frequent(docs: DataFrame, least: int = LEAST, share: int = SHARE, sample_least: int = SAMPLE_LEAST, note: Callable[[str, int], None] = lambda what, n: None) -> DataFrame:
    """``lang, phrase, words, n`` of every phrase with at least ``least`` occurrences, and of the empty phrase: the number of all words.

    ``note`` hears of the numbers of proposed phrases and of failures of each pass.
    """
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(share)) == 0)
    single = F.length(F.substring_index("key", "\n", -1)) > 0
    short = stored(_counted(sample, Proposed(), None, range(1, 3)).where(F.col("n") >= sample_least).where(single))
    longer = _counted(sample, propose(short), None, range(3, LONGEST + 1), 3).where(F.col("n") >= sample_least)
    proposed = stored(short.unionByName(longer))
    note("proposed", proposed.count())
    now, before = propose(proposed), None
    kept = (F.col("n") >= least) | ~single
    found: list[DataFrame] = []
    while True:
        passed = stored(_counted(docs, now, before, range(1, LONGEST + 1)).where(kept))
        found.append(passed)
        words = F.size(F.split(F.substring_index("key", "\n", -1), " "))
        failed = stored(_not_in(passed.where(single & (words < LONGEST)), now))
        left = failed.count()
        note("failures", left)
        if not left or before is not None:
            # A pass of failures follows new phrases to any length, so nothing around its own failures is left uncounted.
            break
        before, now = now, propose(failed, now)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    phrase = F.substring_index("key", "\n", -1)
    lang = F.substring("key", F.lit(1), F.length("key") - F.length(phrase) - 1)
    return rows.select(lang.alias("lang"), phrase.alias("phrase"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), "n")


def score_of() -> Column:
    """``floor(1000 a total / (l r))``, exactly."""
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("total")), exact("l") * exact("r"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two words or more.

    A cut after k words gives ``l`` and ``r``, the numbers of both parts, and the score ``floor(1000 a n / (l r))``; the lowest one counts, the
    smallest k among equal ones. The products are decimals of 38 digits, so they are exact. Phrases that lie in a longer one which is
    as frequent are dropped: it is enough to look at those a word longer, since all between are then as frequent too.
    """
    every = stored(frequent(docs, least))
    totals = F.broadcast(every.where("words = 0").select("lang", F.col("n").alias("total")))  # a row per language
    single, phrases = every.where("words > 0"), every.where("words > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    inner = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    parts = F.array(inner(1, F.col("words") - 1), inner(2, F.col("words") - 1))
    around = phrases.where("words > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(100) * F.col("a"), F.lit(True))).drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", inner(F.lit(1), F.col("k"))).withColumn("rest", inner(F.col("k") + 1, F.col("words") - F.col("k")))
    left = single.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = single.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    best = both.withColumn("score", score_of()).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
