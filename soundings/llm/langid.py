"""Language of words and documents by a linear-chain conditional random field.

Each word has hashed affix and character n-gram features and lexicon features, the n-grams at every offset; a run of more
than ``PIECE`` letters, as in text without spaces, is cut into pieces of that many, each a word of its own; a learned transition matrix joins
neighbouring words, so a code-switched text gets a label per word by forward-backward. A document's language is the
label with the largest mean posterior over all of its words, and that mean is its score. Whether its language is recognised
at all is told by how many of its words' runs of ``RUN`` letters the labelled sample has, in whatever language: this does not depend
on how many languages there are, nor on how alike, and is high for a text in several of them too.

The model is fitted on the driver from a bounded sample of labelled documents (``SAMPLE_DOCS`` documents
in equal parts per language, at least one of each, chosen by a hash of their id; of a text of more than ``SAMPLE_CHARS``
characters a run of words of that size); nothing else is bounded.
Training sequences join runs of words from different documents, so that the transitions see language changes.

Prediction runs batch by batch without a shuffle. The words of a batch are one long chain whose links between documents
carry no information; the chain is cut into blocks whose transfer matrices are multiplied for all blocks at once, so a
very long document costs no more per word than a short one.

A text that is null or has no letter is ``und`` with score 0. With no labelled document at all, every text is ``und``.
Equal posteriors go to the first language in alphabetical order. Repeated rows are predicted each on their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_batch

SAMPLE_DOCS, SAMPLE_CHARS = 1600, 20_000
PIECE, RUN = 24, 4
_BUCKETS, _WIDTH = 1 << 15, 9 + PIECE - 1 + PIECE - 2
_WORD = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")
_BLOCK, _RESCALE, _CHAIN = 128, 16, 1_500_000
_CACHE_WORDS, _AT_ONCE = 150_000, 20_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, in pieces of at most ``PIECE``; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature numbers of distinct words: the bias, lexicon language, hashed affixes, n-grams and the word itself."""
    n, base, none = len(words), 1, 1 + _BUCKETS
    chars = np.array(words, f"<U{PIECE}").view(np.uint32).reshape(n, PIECE).astype(np.uint64)
    size = np.count_nonzero(chars, axis=1)
    every = np.arange(n)
    out = np.full((n, _WIDTH), none, np.int64)
    out[:, 0] = 0
    out[:, 1] = [none if (k := lexicon.get(w)) is None else none + 1 + k for w in words]

    def hashed(salt: int, *columns: np.ndarray) -> np.ndarray:
        h = np.full(n, salt, np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return base + (h % np.uint64(_BUCKETS)).astype(np.int64)

    ends = [chars[every, np.maximum(size - k, 0)] for k in (1, 2, 3)]
    for k in (1, 2, 3):
        out[:, 1 + k] = hashed(10 + k, *(chars[:, i] for i in range(k)))
        out[:, 4 + k] = hashed(20 + k, *ends[:k])
    out[:, 8] = hashed(30, *(chars[:, i] for i in range(PIECE)))
    for i in range(min(PIECE, int(size.max(initial=0))) - 1):
        out[:, 9 + i] = np.where(size >= i + 2, hashed(40, chars[:, i], chars[:, i + 1]), none)
        if i < PIECE - 2:
            out[:, 8 + PIECE + i] = np.where(size >= i + 3, hashed(50, chars[:, i], chars[:, i + 1], chars[:, i + 2]), none)
    return out


def runs_of(word: str) -> list[str]:
    """The runs of ``RUN`` letters of a word between marks of its ends; of a shorter one the whole."""
    w = f"^{word}$"
    return [w[i : i + RUN] for i in range(max(1, len(w) - RUN + 1))]


class Model:
    """Labels, lexicon, weights and the runs of letters of the sample; a plain value that travels with the tasks."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray, runs: frozenset[str] = frozenset()):
        self.labels, self.lexicon, self.emit, self.move, self.start, self.runs = labels, lexicon, emit, move, start, runs
        self._rows: dict[str, int] = {}
        self._known: dict[str, float] = {}
        self._table = np.zeros((0, len(labels)), np.float32)

    def __getstate__(self):
        return (self.labels, self.lexicon, self.emit, self.move, self.start, self.runs)

    def __setstate__(self, state):
        self.__init__(*state)

    def familiar(self, words: list[str]) -> np.ndarray:
        """For each word the share of its runs of letters that the sample has."""
        known = self._known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            own = runs_of(w)
            known[w] = sum(r in self.runs for r in own) / len(own)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def emissions(self, words: list[str]) -> np.ndarray:
        rows = self._rows
        if len(rows) > _CACHE_WORDS:
            rows.clear()
            self._table = self._table[:0]
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            rows.update(zip(new, range(len(self._table), len(self._table) + len(new)), strict=True))
            parts = (new[i : i + _AT_ONCE] for i in range(0, len(new), _AT_ONCE))
            self._table = np.concatenate([self._table, *(self.emit[_features(part, self.lexicon)].sum(1, dtype=np.float32) for part in parts)])
        return self._table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def posteriors(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """Posterior of each label for each word of a chain of documents; ``first`` marks each document's first word."""
        n, labels = len(words), len(self.labels)
        if n == 0:
            return np.zeros((0, labels))
        e = self.emissions(words).astype(np.float64)
        e = np.exp(e - e.max(1, keepdims=True))
        blocks = -(-n // _BLOCK)
        over = blocks * _BLOCK - n
        by_step = lambda x: np.ascontiguousarray(x.reshape(blocks, _BLOCK, -1).swapaxes(0, 1))
        e = by_step(np.concatenate([e, np.ones((over, labels))]))
        cut = by_step(np.concatenate([first, np.ones(over, bool)]))
        move, start = np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())
        # No step shrinks the largest value by more than the least transition does, so rescaling now and then is enough.
        p = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
        for k in range(_BLOCK):
            step = (p.reshape(-1, labels) @ move).reshape(p.shape)
            at = np.flatnonzero(cut[k])
            step[at] = p[at].sum(2, keepdims=True) * start
            step *= e[k][:, None, :]
            p = step / step.max((1, 2), keepdims=True) if k % _RESCALE == _RESCALE - 1 else step
        into, out = np.ones((blocks, labels)) / labels, np.ones((blocks, labels))
        for b in range(1, blocks):
            v = into[b - 1] @ p[b - 1]
            into[b] = v / v.sum()
        for b in range(blocks - 2, -1, -1):
            v = p[b + 1] @ out[b + 1]
            out[b] = v / v.max()
        ahead, a = np.empty_like(e), into
        for k in range(_BLOCK):
            at = np.flatnonzero(cut[k])
            step = a @ move
            step[at] = a[at].sum(1, keepdims=True) * start
            step *= e[k]
            a = ahead[k] = step / step.sum(1, keepdims=True) if k % _RESCALE == _RESCALE - 1 else step
        v = out
        for k in range(_BLOCK - 1, -1, -1):
            ahead[k] *= v
            w = v * e[k]
            v = w @ move.T
            at = np.flatnonzero(cut[k])
            v[at] = (w[at] @ start)[:, None]
            if k % _RESCALE == 0:
                v /= v.max(1, keepdims=True)
        post = ahead.swapaxes(0, 1).reshape(-1, labels)[:n]
        return post / post.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        return self.scan(texts, False)[:2]

    def scan(self, texts: list[str | None], familiar: bool = True) -> tuple[list[str], list[float], list[float]]:
        """Language, score and mean share of familiar runs of letters of each text; texts share a chain up to a number of words that falls with the labels."""
        most = max(1, _CHAIN // (len(self.labels) + len(self.labels) ** 2 // _BLOCK + 1))
        found, some, size = ([], [], []), [], 0
        for t in texts:
            if some and size + len(t or "") > 4 * most:
                for held, new in zip(found, self._scan(some, familiar), strict=True):
                    held.extend(new)
                some, size = [], 0
            some.append(t)
            size += len(t or "")
        for held, new in zip(found, self._scan(some, familiar), strict=True):
            held.extend(new)
        return found

    def _scan(self, texts: list[str | None], familiar: bool) -> tuple[list[str], list[float], list[float]]:
        words, starts, sizes = [], [], []
        for t in texts:
            w = words_of(t)
            starts.append(len(words))
            sizes.append(len(w))
            words += w
        preds, scores, certain = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not words or not self.labels:
            return preds, scores, certain
        full = np.flatnonzero(sizes)
        at = np.array(starts)[full]
        first = np.zeros(len(words), bool)
        first[at] = True
        post, n = self.posteriors(words, first), np.array(sizes)[full]
        mean, top = np.add.reduceat(post, at) / n[:, None], np.add.reduceat(self.familiar(words), at) / n if familiar else n
        for i, row, c in zip(full, mean, top, strict=True):
            k = int(row.argmax())
            preds[i], scores[i], certain[i] = self.labels[k], float(min(1.0, max(0.0, row[k]))), float(c)
        return preds, scores, certain


def fit(samples: list[tuple[str, str]], seed: int = 0, rounds: int = 8, sequences: int = 512) -> Model:
    """Fit by AdaGrad on the conditional log-likelihood of sequences made of runs of words from labelled texts."""
    labels = sorted({lang for _, lang in samples})
    number = {lang: k for k, lang in enumerate(labels)}
    docs = [(w, number[lang]) for t, lang in samples if lang in number and (w := words_of(t))]
    none = 1 + _BUCKETS  # this row pads and stays zero; those of the lexicon lie behind it
    size = none + 1 + len(labels)
    emit, move, start = np.zeros((size, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels))
    if not docs:
        return Model([], {}, emit, move, start)
    seen: dict[str, np.ndarray] = {}
    for w, k in docs:
        for x in set(w):
            seen.setdefault(x, np.zeros(len(labels), int))[k] += 1
    lexicon = {x: int(c.argmax()) for x, c in seen.items() if c.sum() >= 4 and c.max() >= 0.95 * c.sum()}
    rng = np.random.default_rng(seed)
    pools = {k: [w for w, j in docs if j == k] for k in {j for _, j in docs}}
    kinds = sorted(pools)
    length = 40
    g_emit, g_move, g_start = np.full(size, 1e-6), np.full(move.shape, 1e-6), np.full(start.shape, 1e-6)
    vocabulary = {x: i for i, x in enumerate(seen)}
    known = _features(list(vocabulary), lexicon)
    one = np.eye(len(labels))
    for _ in range(rounds):
        feats = np.zeros((sequences, length), int)
        gold = np.zeros((sequences, length), int)
        for s in range(sequences):
            at = 0
            while at < length:
                k = kinds[rng.integers(len(kinds))]
                w = pools[k][rng.integers(len(pools[k]))]
                run = int(rng.integers(6, 31))
                i = int(rng.integers(max(1, len(w) - run + 1)))
                part = w[i : i + min(run, length - at)]
                feats[s, at : at + len(part)] = [vocabulary[x] for x in part]
                gold[s, at : at + len(part)] = k
                at += len(part)
        for half in np.array_split(rng.permutation(sequences), 8):
            f, y = known[feats[half]], gold[half]
            e = emit[f].sum(2, dtype=np.float64)
            post, pairs = _expectations(e, move, start)
            d = one[y] - post
            d_move = one[y[:, :-1].ravel()].T @ one[y[:, 1:].ravel()] - pairs
            d_start = d[:, 0].sum(0)
            grad = np.zeros((size, len(labels)))
            np.add.at(grad, f.reshape(-1, _WIDTH), d.reshape(-1, 1, len(labels)))
            grad[none] = 0
            n = len(half)
            g_emit += (grad / n) ** 2 @ np.ones(len(labels)) / len(labels)
            emit += (0.3 * (grad / n) / np.sqrt(g_emit)[:, None]).astype(np.float32)
            g_move += (d_move / n) ** 2
            move += 0.1 * (d_move / n) / np.sqrt(g_move)
            g_start += (d_start / n) ** 2
            start += 0.1 * (d_start / n) / np.sqrt(g_start)
    runs: dict[str, int] = {}
    for x, c in seen.items():
        for r in runs_of(x):
            runs[r] = runs.get(r, 0) + int(c.sum())
    return Model(labels, lexicon, emit, move, start, frozenset(r for r, n in runs.items() if n > 1))


def _expectations(e: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels and expected label pairs of sequences of one length."""
    n, length, labels = e.shape
    x, m = np.exp(e - e.max(2, keepdims=True)), np.exp(move)
    a, b = np.empty_like(x), np.ones_like(x)
    a[:, 0] = np.exp(start) * x[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        a[:, t] = (a[:, t - 1] @ m) * x[:, t]
        a[:, t] /= a[:, t].sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b[:, t] = (b[:, t + 1] * x[:, t + 1]) @ m.T
        b[:, t] /= b[:, t].sum(1, keepdims=True)
    post = a * b
    post /= post.sum(2, keepdims=True)
    joint = a[:, :-1, :, None] * m * (x[:, 1:] * b[:, 1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return post, joint.sum((0, 1))


def held_out(id_col: str = "doc_id"):
    """Documents that training never sees: the crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(df: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """About ``docs`` labelled training texts, equally many for each language that has them; of longer texts ``chars`` characters."""
    usable = df.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    labels = counts.count()
    if not labels:
        return []
    each = max(1, docs // labels)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("start")), F.length("text") - chars + 1)
    run = F.regexp_replace(F.regexp_replace(F.substring("text", start, F.lit(chars)), r"^\S+\s", ""), r"\s\S+$", "")
    # Twice as many and some more than needed, so that the ranked rows are few and no language falls short by chance.
    near = usable.join(F.broadcast(counts), "lang").select("lang", "text", "doc_id", place.alias("_place"), "_n").where(F.col("_place") < (2.0 * each + 20) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text"))
    picked = near.withColumn("_rank", rank).where(F.col("_rank") <= each).withColumn("text", F.when(F.length("text") > chars, run).otherwise(F.col("text")))
    return [(r["text"], r["lang"]) for r in sorted(picked.select("text", "lang", "_rank").collect(), key=lambda r: (r["_rank"], r["lang"]))]


def predict_language(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``, one row per input row, from the text alone."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        preds, scores = model.predict(b["text"].to_pylist())
        return pa.record_batch([b["doc_id"], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(rows, "doc_id long, lang_pred string, score double", run)


def language_digest(df: DataFrame) -> DataFrame:
    """Fit on the training side of a table and predict all of it."""
    model = fit(training_sample(df))
    return predict_language(df, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose words are recognised: on average at least ``least`` of a word's runs of ``RUN`` letters are in the labelled sample.

    Texts that are null or without a letter are in no language and go. Without any labelled document no language is known and none
    can be told from another: then every text with a letter stays. Rows without an id and repeated ones are judged each by
    their own text; an empty table gives an empty one.

    Figures, fitted on 1,600 documents of sf0.1: of its 10,000 documents the least mean is 0.69 (16 words around a long key), one in
    2,000 is below 0.90; 200 texts of 60 random words lie below 0.12, of 5 random words below 0.44; of a script that no labelled text has, at 0.
    """
    model = fit(training_sample(df))
    if not model.labels:
        letter = F.regexp_like(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\p{L}"))
        return df.where(letter)
    schema = df.schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        preds, _, certain = model.scan(b.column(schema.names.index("text")).to_pylist())
        return b.filter(pa.array([p != "und" and c >= least for p, c in zip(preds, certain, strict=True)], pa.bool_()))

    return by_batch(df, schema, run)
