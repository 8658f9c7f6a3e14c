"""Toxicity of documents by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; everything else is unlabelled, whatever its label says. The classifier is a linear
one over the words of a text and their affixes, trained in numpy on the risk

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0)),

whose second part, the risk of the negatives that nobody has labelled, cannot become negative: where a batch would make it so, the
step goes the other way. ``prior``, the share of toxic texts, is that of the labelled training rows; the bias is set so that the
scores of the unlabelled sample have that mean. The loss is the sigmoid one.

The model is fitted on the driver from a bounded sample: about ``POSITIVES`` confirmed toxic and ``UNLABELLED`` other training
documents, chosen by a hash of their id and text; of a text of more than ``SAMPLE_CHARS`` characters a run of that size.
Features are the words and affixes that tell the samples apart best, four for each toxic text, from 100 to ``FEATURES``. Nothing else is bounded: prediction reads whole texts,
batch by batch, without a shuffle.

A null or empty text has no words and gets the score of none. Without any confirmed toxic document, or without any other
text, nothing is learned: every score is 0 without a confirmed one, else the prior. A document with labels of both kinds is not confirmed. Repeated rows
are scored each on their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_batch
from .langid import held_out

POSITIVES, UNLABELLED, SAMPLE_CHARS = 2000, 6000, 8000
FEATURES, AFFIXES = 1000, (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
#: Of a longer run of letters, as in scripts without spaces, each piece of this many counts as a word.
_PIECE = 40
_CACHE = 200_000


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    return [w[i : i + _PIECE] for w in found for i in range(0, len(w), _PIECE)] if any(len(w) > _PIECE for w in found) else found


def features_of(word: str) -> list[str]:
    """The word itself, its beginnings and its ends."""
    return [f"={word}", *(f"^{word[:k]}" for k in AFFIXES if len(word) > k), *(f"${word[-k:]}" for k in AFFIXES if len(word) > k)]


def weight(count: float, words: int) -> float:
    """A feature's value: how often it stands in a text, against the text's length; a few among many words still show."""
    return math.log1p(2.0 * count / (1.0 + words / 100.0))


class Model:
    """Weights by feature; a plain value that travels with the tasks."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return (self.weights, self.bias)

    def __setstate__(self, state):
        self.__init__(*state)

    def _features(self, word: str) -> tuple[str, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > _CACHE:
                self._known.clear()
            found = self._known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        words = words_of(text)
        counts: Counter[str] = Counter()
        for w, n in Counter(words).items():
            for f in self._features(w):
                counts[f] += n
        z = self.bias + sum(self.weights[f] * weight(n, len(words)) for f, n in counts.items())
        return float(sigmoid(z)) if z > -math.inf else 0.0


def _signature(words: list[str]) -> tuple[str, ...]:
    """What near copies mostly share: the first of the distinct words by a hash."""
    return tuple(sorted(set(words), key=lambda w: hash_of(w))[:4])


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _matrix(texts: list[list[str]], number: dict[str, int]) -> np.ndarray:
    out, known = np.zeros((len(texts), len(number)), np.float32), {}
    for i, words in enumerate(texts):
        for w, n in Counter(words).items():
            if w not in known:
                known[w] = [number[f] for f in features_of(w) if f in number]
            for j in known[w]:
                out[i, j] += n
        out[i] = np.log1p(2.0 * out[i] / (1.0 + len(words) / 100.0))
    return out


def _telling(positive: list[list[str]], unlabelled: list[list[str]], most: int) -> dict[str, int]:
    """The features whose shares of texts differ most between the samples, by the difference over its standard error."""

    n, m, a, b = len(positive), len(unlabelled), Counter(), Counter()
    for words in positive:
        a.update({f for w in set(words) for f in features_of(w)})
    a = {f: c for f, c in a.items() if c >= max(3, n // 400)}
    known: dict[str, list[str]] = {}
    for words in unlabelled:
        for w in (own := set(words)).difference(known):
            known[w] = [f for f in features_of(w) if f in a]
        b.update({f for w in own for f in known[w]})
    score = lambda f: abs(a[f] / n - b[f] / m) / math.sqrt((a[f] + b[f] + 1.0) / (n + m) / min(n, m))
    return {f: k for k, f in enumerate(sorted(a, key=lambda f: (-score(f), f))[:most])}


def fit(positive: list[str], unlabelled: list[str], prior: float, seed: int = 0, steps: int = 300, features: int = FEATURES) -> Model:
    """A classifier from toxic and unlabelled texts; near copies among the toxic ones count once."""
    toxic = list({_signature(w): w for t in positive if (w := words_of(t))}.values())
    other = [words_of(t) for t in unlabelled]
    prior = min(max(prior, 1e-4), 0.9)
    if not toxic or not other:
        return Model({}, math.log(prior / (1 - prior)) if toxic else -math.inf)
    number = _telling(toxic, other, min(features, max(100, 4 * len(toxic))))
    x_p, x_u = _matrix(toxic, number), _matrix(other, number)
    middle = x_u.mean(0)
    x_p -= middle
    x_u -= middle
    rate = 0.5 / math.sqrt(max(1.0, float((x_u**2).sum(1).mean())))  # else one step could saturate every score
    rng, d = np.random.default_rng(seed), len(number)
    w, bias = np.zeros(d), math.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        part = rng.choice(len(x_u), min(1024, len(x_u)), replace=False)
        grad, g_bias, _ = risk_gradient(x_p[rng.integers(len(x_p), size=512)], x_u[part], w, bias, prior)
        g = np.concatenate([grad + 3e-5 * w, [g_bias]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(w[k]) for f, k in number.items()}, float(bias + _shift(x_u @ w + bias, prior) - middle @ w))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _shift(z: np.ndarray, prior: float) -> float:
    """What to add to the logits so that their scores have the prior as their mean, at most 5 either way."""
    low, high = -5.0, 5.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(z + middle).mean() < prior else (low, middle)
    return low


def risk_gradient(a: np.ndarray, b: np.ndarray, w: np.ndarray, bias: float, prior: float) -> tuple[np.ndarray, float, float]:
    """Gradient of the non-negative risk over positives ``a`` and unlabelled ``b`` under the sigmoid loss, and the negatives' part of it."""
    s_p, s_u = sigmoid(a @ w + bias), sigmoid(b @ w + bias)
    d_p, d_u = s_p * (1 - s_p), s_u * (1 - s_u)
    negative = s_u.mean() - prior * s_p.mean()
    of_w, of_bias = d_u @ b / len(b) - prior * (d_p @ a) / len(a), d_u.mean() - prior * d_p.mean()
    if negative < 0:  # better than it can be: undo
        return -of_w, -of_bias, negative
    return of_w - prior * (d_p @ a) / len(a), of_bias - prior * d_p.mean(), negative


def _place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str], float]:
    """(confirmed toxic texts, unlabelled texts, share of toxic ones among the labelled) of the training rows."""
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    each = judged.groupBy("doc_id").agg((F.min("toxic") == 1).alias("bad"))
    told = each.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    train = rows.where(~held_out())
    total = train.count()
    if not told["bad"] or not total:
        return [], [], 0.0
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    text = F.when(F.length("text") > chars, F.substring("text", start, F.lit(chars))).otherwise(F.col("text")).alias("text")
    chosen = each.where(F.col("bad") & (_place("doc_id") < positives / told["bad"])).select("doc_id")  # about ``positives`` rows
    sure = train.join(F.broadcast(chosen), "doc_id").withColumn("_place", _place("doc_id", "text")).select(text, "_place")
    some = train.withColumn("_place", _place("doc_id", "text")).where(F.col("_place") < unlabelled / total).select(text, "_place")
    by_place = lambda df: [r["text"] for r in sorted(df.collect(), key=lambda r: (r["_place"], r["text"]))]
    return by_place(sure), by_place(some), told["bad"] / told["n"]


def score_texts(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted``, one row per row, from the text alone."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t) for t in b["text"].to_pylist()]
        return pa.record_batch([b["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(rows, "doc_id long, score double, predicted int", run)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model fitted on the training side of the labels."""
    model = fit(*training_sample(docs, labels))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
