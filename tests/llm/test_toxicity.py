"""Positive-unlabelled learning: held-out accuracy on planted words, and the risk's gradient by differences."""

import random
import zlib

import numpy as np

from soundings.llm import toxicity as T


def corpus(n=700):
    rng = random.Random(3)
    words = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("po", "ne", "di") for c in ("ra", "vu", "xe", "s")]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([12, 40, 200]))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(max(2, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(("Grubble", "snork", "vextish" + rng.choice("abc")))
        docs.append((k, " ".join(w) + ".", "xx", 1.5))
        if rng.random() < 0.6:
            labels.append((k, 0, int(bad)))
        docs[-1] += (bad,)
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs, labels = corpus()
    found = {r["doc_id"]: r for r in T.toxicity(*frames(spark, docs, labels)).collect()}
    assert len(found) == len(docs)
    held = [(d[0], d[4]) for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert {k for k, r in found.items() if r["held_out"]} == {k for k, _ in held}
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())
    bad, good = [found[k] for k, b in held if b], [found[k] for k, b in held if not b]
    assert np.mean([r["predicted"] for r in bad]) >= 0.9 and np.mean([r["predicted"] for r in good]) <= 0.01


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, labels = corpus(300)
    turned = [(k, 1, 1 - t) if zlib.crc32(str(k).encode()) % 3 == 1 else (k, 1, t) for k, _, t in labels]
    a = T.toxicity(*frames(spark, docs, labels)).orderBy("doc_id").collect()
    b = T.toxicity(*frames(spark, [(k, t, "yy", 0.0, x) for k, t, _, _, x in docs], turned)).orderBy("doc_id").collect()
    assert a == b


def test_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    a, b, w, bias, prior = rng.random((9, 4)), rng.random((30, 4)), rng.normal(size=4), 0.3, 0.4

    def risk(w, bias):
        s_p, s_u = T.sigmoid(a @ w + bias), T.sigmoid(b @ w + bias)
        return prior * (1 - s_p).mean() + s_u.mean() - prior * s_p.mean()

    grad, g_bias, negative = T.risk_gradient(a, b, w, bias, prior)
    assert negative > 0
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((risk(w + step, bias) - risk(w - step, bias)) / 2e-6 - grad[k]) < 1e-6
    assert abs((risk(w, bias + 1e-6) - risk(w, bias - 1e-6)) / 2e-6 - g_bias) < 1e-6
    # Where the unlabelled look cleaner than the prior allows, the step goes up the negatives' part instead.
    grad, _, negative = T.risk_gradient(np.ones((5, 1)), np.zeros((5, 1)), np.array([8.0]), -4.0, 0.9)
    assert negative < 0 and grad[0] >= 0


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "snork snork", "xx", 1.0), (900, None, None, None), (901, "", "xx", 1.0), (902, "1 2 3", "xx", 1.0), (903, "snork " * 100_000, "xx", 1.0), (904, "漢" * 5000, "xx", 1.0)]
    rows = [d[:4] for d in docs] + odd + [docs[0][:4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([*labels, *labels[:3], (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901] == by[902] < 0.7 and by[903] >= 0.7


def test_nothing_to_learn_from(spark):
    docs, _ = corpus(30)
    df, none = frames(spark, docs, [(1, 0, 0)])
    assert {r["score"] for r in T.toxicity(df, none).collect()} == {0.0}
    assert {r["predicted"] for r in T.toxicity(df, none.limit(0)).collect()} == {0}
    assert T.toxicity(df.limit(0), none).count() == 0
