"""Near-duplicate texts and vectors against all pairs."""

import random

import numpy as np

from soundings.llm import embed, graph, minhash, shingles


def test_components(spark):
    rng = random.Random(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    for edges in ([(i, i + 1) for i in range(300)], [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(500)], []):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
        assert got == graph.forest((a, b) for a, b in edges if a != b)


def _reference(rows):
    hasher = shingles.WordHasher()
    sets = [(i, set(shingles.shingle_set(t, hasher).tolist())) for i, t in rows]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return {i: len(s) for i, s in sets}, graph.forest(iter(edges))


def test_documents_match_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sizes, component = _reference(rows)
    got = minhash.near_duplicates(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], component.get(r.doc_id, r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    kept = minhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in got if r.kept})


def test_repeated_and_missing_ids(spark):
    """Ids that repeat with equal and with other texts, and rows without an id; no text that is kept is lost."""
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghijkl") + rng.choice("mnopqrst") for _ in range(60)) for _ in range(5))
    near = b.rsplit(" ", 3)[0]
    rows = [(1, b), (2, a), (2, b), (3, c), (3, c), (4, d), (4, near), (5, e), (5, e.rsplit(" ", 3)[0]), (None, a), (None, "lone"), (None, None), (6, None), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, th string, component int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == sorted([(1, 1, True), (2, 2, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True), (4, 1, False), (5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 7, True)])
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(set(found)) and {x for x in found if x[0] != 5} == {(1, b), (2, a), (3, c), (4, d), (None, a), (None, "lone"), (None, None), (6, None), (7, "")}
    assert sum(i == 5 for i, _ in found) == 1
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_hot_group_in_blocks(spark, monkeypatch):
    """A chain of drifting copies: many components meet in the same keys, in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(60):
        v = list(base)
        for _ in range(rng.randint(0, 9)):
            v[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(v)))
    sizes, component = _reference(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: component.get(i, i) for i, _ in rows}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_shared_key_is_guaranteed():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    y = x.copy()
    for row in y:
        row[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] += 1
    same = (x == y).reshape(200, minhash.CHUNKS, minhash.CHUNK).sum(2)
    assert (same.max(1) >= minhash.CHUNK - 1).all()


def test_vectors_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(1, 30)):
            rows.append([(centre + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.2])).tolist(), int(c % 3)])
    rows += [[rows[0][0], rows[0][1]], [rows[0][0], 2 - rows[0][1]], [None, 1], [[0.0] * 64, 1], [[float("nan")] * 64, 1], [[float("inf")] * 64, 1], [[None] * 64, 1], [rows[1][0], None], [[1.0, 2.0], 1], [[1.0, 2.0], 1]]
    table = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    edges = []
    for a, (v, k) in enumerate(rows):
        for b, (w, m) in enumerate(rows[:a]):
            if k is not None and k == m and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    edges.append((a, b))
    component = graph.forest(iter(edges))
    links = np.bincount([i for e in edges for i in e], minlength=len(rows))
    table = table.withColumnsRenamed({"label": "group"}).selectExpr("*", "1 AS v", "'x' AS component", "vec_id AS copies")
    for plan in (None, embed.Plan(3, 6, 4)):
        got = embed.near_duplicates(table, label_col="group", plan=plan).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id) == (links[r.vec_id], component.get(r.vec_id, r.vec_id)), r
            assert r.kept == (r.vec_id == r.component_id)


def test_vectors_that_share_an_id(spark):
    """Two groups whose vectors have an id in common stay apart."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 64))
    rows = [(1, a), (1, b), (2, a + 0.01 * rng.normal(size=64)), (3, b + 0.01 * rng.normal(size=64)), (4, a), (None, b)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed.near_duplicates(df).collect() if r.vec_id is not None)
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]
    kept = embed.near_duplicates(df.where("vec_id <> 1 OR vec_id IS NULL"))
    assert sorted((r.vec_id, r.component_id) for r in kept.collect() if r.vec_id is not None) == [(2, 2), (3, 3), (4, 2)]


def test_recall_of_each_plan():
    """Of pairs at a cosine of 0.98 nearly all meet in some bucket, of unrelated ones nearly none."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for dims in (64, 300):
        x = unit(rng.normal(size=(1000, dims)))
        side = rng.normal(size=(1000, dims))
        side = unit(side - (side * x).sum(1, keepdims=True) * x)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
        for _, plan in embed.PLANS:
            p, q, other = (embed.buckets(v, plan) for v in (x, y, side))
            meet = lambda a, b: (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean()
            assert meet(p, q) >= 0.998 and meet(p, other) <= 0.003, (dims, plan)
    assert [embed.plan_for(n).hashes for n in (0, 10**6, 10**7, 10**9)] == [2, 2, 3, 4]
