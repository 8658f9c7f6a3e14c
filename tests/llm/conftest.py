import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with nulls, empty and very long texts, repeated rows and an extra column with a clashing name."""
    rng = __import__("random").Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "re", "san") for b in ("po", "ne", "di", "ra", "vu", "xe")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(30, 120)) for _ in range(25)]
    rows, k = [], 0

    def add(t, lang="en"):
        nonlocal k
        rows.append((k, t, lang, "src", None if t is None else len(t), "x"))
        k += 1

    for t in base:
        add(t)
    for t in base[:10]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            add(" ".join(v))
    for t in (None, "", "   \n\t", "one two", "one two", "one two three four five", base[3].upper(), base[0], "0 1 2", "mot " * 30000):
        add(t, None)
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string").repartition(5)
