"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A text's signature has 64 symbols of 16 bits, one per MinHash. Two texts of similarity 0.75 differ in 16 symbols on
average and in more than ``DISTANCE`` = 31 about once in 100,000 times. The join is exact for that distance: split into 16
chunks of 4 symbols, two signatures that differ in at most 31 symbols have, by the pigeonhole principle, a chunk with at
most one differing symbol. Each chunk gives four keys, one for each symbol left out, so such a pair shares a key.

1. Texts with equal shingle sets form classes; only the smallest document of a class goes on.
2. Star round: within each key, every member is paired with the key's smallest member. Pairs within the signature
   distance are confirmed on full shingle sets, and connected components formed.
3. Rest round: in keys whose members still lie in several components, the pairs across components are enumerated in
   blocks (both members in one task, never a whole group), tested by signature, confirmed on full sets, and added.

No pair within a component is made, copies are never expanded, and nothing is capped: the rest round covers every pair
under the signature distance that could still join two components. Keys are counted with partial aggregates; hot keys
are met by joins whose skewed partitions Spark splits and by block pairs of ``BLOCK`` rows a side.

Results: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own component;
fewer than five words form one shingle. A row is known by its id and its text: rows that repeat an id are each placed by
their own text. A row without an id links with nothing but texts equal to its own, whose component it shows; ``kept`` is false
for it, and dropping leaves it alone. Ties go to the smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, cut, prepare, sized, stored
from .graph import components, forest
from .shingles import WIDTH, WordHasher, mix, shingle_set

SYMBOLS, CHUNK = 64, 4
CHUNKS = SYMBOLS // CHUNK
DISTANCE = 2 * CHUNKS - 1
SIMILAR = (75, 100)  # 100 * intersection >= 75 * union
BLOCK, TILE, SALTS = 512, 256, 64
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hasher = WordHasher()


def _forget() -> None:
    """At the end of a task: let go of this process's remembered words."""
    _hasher.known.clear()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a set of 64-bit fingerprints."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * _FACTORS).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct sets reach the similarity."""
    small, large = sorted((len(a), len(b)))
    if not small or SIMILAR[1] * small < SIMILAR[0] * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return SIMILAR[1] * common >= SIMILAR[0] * (len(both) - common)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc, th, n, h1, h2, sig`` of each row: its text's hash, set size, 128-bit digest of the set, signature (null for an empty set)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, high, low, sig = [], [], [], []
        for t in b["text"].to_pylist():
            s = shingle_set(t, _hasher, width)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            high.append((d >> 64) - (1 << 63))
            low.append((d & ((1 << 64) - 1)) - (1 << 63))
            sig.append(signature(s).tobytes() if len(s) else None)
        return pa.record_batch([b["doc"], b["th"], *(pa.array(x, pa.int64()) for x in (n, high, low)), pa.array(sig, pa.binary())], names=["doc", "th", "n", "h1", "h2", "sig"])

    return by_batch(_rows(df, id_col, text_col), "doc long, th long, n long, h1 long, h2 long, sig binary", run, _forget)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _classes(sets: DataFrame) -> tuple[DataFrame, bool]:
    """``doc, own, th, h1, h2, sig, n``: a row per distinct set, with its smallest document ``own`` and that one's text's hash;
    and whether some ``doc`` is not the class's document.

    ``doc`` names the class: its smallest document; where several classes have the same one, since an id repeats with other
    texts, all but the first are named by a hash of their digest.
    """
    full = sets.where("n > 0 AND doc IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th")).alias("own"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    classes = cut(classes.select(F.col("own.doc").alias("doc"), F.col("own.doc").alias("own"), F.col("own.th").alias("th"), "h1", "h2", "sig", "n"))
    twice = cut(classes.groupBy("own").agg(F.count("*").alias("classes"), F.min(F.struct("h1", "h2")).alias("first")).where("classes > 1").drop("classes"))
    if twice.isEmpty():
        return classes, False
    other = F.col("first").isNotNull() & (F.struct("h1", "h2") != F.col("first"))
    named = classes.join(twice, "own", "left").withColumn("doc", F.when(other, F.xxhash64("h1", "h2", "own")).otherwise(F.col("own")))
    return cut(named.select(*classes.columns)), True


def _keys(classes: DataFrame) -> DataFrame:
    """``key, doc``: the 64 keys of each signature; a key holds its chunk, the symbol left out and the other three."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.int64)
        keys = np.empty((len(sig), CHUNKS, CHUNK), np.int64)
        for out in range(CHUNK):
            x, y, z = (sig[:, :, i] for i in range(CHUNK) if i != out)
            keys[:, :, out] = (x << 32 | y << 16 | z) | (np.arange(CHUNKS) * CHUNK + out << 48)
        doc = np.repeat(b["doc"].to_numpy(zero_copy_only=False), SYMBOLS)
        return pa.record_batch([pa.array(keys.reshape(-1)), pa.array(doc)], names=["key", "doc"])

    return by_batch(classes.select("doc", "sig"), "key long, doc long", run)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose signatures and set sizes allow the similarity, grouped by ``b``."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * SIMILAR[1] >= F.greatest("n_a", "n_b") * SIMILAR[0])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
        return b.select(["a", "b", "n_a", "n_b"]).filter(pa.array((x != y).sum(1) <= DISTANCE))

    near = by_batch(joined.select("a", "b", "n_a", "n_b", "sig_a", "sig_b"), "a long, b long, n_a long, n_b long", run)
    return near.withColumn("g", F.col("b"))


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` and ``right``, pair by pair.

    Many pairs of few sets are counted by products of 0/1 matrices over slices of the shingles that two sets share.
    """
    sizes = np.array([len(s) for s in sets])
    words, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    rows, cols = np.unique(left), np.unique(right)
    if 25 * (sizes[left] + sizes[right]).sum() + 8000 * len(left) < 0.2 * len(rows) * len(cols) * len(shared):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    place = np.full(len(words), -1)
    place[shared] = np.arange(len(shared))
    owner, at = np.repeat(np.arange(len(sets)), sizes), place[inverse.reshape(-1)]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(rows), len(cols)))
    for low in range(0, len(shared), 2048):
        i, j = np.searchsorted(at, [low, low + 2048])
        m = np.zeros((len(sets), min(2048, len(shared) - low)), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        total += m[rows] @ m[cols].T
    return total[np.searchsorted(rows, left), np.searchsorted(cols, right)].round().astype(np.int64)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (``g, a, b``) whose full sets are similar.

    Pairs of one group ``g`` are laid out in tiles by hashes of their two documents, so that a tile holds about
    ``TILE`` documents of usual length a side and each text travels once per tile instead of once per pair.
    """
    prepare(pairs.sparkSession)
    tiles = lambda side: F.ceil(F.approx_count_distinct(side) * F.greatest(F.lit(1.0), F.avg(f"n_{side}") / 2000) / TILE).alias(f"tiles_{side}")
    # Groups of more than one tile are few, and salted, so that the pairs of a hot group are dealt out.
    sized = pairs.groupBy("g").agg(tiles("a"), tiles("b")).where("tiles_a > 1 OR tiles_b > 1")
    sized = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = lambda side: F.pmod(F.xxhash64(side), F.coalesce(F.col(f"tiles_{side}"), F.lit(1))).alias(f"t{side}")
    salted = pairs.withColumn("salt", F.pmod(F.hash("a", "b"), F.lit(SALTS)))
    laid = salted.join(sized, ["g", "salt"], "left").select("g", place("a"), place("b"), "a", "b")
    wanted = laid.select(F.col("g").alias("h"), F.col("ta").alias("ua"), F.col("tb").alias("ub"), F.explode(F.array("a", "b")).alias("doc")).distinct()
    held = wanted.join(texts, "doc").select("h", "ua", "ub", "doc", "text")

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        at = {d: i for i, d in enumerate(docs["doc"].to_pylist())}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        if not at or not a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = [shingle_set(t.as_py(), _hasher, width) for t in docs["text"]]
        left, right = np.array([at[x] for x in a]), np.array([at[x] for x in b])
        sizes = np.array([len(s) for s in sets])
        common = _common(sets, left, right)
        near = SIMILAR[1] * common >= SIMILAR[0] * (sizes[left] + sizes[right] - common)
        return pa.table({"a": pairs["a"], "b": pairs["b"]}).filter(pa.array(near))

    return laid.groupBy("g", "ta", "tb").cogroup(held.groupBy("h", "ua", "ub")).applyInArrow(run, "a long, b long")


def _canonical(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of signatures, the number (chunk and symbol left out) of the smallest key that the two share."""
    same = (x == y).reshape(-1, CHUNKS, CHUNK)
    count = same.sum(2)
    shared = (count[:, :, None] == CHUNK) | ((count[:, :, None] == CHUNK - 1) & ~same)
    return shared.reshape(len(x), -1).argmax(1)


def _across(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, low, high, doc, partners``: signature-near pairs across the components of a key, packed by document.

    A pair across components has a member outside of the key's largest component ``usual``. Those rest members are dealt
    into ``rest_blocks`` and all members into ``blocks``; a group is one of each, so a hot key is many bounded groups, and
    the usual members, the bulk of a hot key, travel once for each block of the rest. A pair is found in the smallest key
    that its signatures share and nowhere else. Documents that are only partners get a row with an empty list, so that
    a group's rows name every text that it needs.
    """
    prepare(members.sparkSession)
    rest = members.where(F.col("component") != F.col("usual"))
    lefts = rest.select("key", "doc", "component", F.pmod(F.hash("doc"), F.col("rest_blocks")).alias("low"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("high"), F.lit(True).alias("left"))
    rights = members.select("key", "doc", "component", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("low"), F.pmod(F.hash("doc"), F.col("blocks")).alias("high"), F.lit(False).alias("left"), (F.col("component") == F.col("usual")).alias("usual"))
    rows = lefts.withColumn("usual", F.lit(False)).unionByName(rights).join(classes.select("doc", "sig", "n"), "doc")
    schema = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64()), ("partners", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        doc, comp, n = (t[c].to_numpy() for c in ("doc", "component", "n"))
        left, usual = t["left"].to_numpy(), t["usual"].to_numpy()
        key, lo, hi = (t[c][0].as_py() for c in ("key", "low", "high"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        rights = np.flatnonzero(~left)
        partners: dict[int, list[int]] = {}
        for i in np.flatnonzero(left):
            j = rights[(comp[rights] != comp[i]) & (usual[rights] | (doc[rights] > doc[i]))]
            j = j[np.minimum(n[j], n[i]) * SIMILAR[1] >= np.maximum(n[j], n[i]) * SIMILAR[0]]
            if len(j) and len(j := j[(sig[j] != sig[i]).sum(1) <= DISTANCE]):
                j = j[_canonical(sig[j], sig[i]) == key >> 48]
                if len(j):
                    partners[int(doc[i])] = doc[j].tolist()
        wanted = partners | {d: [] for p in partners.values() for d in p if d not in partners}
        m = len(wanted)
        return pa.table([pa.array([v] * m, f.type) for v, f in zip((key, lo, hi), schema, strict=False)] + [pa.array(list(wanted), pa.int64()), pa.array(list(wanted.values()), schema.field("partners").type)], schema=schema)

    return rows.groupBy("key", "low", "high").applyInArrow(run, "key long, low int, high int, doc long, partners array<long>")


def _confirmed_blocks(near: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (``a, b``) that join what the confirmed pairs of ``_across`` join, one group of blocks at a time."""

    def run(t: pa.Table) -> pa.Table:
        docs, lists = t["doc"].to_pylist(), t["partners"].to_pylist()
        at = {d: i for i, d in enumerate(docs)}
        left = np.array([i for i, p in enumerate(lists) for _ in p], np.int64)
        right = np.array([at[d] for p in lists for d in p], np.int64)
        sets = [shingle_set(x.as_py(), _hasher, width) for x in t["text"]]
        sizes = np.array([len(s) for s in sets])
        common = _common(sets, left, right)
        near = SIMILAR[1] * common >= SIMILAR[0] * (sizes[left] + sizes[right] - common)
        roots = forest(zip(left[near].tolist(), right[near].tolist(), strict=True))
        kept = [(docs[x], docs[r]) for x, r in roots.items() if x != r]
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([r for _, r in kept], pa.int64())})

    return near.join(texts, "doc").groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def _placed(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``doc, th, n, component``, one row per input row."""
    sets = cut(signatures(df, id_col, text_col, width))
    classes, renamed = _classes(sets)
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("size")).where("size > 1")
    members = cut(keys.join(shared, "key"))
    first = cut(_near(members.where("doc <> least").select(F.col("doc").alias("a"), F.col("least").alias("b")).distinct(), classes))
    wide = members.where("size > 2")

    asked = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(wide.select(F.col("doc").alias("node"))).distinct()
    asked = classes.select(F.col("doc").alias("node"), F.col("own").alias("doc"), "th").join(asked, "node")
    texts = _rows(df, id_col, text_col).join(asked, ["doc", "th"]).dropDuplicates(["doc", "th", "node"])
    texts = stored(texts.select(F.col("node").alias("doc"), "text"))
    links = cut(_confirmed(first, texts, width))
    joined = components(links)
    placed = wide.join(joined.withColumnRenamed("node", "doc"), "doc", "left").join(classes.select("doc", "n"), "doc")
    placed = cut(placed.select("key", "doc", F.coalesce("component", "doc").alias("component"), "n"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    per_key = parts.groupBy("key").agg(F.max(F.struct("members", "weight", "component")).alias("most"), F.sum("members").alias("members"), F.sum("weight").alias("weight"), F.count("*").alias("parts"))
    blocks = lambda members, weight: F.ceil(F.greatest(members / BLOCK, weight / (2000 * BLOCK))).cast("int")
    rest = blocks(F.col("members") - F.col("most.members"), F.col("weight") - F.col("most.weight")).alias("rest_blocks")
    open_keys = per_key.where("parts > 1").select("key", F.col("most.component").alias("usual"), blocks(F.col("members"), F.col("weight")).alias("blocks"), rest)
    more = cut(_across(placed.select("key", "doc", "component").join(open_keys, "key"), classes))
    if not more.isEmpty():
        links = links.unionByName(cut(_confirmed_blocks(more, texts, width)))
        joined = components(links)
    named = classes.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    if renamed:  # some components are not named by a document
        smallest = named.groupBy("component").agg(F.min("own").alias("least"))
        named = named.join(smallest, "component").select("h1", "h2", F.col("least").alias("component"))
    named = named.select("h1", "h2", "component")
    full = sets.where("n > 0").select("doc", "th", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc", "th", "n", "component")
    return full.unionByName(sets.where("n = 0").select("doc", "th", "n", F.col("doc").alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, one row per input row."""
    out = _placed(df, id_col, text_col, width)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(False)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of its smallest document; all columns stay.

    Of a document's rows in one group, the one with the smallest hash of its text stays, and of rows with equal id and text
    any one. Rows without an id all stay.
    """
    placed = stored(_placed(df, id_col, text_col, WIDTH).where("doc IS NOT NULL").select("doc", "th", "component"))
    gone = placed.where("doc <> component").select("doc", "th")
    rows = lambda keys, how: df.join(keys, (df[id_col].cast("long") == keys["doc"]) & (F.xxhash64(df[text_col].cast("string")) == keys["th"]), how)
    repeated = stored(placed.where("doc = component").groupBy("doc").agg(F.count("*").alias("rows"), F.min("th").alias("least")).where("rows > 1"))
    if repeated.isEmpty():
        return rows(sized(stored(gone.distinct())), "left_anti")
    held = placed.where("doc = component").join(repeated, "doc")
    less = stored(gone.unionByName(held.where("th <> least").select("doc", "th")).distinct())
    same = stored(held.where("th = least").select("doc", "th").distinct())
    apart = rows(sized(stored(less.unionByName(same))), "left_anti")
    return apart.unionByName(rows(same, "left_semi").dropDuplicates([id_col, text_col]))
