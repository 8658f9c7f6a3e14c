"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified links.

1. Equal vectors of one label form a class; only the one with the smallest id goes on, with the class's size.
2. Each table has several rotations (three rounds of sign flips and a fast Hadamard transform each). A rotation's hash is the
   largest coordinate by absolute value, with its sign: the nearest corner of the cross-polytope; a bucket is the sequence of
   a table's hashes. A vector goes into its own bucket and into the next nearest ones, in order of how much is lost by taking
   a smaller coordinate: multiprobe.
3. Within a bucket the vectors are compared in blocks, by matrix products in double precision; a pair that meets in
   several buckets counts in the first only. Small buckets are bundled; one of more than ``BLOCK`` rows is dealt into blocks,
   and each pair of blocks is a group of its own, so a hot bucket is many bounded groups. Groups return link counts per vector
   and a forest of links, never pairs.

Pruning grows with the table: the more vectors the largest label has, the more hashes a bucket has (``PLANS``), so that
unrelated vectors that share a bucket stay few: of 64 dimensions one pair in 6,000 per table with two hashes, less than one in
100,000 with three. Measured chance that two vectors at a cosine of 0.98 share no bucket: below 1e-5 for 64 dimensions and for
384, with each plan.

Vectors that are null, zero, or hold null or non-finite components, and those without a label or an id, link with nothing and
are their own component. Vectors of different lengths never link. A row is known by its id, label and vector: rows that repeat
an id with other vectors have links and components of their own. Ties go to the smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, cut, prepare, stored
from .graph import components, forest

COSINE, BLOCK, BUNDLE, NEXT = 0.98, 512, 8192, 4


@dataclass(frozen=True)
class Plan:
    """Hashes of a bucket, tables, and buckets of each table that a vector goes into."""

    hashes: int
    tables: int
    probes: int


#: By the vectors of the largest label and width, up to which the plan serves.
PLANS = ((1 << 21, Plan(2, 5, 3)), (1 << 28, Plan(3, 6, 4)), (1 << 62, Plan(4, 9, 6)))


def plan_for(vectors: int) -> Plan:
    return next(plan for most, plan in PLANS if vectors <= most)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows of a matrix whose width is a power of two (not scaled)."""
    rows, dims = x.shape
    h = 1
    while h < dims:
        y = x.reshape(rows, dims // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, dims)
        h *= 2
    return x


def buckets(vectors: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, tables, probes) bucket numbers of the rows of a matrix, the nearest first."""
    rows, dims = vectors.shape
    wide = 1 << max(2, (dims - 1).bit_length())
    signs = np.random.default_rng(dims).choice([-1.0, 1.0], (plan.tables, plan.hashes, 3, wide))
    out = np.empty((rows, plan.tables, plan.probes), np.int64)
    for t in range(plan.tables):
        number, loss = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))  # of the best sequences so far
        for k in range(plan.hashes):
            x = np.zeros((rows, wide))
            x[:, :dims] = vectors
            for s in signs[t, k]:
                x = hadamard(x * s)
            best = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :NEXT]
            top = np.take_along_axis(x, best, 1)
            hashed, lost = 2 * best + (top < 0), top[:, :1] ** 2 - top**2
            number = (number[:, :, None] * (2 * wide) + hashed[:, None]).reshape(rows, -1)
            loss = (loss[:, :, None] + lost[:, None]).reshape(rows, -1)
            kept = np.argsort(loss, axis=1, kind="stable")[:, : plan.probes]
            number, loss = np.take_along_axis(number, kept, 1), np.take_along_axis(loss, kept, 1)
        out[:, t] = number
    return out


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    kind = df.schema[vector_col].dataType
    v = F.col(vector_col) if kind.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    ok = F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    return df.select(F.col(id_col).cast("long").alias("vec"), F.when(ok, v).alias("v"), F.when(ok, F.col(label_col)).alias("label"))


def _placed(classes: DataFrame, plan: Plan) -> DataFrame:
    """A row per class, table and probe: the bucket, and all of the vector's buckets."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        values, sizes = b["v"].flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(b["v"].offsets.to_numpy())
        codes = np.zeros((b.num_rows, plan.tables, plan.probes), np.int64)
        ends = np.cumsum(sizes)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            x = values[(ends[at] - n)[:, None] + np.arange(n)]
            codes[at] = buckets(x / np.abs(x).max(1, keepdims=True), plan)
        each = plan.tables * plan.probes
        rows = np.repeat(np.arange(b.num_rows), each)
        table = np.tile(np.repeat(np.arange(plan.tables), plan.probes), b.num_rows)
        packed = pa.array([c.tobytes() for c in codes], pa.binary())
        kept = b.take(pa.array(rows))
        cols = [*(kept[c] for c in ("vec", "v", "label", "copies")), pa.array(sizes[rows].astype(np.int32)), pa.array(table.astype(np.int32)), pa.array(codes.reshape(-1)), packed.take(pa.array(rows))]
        return pa.record_batch(cols, names=["vec", "v", "label", "copies", "dims", "table", "bucket", "codes"])

    rows = classes.select("vec", "v", "label", "copies")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return by_batch(rows, f"{kinds}, dims int, table int, bucket long, codes binary", run)


def _first(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether rows i and j, which meet in a table's bucket, meet in no table before and in no smaller bucket of this one."""
    never = np.iinfo(np.int64).max
    ok = np.ones(len(i), bool)
    for k in range(codes.shape[1]):
        at = np.flatnonzero(ok & (table >= k))
        a, b = codes[i[at], k], codes[j[at], k]
        least = np.full(len(at), never)
        for p in range(codes.shape[2]):
            shared = (a[:, p, None] == b).any(1)
            least = np.where(shared, np.minimum(least, a[:, p]), least)
        ok[at] = np.where(table[at] == k, least == bucket[at], least == never)
    return ok


def _counted(vec: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Links of rows i and j as counts by vector and a forest."""
    ids, rows = np.unique(vec, return_inverse=True)
    count = np.bincount(rows[i], copies[j], len(ids)) + np.bincount(rows[j], copies[i], len(ids))
    roots = forest(zip(vec[i].tolist(), vec[j].tolist(), strict=True))
    some = np.flatnonzero(count)
    return pa.table({"vec": pa.array(ids[some], pa.int64()), "links": pa.array(count[some].astype(np.int64)), "root": pa.array([roots[d] for d in ids[some].tolist()], pa.int64())})


def _read(t: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies, unit vectors and bucket numbers of the rows of a group."""
    vec, copies = t["vec"].to_numpy(), t["copies"].to_numpy()
    x = np.array(t["v"].combine_chunks().flatten(), float).reshape(len(vec), -1)
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int64).reshape(len(vec), plan.tables, plan.probes)
    return vec, copies, x / np.sqrt((x * x).sum(1))[:, None], codes


def _links(placed: DataFrame, plan: Plan) -> DataFrame:
    """``vec, links, root``: for each vector of each group, its links counted there and what they join it to.

    Buckets of up to ``BLOCK`` rows are dealt into bundles of about ``BUNDLE`` rows; larger ones into blocks, each pair of
    which is a group.
    """
    prepare(placed.sparkSession)
    key = ("label", "dims", "table", "bucket")
    size = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1")
    size = stored(size)
    bundles = max(1, -(-(size.agg(F.sum("members")).first()[0] or 0) // BUNDLE))
    held = placed.join(size, list(key))
    small = held.where("blocks = 1").select(*key, "vec", "v", "copies", "codes", F.pmod(F.xxhash64(*key), F.lit(bundles)).alias("bundle"))
    rows = held.where("blocks > 1").withColumn("mine", F.pmod(F.hash("vec"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*key, "vec", "v", "copies", "codes", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine")

    def in_bundle(t: pa.Table) -> pa.Table:
        label = np.array(t["label"].combine_chunks().dictionary_encode().indices)
        table, bucket = t["table"].to_numpy(), t["bucket"].to_numpy()
        order = np.lexsort((bucket, table, label))
        t, label, table, bucket = t.take(pa.array(order)), label[order], table[order], bucket[order]
        vec, copies, x, codes = _read(t, plan)
        new = np.concatenate([[True], (np.diff(label) != 0) | (np.diff(table) != 0) | (np.diff(bucket) != 0)])
        number, pairs = np.cumsum(new), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for apart in range(1, len(vec)):  # rows of one bucket that lie so far apart
            i = np.flatnonzero(number[apart:] == number[:-apart])
            if not len(i):
                break
            i = i[np.einsum("ij,ij->i", x[i], x[i + apart]) >= COSINE]
            pairs.append((i, i + apart))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        here = _first(codes, i, j, table[i], bucket[i])
        return _counted(vec, copies, i[here], j[here])

    def in_blocks(t: pa.Table) -> pa.Table:
        vec, copies, x, codes = _read(t, plan)
        mine = t["mine"].to_numpy()
        table, bucket, low, high = (t[c][0].as_py() for c in ("table", "bucket", "low", "high"))
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        i, j = np.nonzero(x[left] @ x[right].T >= COSINE - 1e-9)
        i, j = left[i], right[j]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= COSINE
        i, j = i[exact], j[exact]
        if low == high:
            i, j = i[i < j], j[i < j]
        here = _first(codes, i, j, np.full(len(i), table), np.full(len(i), bucket))
        return _counted(vec, copies, i[here], j[here])

    schema = "vec long, links long, root long"
    return small.groupBy("dims", "bundle").applyInArrow(in_bundle, schema).unionByName(rows.groupBy(*key, "low", "high").applyInArrow(in_blocks, schema))


def _classes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``vec, own, label, v, copies``: a row per distinct label and vector, named ``vec`` by its smallest id ``own`` or, if an id
    repeats with other vectors, by a hash; and whether some are named so."""
    classes = cut(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec").alias("own"), F.count("*").alias("copies")))
    twice = cut(classes.groupBy("own").agg(F.count("*").alias("classes")).where("classes > 1").drop("classes"))
    if twice.isEmpty():
        return classes.withColumn("vec", F.col("own")), False
    name = F.when(F.col("again"), F.xxhash64("label", "v", "own")).otherwise(F.col("own"))
    return cut(classes.join(twice.withColumn("again", F.lit(True)), "own", "left").withColumn("vec", name).drop("again")), True


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", plan: Plan | None = None) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per input row; the plan follows the table's size if not given."""
    rows = _usable(df, id_col, vector_col, label_col)
    classes, renamed = _classes(rows)
    if plan is None:
        largest = classes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0]
        plan = plan_for(largest or 0)
    found = cut(_links(_placed(classes, plan), plan))
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec")
    named = classes.join(counts, "vec", "left").join(joined, "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    if renamed:  # some components are not named by a vector
        smallest = named.groupBy("component").agg(F.min("own").alias("least"))
        named = named.join(smallest, "component").drop("component").withColumnRenamed("least", "component")
    named = named.withColumnRenamed("component", "component_id").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.join(named, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(False)).alias("kept"))
