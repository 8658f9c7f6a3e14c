"""Connected components of an edge table, with nothing but edges moving between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's smallest connected node, for the nodes of some edges (path halving, smaller root wins)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _local(df: DataFrame) -> DataFrame:
    """Edges replaced, within each batch, by stars that connect the same nodes: at most one edge per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = forest(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True))
            kept = [(x, r) for x, r in roots.items() if x != r]
            yield pa.record_batch([pa.array([x for x, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.int64())], names=["a", "b"])

    return df.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each one moves edges towards the smallest
    neighbour and keeps the number of edges, so hubs are met by partial aggregates and skew-splittable joins. Every
    round is checkpointed. An empty edge table gives no rows; self-loops are dropped.
    """
    e = cut(_local(edges.where("a <> b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.unionByName(lows.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.sum("b").alias("t")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
