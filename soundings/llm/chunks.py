"""Repeated passages by content-defined chunking with a gear rolling hash.

A chunk border follows a byte whose gear hash (a function of the last 16 bytes only) has ``BITS`` zero bits on top, at
least ``LEAST`` bytes behind the previous such byte; stretches without a border are cut every ``MOST`` bytes. Borders
depend on nearby bytes alone, so an insertion moves only the chunks around it.

Chunks are known by a 64-bit digest. A digest that occurs in two or more documents is repeated; neighbouring repeated
chunks of a document merge into regions, and a region of ``WORDS`` words or more is repeated (of a
passage of more than 50 words, the chunks at its ends are lost; about one in a hundred falls below that). Equal digests of
other chunks, which come up by chance among 1e10 chunks or more, are chunks apart from each other: a region of 25 usual words
takes several in a row. Of each digest the occurrence in the document with
the smallest id is the one kept; only after the threshold a region is divided into its kept and its other parts, each a
passage of its own, of any length. Kept parts of fewer than ``WORDS`` words together are no passage that is first met here
(a chance word at the end of an older one) and have no row; nothing is cut from them.

Scale: chunk rows are (digest, row, place), about as large as the text; digests are counted with map-side
partial aggregates, so a chunk that every third document holds is one row per task, and the join back to the chunks is
an ordinary skew-splittable join. Regions come from windows over the repeated chunks of one row, bounded by its length.

A null or empty text has no chunks, and neither has a row without an id; dropping leaves them alone. A row is known by its id
and its text: equal rows share their passages, and rows of one id with other texts have their own, but copies under one id are
one document's. An empty table gives an empty one. Offsets count code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_batch

BITS, LEAST, MOST, WORDS = 4, 8, 96, 25
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


def borders(data: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends (exclusive) of the chunks of a byte array, in order; the last one is its length."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # doubling: afterwards h covers the last 16 bytes
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = at[np.diff(at, prepend=-least) >= least]
    at = at[at < n]
    ends = np.append(at, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > most:
        starts = ends - gaps
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[i] + most, ends[i], most) for i in np.flatnonzero(gaps > most))]))
    return ends


def chunk_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, th, digest, place``: a row per chunk, with the hash of the row's text; ``place`` holds the chunk's offset (from
    bit 16 on) and size (8 bits) in code points, and the words begun in it (8 bits)."""
    digest = xxhash.xxh3_64_intdigest

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes, digests, places = ([np.zeros(0, np.int64)] for _ in range(4))
        for doc, th, text in zip(*(b[c].to_pylist() for c in ("doc", "th", "text")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            ends = borders(data)
            starts = np.concatenate([[0], ends[:-1]])
            digests.append(np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends)).view(np.int64))
            shown = (data & 0xC0) != 0x80
            chars = np.concatenate([[0], np.cumsum(shown)])
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            begun = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])
            ids.append(np.full(len(ends), doc, np.int64))
            hashes.append(np.full(len(ends), th, np.int64))
            places.append(chars[starts] << 16 | chars[ends] - chars[starts] << 8 | begun[ends] - begun[starts])
        return pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, hashes, digests, places)], names=["doc", "th", "digest", "place"])

    rows = _named(df, id_col, text_col).where("doc IS NOT NULL AND text <> ''")
    return by_batch(rows, "doc long, th long, digest long, place long", run)


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _passages(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """``doc, th, start, end, n_words, n_chunks, first, own``: the parts of the regions that have enough words."""
    chunks = chunk_rows(df, id_col, text_col)
    seen = chunks.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first")
    held = chunks.join(seen, "digest").groupBy("doc", "th", "place").agg(F.min("first").alias("first"))  # equal rows once
    at, size, words = F.shiftright("place", 16).alias("at"), F.shiftright("place", 8).bitwiseAND(255).alias("size"), F.col("place").bitwiseAND(255).alias("words")
    rows = held.select("doc", "th", at, size, words, "first", (F.col("first") == F.col("doc")).alias("own"))
    w = Window.partitionBy("doc", "th").orderBy("at")
    apart = F.coalesce(F.lag(F.col("at") + F.col("size")).over(w) != F.col("at"), F.lit(True))
    turned = F.coalesce(F.lag("own").over(w) != F.col("own"), F.lit(True))
    marked = rows.withColumn("apart", apart.cast("int")).withColumn("turned", (apart | turned).cast("int"))
    numbered = marked.withColumn("region", F.sum("apart").over(w)).withColumn("part", F.sum("turned").over(w))
    parts = numbered.groupBy("doc", "th", "region", "part").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.min("first").alias("first"), F.first("own").alias("own")
    )
    whole = Window.partitionBy("doc", "th", "region")
    all_words, own_words = F.sum("n_words").over(whole), F.sum(F.when(F.col("own"), F.col("n_words")).otherwise(0)).over(whole)
    scored = parts.withColumn("all_words", all_words).withColumn("own_words", own_words)
    return scored.where((F.col("all_words") >= least_words) & (~F.col("own") | (F.col("own_words") >= least_words)))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = WORDS) -> DataFrame:
    """``id_col, start, end, n_words, n_chunks, first_doc_id, kept``: each passage of a document that another one holds too.

    ``first_doc_id`` is the smallest document that holds one of the passage's chunks; ``kept`` passages are met here first.
    ``least_words`` counts for a whole region: a passage may be shorter where a region is partly kept.
    """
    found = _passages(df, id_col, text_col, least_words)
    return found.select(F.col("doc").alias(id_col), *(F.col(c).cast("int").alias(c) for c in ("start", "end", "n_words", "n_chunks")), F.col("first").alias("first_doc_id"), F.col("own").alias("kept"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those repeated passages of which another document's copy is kept; all columns stay."""
    cuts = _passages(df, id_col, text_col, WORDS).where(~F.col("own")).groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    @F.pandas_udf("string")
    def without(texts, lists):
        import pandas as pd

        out = []
        for text, spans in zip(texts, lists, strict=True):
            for span in reversed(spans if spans is not None and text is not None else []):
                text = text[: span["start"]] + text[span["end"] :]
            out.append(text)
        return pd.Series(out, dtype=object)

    text = df[text_col].cast("string")
    joined = df.join(cuts, (df[id_col].cast("long") == cuts["doc"]) & (F.xxhash64(text) == cuts["th"]), "left")
    return joined.select(*(without(text, cuts["cuts"]).alias(c) if c == text_col else df[c] for c in df.columns))
