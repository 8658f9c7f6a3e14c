"""Benchmark decontamination by spaced-seed hashing, with built-in DataFrame functions only.

A seed is a fixed mask over a run of words; words at its zeros are ignored, so a substituted word there does not
matter. Every position of every training text and every third of a benchmark item is hashed under each mask, equal hashes
are joined, and a hit fixes how the item would lie on the text. No overlap that would be accepted is without a hit: an item
of n words, or a run of 24 of them, has more disjoint seeds of three words than the quarter of them that may be
substituted; items of 8 words get all positions and a second mask. The overlap is then verified word by word along the whole item:
substitutions are tolerated, and the overlap must match ``MATCHED`` of the item's words, or of ``LONGEST`` words of it.

Scale: a benchmark of up to ``SLICE`` seed hashes is broadcast, so that hits are found where the text lies; the seeds of a larger one
are joined by a shuffle on the hash, whose skewed partitions Spark splits. Hits (row, item, shift) are made distinct and written to a
table, so that each place is verified once however many seeds point to it; only the texts that have any are fetched, and
shuffled, for verification.

A null or empty text has no words and no overlap. Items under ``EXACT_WORDS`` words must match in full; those under
``LEAST_WORDS`` hold too little to tell. A row is known by its id and its text: repeated rows share their result, rows of one
id with other texts have their own, and rows without an id are judged like all others. Ties: each pair of a row and an item is
reported once, with its best overlap, the smallest offset first. An empty table or benchmark gives no overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import sized, stored

#: 1: the word counts, 0: it is ignored. The second one is for items of ``EIGHT`` words, whose three runs may be of two words.
MASKS, EIGHT = ("111", "1101"), 8
MATCHED, LONGEST, LEAST_WORDS, EXACT_WORDS = 0.75, 24, 4, 6
SLICE = 400_000


def words(text: Column) -> Column:
    """Lower-cased words of a text (runs outside of ASCII white space)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _seeds(hashed: Column, mask: str) -> Column:
    """Hash of each placement of a mask over an array of word hashes."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    places = F.sequence(F.lit(1), F.greatest(F.size(hashed) - len(mask) + 1, F.lit(1)))
    one = lambda p: F.xxhash64(F.lit(mask), *(F.get(hashed, p + (i - 1)) for i in at))
    return F.when(F.size(hashed) >= len(mask), F.transform(places, one)).otherwise(F.array().cast("array<bigint>"))


def _once(column: Column) -> Column:
    """A value that is computed once per row, however often it is used later: a projection would be copied to each use."""
    return F.explode(F.array(column))


def _hashes(text: Column) -> Column:
    return _once(F.transform(words(text), lambda w: F.xxhash64(w)))


def seed_hashes(df: DataFrame, ids: tuple[str, ...], text_col: str, masks: tuple[str, ...] = MASKS, words_as: str | None = None) -> DataFrame:
    """``*ids, seed, at``: each seed hash of each text with the word offset where it lies and, if named, its words' hashes."""
    hashed = df.select(*ids, _hashes(F.col(text_col)).alias("_h"))
    every = F.concat(*(F.transform(_seeds(F.col("_h"), m), lambda s, i: F.struct(s.alias("seed"), i.alias("at"))) for m in masks))
    return hashed.select(*ids, *([F.col("_h").alias(words_as)] if words_as else []), F.inline(every))


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mask, seed, at``: the seeds of benchmark items; each third position, or every one where that is too few."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), F.size(words(F.col(text_col))).alias("_n")).where(F.col("_n") >= LEAST_WORDS)
    every = seed_hashes(rows, ("id",), "_t", MASKS[:1]).withColumn("mask", F.lit(MASKS[0])).join(rows.groupBy("id").agg(F.max("_n").alias("_n"), F.min("_n").alias("_least")), "id")
    thirds = every.where((F.col("at") % 3 == 0) | (F.col("_least") <= EIGHT))
    eight = seed_hashes(rows.where(F.col("_n") == EIGHT), ("id",), "_t", MASKS[1:]).withColumn("mask", F.lit(MASKS[1]))
    return thirds.select("id", "mask", "seed", "at").unionByName(eight.select("id", "mask", "seed", "at"))


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """For an item laid on a text at a shift: 1 or 0 for each of its words that lies within the text."""
    places = F.sequence(F.lit(0), F.size(item) - 1)
    same = lambda j: F.when((j + shift >= 0) & (j + shift < F.size(doc)), (F.get(doc, j + shift) == F.get(item, j)).cast("int")).otherwise(0)
    return F.transform(places, same)


def _key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return df[id_col], F.xxhash64(df[text_col].cast("string"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str, text_col: str) -> DataFrame:
    """``doc, th, item, top``: the best overlap of each row, known by its id and its text's hash, with each item."""
    doc, th = _key(docs, id_col, text_col)
    rows = docs.select(doc.alias("doc"), th.alias("th"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text")).where(F.size(words(F.col("text"))) >= LEAST_WORDS)
    masks = MASKS if items.where(F.size(words(F.col("text"))) == EIGHT).limit(1).count() else MASKS[:1]
    theirs = item_seeds(benchmark, item_col, "text").select(F.col("id").alias("item"), "seed", F.col("at").alias("item_at")).distinct()
    wanted = items.select("item", _hashes(F.col("text")).alias("item_words"))
    small = theirs.count() <= SLICE
    found = seed_hashes(rows, ("doc", "th"), "text", masks).join(F.broadcast(theirs) if small else theirs, "seed")
    # Many seeds may say the same of where an item lies: each place is verified once.
    hits = sized(stored(found.select("doc", "th", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()))
    same_row = lambda a, b: (a["th"] == b["th"]) & a["doc"].eqNullSafe(b["doc"])
    held = rows.join(hits, same_row(rows, hits), "left_semi").dropDuplicates(["doc", "th"]).select("doc", "th", _hashes(F.col("text")).alias("words"))
    laid = held.join(hits, same_row(held, hits)).select(held["doc"], held["th"], "item", "shift", "words")
    wanted = F.broadcast(wanted) if small else wanted  # as bounded as its seeds: no item has more than three times as many words as seeds
    same = laid.join(wanted, "item").select("doc", "th", "item", "shift", F.size("item_words").alias("n"), _once(_overlap(F.col("words"), F.col("item_words"), F.col("shift"))).alias("same"))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    span = F.least(F.col("n"), F.lit(LONGEST))
    window = lambda p: F.aggregate(F.slice("same", p, span), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - span + 1), window))
    enough = F.when(F.col("n") < EXACT_WORDS, F.col("n")).otherwise(MATCHED * F.col("n"))
    scored = same.select("doc", "th", "item", "shift", "n", total.alias("matched"), F.when(total >= enough, True).otherwise((F.col("n") >= EXACT_WORDS) & (best >= MATCHED * span)).alias("held"))
    return scored.where("held").groupBy("doc", "th", "item").agg(F.min(F.struct((-F.col("matched")).alias("less"), "shift", "n")).alias("top"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id_col, item_col, start_word, n_matched, n_item_words``: each pair of a document and an item that it holds."""
    top = _overlaps(docs, benchmark, id_col, item_col, text_col)
    return top.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("top.shift").cast("long").alias("start_word"), (-F.col("top.less")).cast("long").alias("n_matched"), F.col("top.n").cast("long").alias("n_item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item; all columns stay."""
    gone = sized(stored(_overlaps(docs, benchmark, id_col, item_col, text_col).select("doc", "th").distinct()))
    doc, th = _key(docs, id_col, text_col)
    return docs.join(gone, (th == gone["th"]) & doc.eqNullSafe(gone["doc"]), "left_anti")
