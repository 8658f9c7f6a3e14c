"""Token counts that follow edits: a segment tree of pre-tokens per document, kept beside its text and re-encoded only
where edits touch it.

``build_trees`` deals a document's pre-tokens into leaves of ``LEAF``; the tree above holds sums of token counts. It is a
table like any other (text, leaf offsets, sums by level), to be written and read again. ``apply_edits`` takes kept trees
and edits: an edit touches the leaves that its span meets; those and one leaf of context on either side are pre-tokenized and
counted again (a pre-token depends on two characters beyond it at most; should the new pre-tokens not meet the old ones again
at the context's end, the region grows by a leaf until they do), and the sums on the way to the root are updated. Everything
else keeps its count unread. A leaf that outgrows ``MOST`` pre-tokens is divided, by which only sums are added up anew. The
edited text with its new tree takes the next edits.

Edits of a document are spans of its text, ``array<struct<start,end,text>>`` in code points. They are applied in
order of start; of overlapping ones the first stays, spans are clipped to the text, and null or empty lists change
nothing. A null text is an empty one, to which only insertions at 0 apply. Strings of special tokens count as ordinary
text. Repeated rows, and those without an id, are counted each on their own; an empty table gives an empty one. Work is by
row, without a shuffle. Extra columns are not carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Codec, codec
from .frames import by_batch

LEAF, MOST = 64, 256
EDITS = "array<struct<start:int,end:int,text:string>>"
TREE = "text string, leaf_starts array<int>, sums array<array<int>>"


class CountTree:
    """Sums of token counts over the leaves of one document, and the code points where the leaves start."""

    def __init__(self, starts: np.ndarray, levels: list[np.ndarray]):
        self.starts, self.levels = starts, levels

    @classmethod
    def over(cls, starts: np.ndarray, leaves: np.ndarray) -> CountTree:
        """The tree above given leaves; ``starts`` has one more element, the text's length."""
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), 2)))
        return cls(starts, levels)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[0]) else 0

    def put(self, leaf: int, count: int) -> None:
        """A leaf's new count: one sum changes on each level."""
        change = count - self.levels[0][leaf]
        for level in self.levels:
            level[leaf] += change
            leaf >>= 1

    def regions(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of leaves (first, last) that hold the spans and their context; adjacent runs are one."""
        out: list[list[int]] = []
        last = len(self.levels[0]) - 1
        for start, end in spans:
            a = max(0, int(np.searchsorted(self.starts, start, "right")) - 2)
            b = min(last, int(np.searchsorted(self.starts, end, "right")))
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def replaced(self, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> CountTree:
        """The tree with runs of leaves (first, last) made anew from the lengths and counts of pre-tokens, in order."""
        widths = np.diff(self.starts)
        if all(first <= last and len(n) <= MOST * (last - first + 1) for first, last, n, _ in parts):  # as many leaves as before
            for first, last, lengths, counts in parts:
                cuts = len(lengths) * np.arange(last - first + 2) // (last - first + 1)
                for k in range(last - first + 1):
                    own = slice(cuts[k], cuts[k + 1])
                    widths[first + k] = lengths[own].sum()
                    self.put(first + k, int(counts[own].sum()))
            return CountTree(np.concatenate([[0], np.cumsum(widths)]), self.levels)
        size, leaves, at = [], [], 0
        for first, last, lengths, counts in parts:
            dealt = np.arange(0, len(lengths), LEAF)
            size += [widths[at:first], np.add.reduceat(lengths, dealt)] if len(dealt) else [widths[at:first]]
            leaves += [self.levels[0][at:first], np.add.reduceat(counts, dealt)] if len(dealt) else [self.levels[0][at:first]]
            at = last + 1
        return CountTree.over(np.concatenate([[0], np.cumsum(np.concatenate([*size, widths[at:]]))]), np.concatenate([*leaves, self.levels[0][at:]]))


def usable_edits(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits within a text of a size, in order, without overlaps."""
    out, free = [], 0
    for e in sorted((e for e in edits or () if e and e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"])):
        start, end = max(0, e["start"]), min(size, e["end"])
        if free <= start <= end:
            out.append((start, end, e["text"] or ""))
            free = max(end, start + (start == end))  # of two insertions at one place the first stays
    return out


def edited(text: str, edits: list[tuple[int, int, str]], offset: int = 0) -> str:
    """A text, which begins at an offset of the document, with the edits applied."""
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at : start - offset], new]
        at = end - offset
    return "".join([*out, text[at:]])


class _Edits:
    """The edits of one document in order, found by place."""

    def __init__(self, edits: list[tuple[int, int, str]]):
        self.edits, self.starts, self.ends = edits, [e[0] for e in edits], [e[1] for e in edits]

    def touch(self, low: int, high: int) -> bool:
        at = bisect_left(self.ends, low)
        return at < len(self.edits) and self.starts[at] <= high

    def within(self, low: int, high: int) -> list[tuple[int, int, str]]:
        return self.edits[bisect_left(self.starts, low) : bisect_right(self.ends, high)]


def trees_of(c: Codec, texts: pa.Array) -> list[CountTree]:
    """The trees of a batch of texts: all of their words are encoded."""
    words = c.cut(texts, False)
    numbers = c.numbers(words.distinct)
    counts = c.counts[numbers][words.at]
    lengths = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))[words.at]
    out, at = [], 0
    for n in words.sizes.tolist():
        dealt = np.arange(at, at + n, LEAF)
        if n:
            sizes, leaves = (np.add.reduceat(x[: at + n], dealt) for x in (lengths, counts))
        else:
            sizes = leaves = np.zeros(0, np.int64)
        out.append(CountTree.over(np.concatenate([[0], np.cumsum(sizes)]), leaves))
        at += n
    return out


def _touched(c: Codec, text: str, tree: CountTree, own: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """The runs of leaves that edits touch, each with its new pre-tokens."""
    if not len(tree.levels[0]):
        return [(0, -1, c.words(own[0][2]))]
    found, done, final, out = _Edits(own), -1, len(tree.starts) - 2, []
    for first, last in tree.regions([(s, e) for s, e, _ in own]):
        if last <= done:
            continue
        first = max(first, done + 1)
        low = int(tree.starts[first])
        while True:  # one leaf more, until the new pre-tokens meet an old border again
            while last < final and found.touch(tree.starts[last], tree.starts[last + 1]):
                last += 1  # the last leaf is context, which no edit touches
            high = int(tree.starts[last + 1])
            ahead = text[high : int(tree.starts[min(last + 2, final + 1)])]
            new = edited(text[low:high], found.within(low, high), low)
            fresh, ends, at = c.words(new + ahead), 0, 0
            while at < len(new):
                at += len(fresh[ends])
                ends += 1
            if at == len(new):
                break
            last += 1
        out.append((first, last, fresh[:ends]))
        done = last
    return out


def edited_trees(c: Codec, texts: list[str], trees: list[CountTree], edits: list) -> list[tuple[str, CountTree, int, int]]:
    """(text, tree, edits, pre-tokens counted again) of each text after its edits; the given trees are used up."""
    used = [usable_edits(e, len(t)) for t, e in zip(texts, edits, strict=True)]
    parts = [_touched(c, t, tree, own) if own else [] for t, tree, own in zip(texts, trees, used, strict=True)]
    size = c.sizes(w for own in parts for _, _, fresh in own for w in fresh)
    out = []
    for text, tree, own, runs in zip(texts, trees, used, parts, strict=True):
        if own:
            lengths = [(first, last, np.fromiter(map(len, fresh), np.int64, len(fresh)), np.fromiter(map(size.__getitem__, fresh), np.int64, len(fresh))) for first, last, fresh in runs]
            text, tree = edited(text, own), tree.replaced(lengths)
        out.append((text, tree, len(own), sum(len(fresh) for _, _, fresh in runs)))
    return out


def _columns(trees: list[CountTree]) -> list[pa.Array]:
    """Leaf starts and sums as Arrow columns."""
    join = lambda arrays: (np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int32), np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32))
    starts, bounds = join([t.starts for t in trees])
    sums, inner = join([x for t in trees for x in t.levels])
    outer = np.concatenate([[0], np.cumsum([len(t.levels) for t in trees], dtype=np.int64)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(starts)), pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(sums)))]


def _kept(b: pa.RecordBatch) -> list[CountTree]:
    """The trees of a batch of kept rows."""
    starts, levels = b["leaf_starts"], b["sums"]
    flat, bounds = starts.flatten().to_numpy().astype(np.int64), starts.offsets.to_numpy() - starts.offsets[0].as_py()
    inner, outer = levels.flatten(), levels.offsets.to_numpy() - levels.offsets[0].as_py()
    sums, cuts = inner.flatten().to_numpy().astype(np.int64), inner.offsets.to_numpy() - inner.offsets[0].as_py()
    level = lambda k: sums[cuts[k] : cuts[k + 1]]
    return [CountTree(flat[bounds[i] : bounds[i + 1]], [level(k) for k in range(outer[i], outer[i + 1])]) for i in range(b.num_rows)]


def build_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY) -> DataFrame:
    """``id_col, text, leaf_starts, sums``: each text (null: empty) with its tree, all of its words encoded."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b["id"], b["text"], *_columns(trees_of(codec(name), b["text"]))], names=["id", "text", "leaf_starts", "sums"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return by_batch(rows, f"id long, {TREE}", run).withColumnRenamed("id", id_col)


def apply_edits(trees: DataFrame, edits: str | Callable[[str], list] = "edits", id_col: str = "doc_id", name: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``id_col, n_tokens, n_tokens_after, n_edits, n_recounted`` and, unless ``counts_only``, the edited ``text`` with its
    ``leaf_starts`` and ``sums``, one row per row of kept trees.

    ``edits`` is a column of ``trees`` or a function of a text that gives its edits.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, kept = b["text"].to_pylist(), _kept(b)
        wanted = [edits(t) for t in texts] if callable(edits) else b["edits"].to_pylist()
        before = [t.total for t in kept]
        found = edited_trees(codec(name), texts, kept, wanted)
        numbers = [before, [t.total for _, t, _, _ in found], [n for _, _, n, _ in found], [n for _, _, _, n in found]]
        columns = [b["id"], *(pa.array(x, pa.int64()) for x in numbers)]
        if not counts_only:
            columns += [pa.array([t for t, *_ in found], pa.string()), *_columns([t for _, t, _, _ in found])]
        return pa.record_batch(columns, names=["id", "n_tokens", "n_tokens_after", "n_edits", "n_recounted", *([] if counts_only else ["text", "leaf_starts", "sums"])])

    own = [] if callable(edits) else [F.col(edits).cast(EDITS).alias("edits")]
    rows = trees.select(F.col(id_col).cast("long").alias("id"), "text", "leaf_starts", "sums", *own)
    schema = "id long, n_tokens long, n_tokens_after long, n_edits long, n_recounted long" + ("" if counts_only else f", {TREE}")
    return by_batch(rows, schema, run).withColumnRenamed("id", id_col)


#: What the cleaning edits replace: addresses, long numbers, and runs of blanks.
_CLEAN = re.compile(r"(?P<address>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+)|(?P<number>[0-9]{6,})|(?P<blank>[ \t]{2,})")
_NEW = {"address": "[ADDRESS]", "number": "[NUMBER]", "blank": " "}


def cleaning_edits(text: str) -> list[dict]:
    """The edits that a cleaning pass would make to a text."""
    return [{"start": m.start(), "end": m.end(), "text": _NEW[m.lastgroup]} for m in _CLEAN.finditer(text)]
