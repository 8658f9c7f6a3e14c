"""Main text of web pages by equivalence-class template deduction.

1. Each page is cut into structural tokens (block tags with their path of tags and classes) and text blocks.
2. Over the pages of a host, every token has an occurrence vector: how often it occurs in each page. Tokens with equal
   vectors form an equivalence class. Vectors are never gathered: a class is known by the number of pages and a sum of
   64-bit hashes of (page, count), which is built with partial aggregates, so a host of any size is one small row per
   token and task.
3. Classes nest: each token knows the block around it, and a class lies within the class of the blocks around its tokens. One
   whose tokens lie in several other classes is divided by these. A class is valid if it then has at least ``TOKENS`` tokens
   and lies in nearly all of the host's pages. The nested valid classes are the host's template: its texts are boilerplate,
   and what lies between its tokens are slots.
4. Template blocks and those of navigation, advertising and the like (by tag and by class or id words) are dropped from
   every page, and the rest lies in slots. If the slot with the most unlinked text lies in an article or main element, that
   element's blocks are taken; else every slot that is not mostly links, and those of links between two such slots of one
   parent. A page with nothing but template blocks keeps them: nothing tells its text from its host's.

A class or id counts if it is a listed word; one with a listed word among its parts ('share-line', but not 'no-sidebar')
counts unless its element wraps content: a first heading, an article, or half of the page's unlinked text.

Templates are a row per host. Up to ``BROADCAST_TOKENS`` tokens they are broadcast to the pages, which then are not shuffled.
Beyond that, those of hosts of more than ``HOT_PAGES`` pages still are, as long as they are that small, and the pages of all
other hosts are joined by host, so that no host's pages fill a task.
A host with fewer than ``PAGES`` pages has no template and only step 4 applies.

A null or empty page has an empty text and no part in its host's vectors. Character references are decoded, white space inside a block becomes one space,
blocks are joined by two line feeds in page order. Unclosed tags end with their parents, an unclosed head with the first content. Repeated rows are pages of
their own in the result; for the vectors, pages are told apart by id, and pages without an id have no part. An empty table
gives an empty one; extra columns are not carried. Very deep or unclosed pages cost in proportion to their length.
"""

from __future__ import annotations

import re
from html import unescape
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_batch, stored

PAGES, TOKENS, SHARE = 5, 3, 0.95
BROADCAST_TOKENS, HOT_PAGES = 2_000_000, 50_000

_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_CLOSED = re.compile(r"<(noscript|template|svg|object|select|button)\b[^>]*>(?:(?!<\1\b).)*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"""(</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>)""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_STATE = re.compile(r"(?:no|non|not|has|have|with|without|is|hide|hidden)(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_OUT_TAGS = frozenset("nav footer header aside form menu dialog title head".split())
_HEAD = frozenset("head title base link meta script style noscript template html".split())
_OUT_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu"
    " modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related reply replies respond"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_IN_TAGS = frozenset(("article", "main"))


class Block:
    """A text block: its text, whether its place is excluded or in an article, its linked characters, tokens and parent."""

    __slots__ = ("linked", "main", "out", "parent", "slot", "text", "token")

    def __init__(self, text: str, out: bool, main: bool, linked: int, slot: int, token: int, parent: int):
        self.text, self.out, self.main, self.linked, self.slot, self.token, self.parent = text, out, main, linked, slot, token, parent


def _visible(html: str) -> str:
    """The page without comments, scripts and controls; of a control that is never closed only the tag goes."""
    html = _SILENT.sub(" ", html)
    while (shorter := _CLOSED.sub(" ", html)) != html:  # innermost first
        html = shorter
    return html


def _excluded(marks: str) -> int:
    """2 if a class or id is a listed word, 1 if only a part of one is, else 0."""
    if _OUT_WORDS.isdisjoint(_WORD.findall(marks)):
        return 0
    names = marks.split()
    if not _OUT_WORDS.isdisjoint(names):
        return 2
    return int(any(not _STATE.match(x) and not _OUT_WORDS.isdisjoint(_WORD.findall(x)) for x in names))


def parse(html: str | None) -> tuple[list[Block], dict[int, int], dict[int, int]]:
    """Text blocks in page order, how often each structural or text token occurs, and the token of the block around it (0: none)."""
    blocks: list[Block] = []
    counts: dict[int, int] = {}
    around: dict[int, int] = {}
    if not html:
        return blocks, counts, around
    stack: list[tuple[str, int, int, int, int, int]] = []  # tag, path hash, excluded depth, article depth, doubtful element, block path
    opened: dict[str, int] = {}  # elements of each tag on the stack
    path = out = main = linked = 0
    slot, parts = 0, []
    doubt: list[list] = [[0, True, 0]]  # elements excluded by a part of a name: parent, holds content, unlinked characters
    inside: list[int] = []  # doubtful element of each block

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        del stack[depth:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                token = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), path & 0xFFFFFFFF) >> 1 | 1 << 40
                counts[token] = counts.get(token, 0) + 1
                around[token] = stack[-1][5] if stack else 0
                blocks.append(Block(text, out > 0, main > 0, linked, slot, token, stack[-2][1] if len(stack) > 1 else 0))
                inside.append(stack[-1][4] if stack else 0)
            parts.clear()
        linked = 0

    for piece in _TAG.split(_visible(html)):
        if not piece:
            continue
        if piece[0] != "<" or not (m := _NAME.match(piece)):
            if piece[:2] not in ("<!", "<?"):
                if stack and stack[-1][0] == "head" and not piece.isspace():
                    close(len(stack) - 1)
                    path, out, main = stack[-1][1:4] if stack else (0, 0, 0)
                parts.append(piece)
                if opened.get("a"):
                    linked += len(piece.strip())
            continue
        name = m[1].lower()
        if piece[1] != "/" and name not in _HEAD:
            depth = next((k for k in range(min(3, len(stack))) if stack[k][0] == "head"), None) if opened.get("head") else None
            if depth is not None:
                flush()
                close(depth)
                path, out, main = stack[-1][1:4] if stack else (0, 0, 0)
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if piece[1] == "/":
            if not opened.get(name):
                continue
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        else:
            if (closes := _CLOSES.get(name)) and any(map(opened.get, closes)):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        close(k)
                        break
                    if stack[k][0] in _BLOCK and stack[k][0] not in ("p", "li"):
                        break
            marks = " ".join(filter(None, (x for g in _MARKS.findall(piece) for x in g))).lower() if "=" in piece else ""
            above = stack[-1] if stack else ("", 0, 0, 0, 0, 0)
            path = crc32(f"/{name}.{marks}".encode(), above[1])
            sort = _excluded(marks) if marks and name not in ("html", "body") else 0
            excluded, within = above[2] + (name in _OUT_TAGS or sort == 2), above[4]
            if sort == 1 and not excluded:
                doubt.append([within, False, 0])
                within = len(doubt) - 1
            if within and not excluded and (name in _IN_TAGS or name == "h1"):
                k = within
                while k:
                    doubt[k][1], k = True, doubt[k][0]
            if not piece.endswith("/>"):
                stack.append((name, path, excluded, above[3] + (name in _IN_TAGS and not excluded), within, path if name in _BLOCK else above[5]))
                opened[name] = opened.get(name, 0) + 1
            if name in _BLOCK:
                counts[path] = counts.get(path, 0) + 1
                around[path] = above[5]
                slot = path
        top = stack[-1] if stack else ("", 0, 0, 0, 0, 0)
        path, out, main = top[1], top[2], top[3]
    flush()
    if len(doubt) > 1:
        for b, k in zip(blocks, inside, strict=True):
            while k and not b.out:
                doubt[k][2], k = doubt[k][2] + len(b.text) - b.linked, doubt[k][0]
        total = sum(len(b.text) - b.linked for b in blocks if not b.out)
        for b, k in zip(blocks, inside, strict=True):
            while k and not b.out:
                b.out, k = not doubt[k][1] and 2 * doubt[k][2] < total, doubt[k][0]
    return blocks, counts, around


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given the tokens of its host's template."""
    blocks = [b for b in parse(html)[0] if not b.out]
    blocks = [b for b in blocks if b.token not in template] or blocks
    if not blocks:
        return ""
    slots: list[list[Block]] = []
    current = None
    for b in blocks:
        place = b.slot if b.slot in template else current
        if not slots or place != current or not template:
            slots.append([])
            current = place
        slots[-1].append(b)
    plain = [sum(len(b.text) - b.linked for b in s) for s in slots]
    if any(b.main for b in slots[plain.index(max(plain))]):
        return "\n\n".join(b.text for b in blocks if b.main)
    dense = [2 * n >= sum(len(b.text) for b in s) for s, n in zip(slots, plain, strict=True)]
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for k, s in enumerate(slots):
        if dense[k]:
            for b in s:
                first.setdefault(b.parent, k)
                last[b.parent] = k
    between = lambda k, b: first.get(b.parent, k) < k < last.get(b.parent, k)
    return "\n\n".join(b.text for k, s in enumerate(slots) for b in s if dense[k] or between(k, b))


def host(url):
    """The host of a URL column, as a 64-bit hash."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)))


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, host, token, around, n``: how often each token occurs in each page; token 0 stands for the page itself."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for page, site, html in zip(*(b[c].to_pylist() for c in ("page_id", "host", "html")), strict=True):
            _, counts, around = parse(html)
            counts[0], around[0] = 1, -1
            rows[0].extend([page] * len(counts))
            rows[1].extend([site] * len(counts))
            rows[2].extend(counts)
            rows[3].extend(map(around.__getitem__, counts))
            rows[4].extend(counts.values())
        return pa.record_batch([pa.array(r, pa.int64()) for r in rows], names=["page_id", "host", "token", "around", "n"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return by_batch(rows.where("page_id IS NOT NULL AND html <> ''"), "page_id long, host long, token long, around long, n long", run)


def classes(pages: DataFrame) -> DataFrame:
    """``host, all, class, outer, tokens``: the valid equivalence classes of each host of so many pages, each with the class
    that it lies in (null: none)."""
    vector = F.sum(F.xxhash64("page_id", "n").cast("decimal(20,0)")).alias("vector")
    seen = tokens(pages).groupBy("host", "token").agg(F.count("*").alias("pages"), vector, F.min("around").alias("around")).where(F.col("pages") >= PAGES)
    seen = stored(seen.withColumn("class", F.xxhash64("pages", "vector")))
    everywhere = seen.where("token = 0").select("host", F.col("pages").alias("all"))
    usual = seen.where("token <> 0").join(everywhere, "host").where(F.col("pages") >= SHARE * F.col("all")).select("host", "all", "token", "around", "class")
    enclosing = usual.select("host", F.col("token").alias("around"), F.col("class").alias("outer"))
    placed = usual.join(enclosing, ["host", "around"], "left").withColumn("outer", F.when(F.col("outer") != F.col("class"), F.col("outer")))
    several = Window.partitionBy("host", "class")
    placed = placed.withColumn("apart", F.min("outer").over(several) != F.max("outer").over(several))
    divided = placed.withColumn("outer", F.when(F.col("apart"), F.col("outer")).otherwise(F.max("outer").over(several)))
    return divided.groupBy("host", "all", "class", "outer").agg(F.collect_set("token").alias("tokens")).where(F.size("tokens") >= TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """``host, all, template array<long>``: the tokens of the nested valid classes of each host."""
    return classes(pages).groupBy("host", "all").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    known = stored(templates(pages))
    small = lambda t: (t.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_TOKENS
    hot = known.where(F.col("all") > HOT_PAGES)
    if small(known):
        rows = own.join(F.broadcast(known), "host", "left")
    elif small(hot):
        served = own.join(F.broadcast(hot), "host", "left")
        cool = served.where("template IS NULL").drop("all", "template").join(known.where(F.col("all") <= HOT_PAGES), "host", "left")
        rows = served.where("template IS NOT NULL").unionByName(cool)
    else:
        rows = own.join(known, "host", "left")
    rows = rows.select("page_id", "url", "html", "template")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[tuple, frozenset[int]] = {}
        texts = []
        for html, template in zip(b["html"].to_pylist(), b["template"].to_pylist(), strict=True):
            key = tuple(template or ())
            texts.append(main_text(html, sets.get(key) or sets.setdefault(key, frozenset(key))))
        return pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return by_batch(rows, "page_id long, url string, text string", run).withColumn("n_chars", F.length("text").cast("long"))
