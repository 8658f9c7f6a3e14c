"""Tokens, edits, chunks and pages against plain versions."""

import itertools
import random

import numpy as np
import pytest

from soundings.llm import bpe, chunks, counts, frames, html

POOL = [" ", "the", "ing", "é", "a", "\n", "  ", "'s", "1234", "!!", "日本", "🙂", "<|endoftext|>", "_", "\t", "\0", "\x1c", "\x85", "　", "½"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(frames.tokenizer_path(bpe.VOCABULARY))


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(0)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 4000, " " * 3000, "=" * 800, "ab" * 2000, None, ""]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    c = bpe.codec()
    assert c.encode_batch(texts) == want
    assert [c.decode(i) for i in want[:500]] == [library.decode(i, skip_special_tokens=False) for i in want[:500]]
    df = spark.createDataFrame(list(enumerate(texts[-300:])), "doc_id long, text string")
    import hashlib

    for r in bpe.round_trip(df).collect():
        ids = want[len(texts) - 300 + r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def _some_edits(rng, texts):
    edits = []
    for t in texts:
        own = []
        for _ in range(rng.randint(0, 4)):
            s = rng.randint(-1, len(t or "") + 1)
            own.append({"start": s, "end": s + rng.choice([0, 0, 1, 5, 40]), "text": rng.choice(["", " ", "x", "\n", "new words ", "many more of them, " * 9, None])})
        edits.append(rng.choice([own, own, None]))
    return edits


def test_counts_follow_edits(monkeypatch):
    """Three rounds of edits on kept trees against a full recount of the edited texts."""
    monkeypatch.setattr(counts, "LEAF", 6)
    monkeypatch.setattr(counts, "MOST", 12)
    rng, c = random.Random(3), bpe.codec()
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(600)] + [" ".join(rng.choice(["alpha", "be,ta", "x"]) for _ in range(rng.randint(1, 90))) for _ in range(600)] + [""]
    size = lambda t: sum(map(c.sizes(c.words(t)).__getitem__, c.words(t)))
    trees = counts.trees_of(c, frames.pa.array(texts))
    assert [t.total for t in trees] == [size(t) for t in texts]
    for _ in range(3):
        edits = _some_edits(rng, texts)
        found = counts.edited_trees(c, texts, trees, edits)
        for t, e, (text, tree, n, _) in zip(texts, edits, found, strict=True):
            used = counts.usable_edits(e, len(t))
            assert (text, n, tree.total, tree.starts[-1]) == (counts.edited(t, used), len(used), size(text), len(text)), (t, used)
            assert all((np.add.reduceat(low, np.arange(0, len(low), 2)) == high).all() for low, high in zip(tree.levels, tree.levels[1:], strict=False))
        texts, trees = [f[0] for f in found], [f[1] for f in found]


def test_kept_trees_in_spark(spark, tmp_path):
    """Trees are written, read, edited, written, read and edited again; each time the counts are those of new trees."""
    rng, c = random.Random(5), bpe.codec()
    texts = [" ".join(rng.choice(["alpha", "be,ta", "x", "mail a@b.org", "1234567"]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["", None, "word " * 40000]
    rows = [(i if i % 9 else None, t, "own", 1) for i, t in enumerate(texts)] + [(1, texts[1], "own", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sums string, n_tokens int").repartition(3)
    counts.build_trees(df).write.parquet(f"{tmp_path}/trees")
    count = lambda t: sum(map(c.sizes(c.words(t)).__getitem__, c.words(t)))
    now = sorted(t or "" for _, t, _, _ in rows)
    for k in range(2):
        kept = spark.read.parquet(f"{tmp_path}/trees" if not k else f"{tmp_path}/edited{k - 1}")
        counts.apply_edits(kept, counts.cleaning_edits if not k else (lambda t: [{"start": 3, "end": 5, "text": "new"}])).write.parquet(f"{tmp_path}/edited{k}")
        got = spark.read.parquet(f"{tmp_path}/edited{k}").collect()
        change = counts.cleaning_edits if not k else (lambda t: [{"start": 3, "end": 5, "text": "new"}])
        after = sorted(counts.edited(t, counts.usable_edits(change(t), len(t))) for t in now)
        assert len(got) == len(rows) and sorted(r.text for r in got) == after
        assert all(r.n_tokens_after == count(r.text) == (r.sums[-1][0] if r.sums[0] else 0) for r in got)
        assert sum(r.n_tokens for r in got) == sum(map(count, now))
        now = after
    assert {r.doc_id for r in got} == {i for i, *_ in rows}
    edits = spark.read.parquet(f"{tmp_path}/trees").selectExpr("*", "array(named_struct('start', 0, 'end', 1, 'text', 'Z')) AS edits")
    for r in counts.apply_edits(edits, counts_only=True).collect():
        assert r.n_edits == 1 and r.n_recounted <= 4 * counts.LEAF
    assert counts.apply_edits(counts.build_trees(df.limit(0)), counts.cleaning_edits).count() == 0


def test_edits_touch_little():
    c = bpe.codec()
    text = " ".join(["word"] * 50000)
    trees = counts.trees_of(c, frames.pa.array([text]))
    before = trees[0].total
    _, tree, n, again = counts.edited_trees(c, [text], trees, [[{"start": 1000, "end": 1004, "text": "other"}]])[0]
    assert n == 1 and again < 4 * counts.LEAF and before == tree.total


def test_chunk_borders():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20000).astype(np.uint8)
    ends = chunks.borders(data)
    assert ends[-1] == len(data) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= chunks.MOST
    shifted = chunks.borders(np.concatenate([rng.integers(97, 123, 37).astype(np.uint8), data])) - 37
    assert len(np.intersect1d(ends, shifted)) > 0.98 * len(ends)
    assert len(chunks.borders(np.full(5000, 97, np.uint8))) >= 5000 // chunks.MOST and len(chunks.borders(data[:0])) == 0


def test_repeated_passages(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in ("ar", "en", "ip", "os") for c in ("", "t", "mé")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(70), text(8)
    rows = [(i, f"{text(50)} {passage} {text(rng.randint(20, 50))}" if i % 4 == 0 else f"{text(80)}\n{line}\n{text(30)}") for i in range(40)] + [(40, None), (41, ""), (42, "x" * 30000)]
    rows.append(rows[1])
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(range(0, 40, 4))
    by = dict(rows)
    for r in got:
        assert r.first_doc_id == 0 and r.kept == (r.doc_id == 0)
        assert by[r.doc_id][r.start : r.end] in f" {passage} " or passage in by[r.doc_id][r.start - 200 : r.end + 200]
    left = {r.doc_id: r.text for r in chunks.drop_repeats(spark.createDataFrame(rows[:40], "doc_id long, text string")).collect()}
    assert left[0] == by[0] and left[1] == by[1] and len(left[4]) < len(by[4])


def _plain_passages(rows):
    """Regions by hand, from the chunks of each text."""
    chunked = {}
    for doc, text in rows:
        if doc is not None and text:
            raw = text.encode()
            ends = chunks.borders(np.frombuffer(raw, np.uint8)).tolist()
            chunked[doc, text] = [(s, e, raw[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
    holders = {}
    for (doc, _), own in chunked.items():
        for _, _, piece in own:
            holders.setdefault(piece, set()).add(doc)
    out = []
    for (doc, text), own in chunked.items():
        raw, regions, last = text.encode(), [], None
        begun = lambda s, e: sum(raw[k] not in b" \t\n\v\f\r" and (k == 0 or raw[k - 1] in b" \t\n\v\f\r") for k in range(s, e))  # noqa: E731, B023
        for s, e, piece in own:
            if len(holders[piece]) > 1:
                if last != s:
                    regions.append([])
                regions[-1].append((s, e, min(holders[piece]), begun(s, e)))
                last = e
        for r in regions:
            kept = sum(n for _, _, f, n in r if f == doc)
            if sum(n for *_, n in r) < chunks.WORDS:
                continue
            for mine, part in itertools.groupby(r, lambda x: x[2] == doc):  # noqa: B023
                part = list(part)
                if not mine or kept >= chunks.WORDS:
                    place = lambda k: sum(x & 0xC0 != 0x80 for x in raw[:k])  # noqa: E731, B023
                    out.append((doc, place(part[0][0]), place(part[-1][1]), sum(x[3] for x in part), len(part), min(x[2] for x in part), mine))
    return sorted(out)


def test_passages_by_hand(spark):
    """Overlapping, nested and repeated passages, ids that repeat with other texts or are missing, extra columns."""
    rng = random.Random(17)
    words = [a + b + c for a in "bdfgkl" for b in ("ar", "en", "ip", "os", "ü") for c in ("", "t", "mé", "x")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    stock = [text(n) for n in (12, 30, 55, 90)]
    rows = [(i % 45, " ".join(x for _ in range(3) for x in (text(rng.randint(0, 20)), rng.choice(stock)))) for i in range(50)]
    rows += [(60, None), (61, ""), (None, stock[3]), (70, stock[3]), (70, stock[3]), (70, stock[2]), (71, "a" * 3000), (72, "a" * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, th string").repartition(3)
    got = sorted((r.doc_id, r.start, r.end, r.n_words, r.n_chunks, r.first_doc_id, r.kept) for r in chunks.repeated_passages(df).collect())
    assert got == _plain_passages(rows) and got
    left = chunks.drop_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    cut = {}
    for doc, s, e, *_, mine in got:
        if not mine:
            cut.setdefault(doc, []).append((s, e))
    single = {i: t for i, t in rows if sum(i == k for k, _ in rows) == 1 and t}
    for r in left.where("doc_id IS NOT NULL").collect():
        if r.doc_id in single:
            t = single[r.doc_id]
            assert r.text == "".join(c for k, c in enumerate(t) if not any(s <= k < e for s, e in cut.get(r.doc_id, [])))
    assert chunks.repeated_passages(df.limit(0)).count() == 0 == chunks.drop_repeats(df.limit(0)).count()


def test_passages_around_a_phrase_of_a_smaller_document(spark):
    """Document 1 holds words 20 to 33 of a passage of 52 that documents 5 and 9 hold whole."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    for _ in range(3):
        passage = text(52)
        rows = [(1, " ".join(text(60) + passage[20:34] + text(60)))] + [(k, " ".join(text(50) + passage + text(50))) for k in (5, 9)]
        got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.n_words for r in got if r.doc_id == 5) == sum(r.n_words for r in got if r.doc_id == 9) >= 25
        own = [r for r in got if r.doc_id == 5]
        assert {r.kept for r in own} == {True, False} and not any(r.kept for r in got if r.doc_id == 9)
        assert {r.doc_id for r in got} == {5, 9}


PAGE = """<html><head><title>T &amp; x</title></head><body class="home"><header><h1>Site</h1></header><nav><ul><li><a href=x>a</a></ul></nav>
<div class="cookie-notice">we use</div><aside>side</aside><main><article class="post"><h2>Head &eacute;</h2><p>One <b>two<br>three<p>Four &lt;x&gt; <i>five</i></p><div class="ad">buy</div><form>sub<input></form><ul><li>l1<li>l2</ul>
<section id="comments"><article><p>comment</p></article></section></article></main><footer>f</footer><script>var a="</p>";</script></body></html>"""


def test_main_text(spark):
    assert html.main_text(PAGE) == "Head é\n\nOne two three\n\nFour <x> five\n\nl1\n\nl2"
    assert [html.main_text(x) for x in (None, "", "plain text", "<p>a<p>b", "a < b <c")] == ["", "", "plain text", "a\n\nb", "a < b <c"]
    body = '<body><div class=top>Welcome home</div><div id=content><h1>Title {0}</h1><p>Body {0} text long enough here.<p>More {0}.</div><div class=bottom>All rights</div></body>'
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(8)] + [(8, "http://h.example/8", None), (9, None, "<p>alone</p>"), (9, None, "<p>alone</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 11
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "Title 3\n\nBody 3 text long enough here.\n\nMore 3." and texts[8] == "" and texts[9] == "alone"
    assert all(r.n_chars == len(r.text) for r in got)


def test_classes_by_hand(spark):
    """Occurrence vectors, classes and their nesting against plain dictionaries; the join's three ways agree."""
    rng = random.Random(2)
    item = lambda k: f"<li class=i><div class=a>Go {k}</div><div class=b>See</div><div class=c>Now</div></li>"
    page = lambda i: f"<body><div class=top>Hello</div><ul>{''.join(item(k) for k in range(2 + i % 3))}</ul><table><tr class=x><td class=a>A<td class=b>B<td class=c>C</table>{'<p>odd</p>' * (i % 2)}<p>Text {rng.random()} of its own.</p><div class=end>Bye</div></body>"
    rows = [(i, f"https://Site{i % 3}.example:80/p?{i}", page(i)) for i in range(36)] + [(100 + i, "http://few.example/", page(i)) for i in range(4)] + [(None, "https://site0.example/", page(1)), (200, None, None), (201, None, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, template string, host int").repartition(4)
    seen: dict = {}
    for i, url, text in rows:
        if i is not None and text:
            _, counts, around = html.parse(text)
            for token, n in counts.items():
                own = seen.setdefault((url or "").lower().split("/")[2].split(":")[0], {}).setdefault(token, [{}, around[token]])
                own[0][i] = n
    want = set()
    for site, found in seen.items():
        pages = {i for own, _ in found.values() for i in own}
        vector = {t: frozenset(own.items()) for t, (own, _) in found.items() if len(own) >= max(html.PAGES, html.SHARE * len(pages))}
        outer = {t: vector.get(found[t][1]) if vector.get(found[t][1]) != vector[t] else None for t in vector}
        groups: dict = {}
        for t, v in vector.items():
            around = {outer[x] for x in vector if vector[x] == v and outer[x] is not None}
            groups.setdefault((v, outer[t] if len(around) > 1 else next(iter(around), None)), set()).add(t)
        want |= {frozenset(g) for g in groups.values() if len(g) >= html.TOKENS}
    got = html.classes(df).collect()
    assert {frozenset(r.tokens) for r in got} == want and len(got) >= 6 and any(r.outer is not None for r in got)
    assert {r["class"] for r in got} >= {r.outer for r in got if r.outer is not None}
    texts = sorted((r.page_id or -1, r.text) for r in html.extract(df).collect())
    assert len(texts) == len(rows) and all("Text" in t and "Hello" not in t and "Bye" not in t for i, t in texts if 0 <= i < 36)
    for limits in ((60, 11), (0, 0)):
        html.BROADCAST_TOKENS, html.HOT_PAGES, old = *limits, (html.BROADCAST_TOKENS, html.HOT_PAGES)
        try:
            assert sorted((r.page_id or -1, r.text) for r in html.extract(df).collect()) == texts
        finally:
            html.BROADCAST_TOKENS, html.HOT_PAGES = old
    assert html.extract(df.limit(0)).count() == 0
    deep = "<div>" * 60000 + "</span>" * 60000 + "text" + "<a>" * 20000
    assert html.main_text(deep) == "text"


def test_templates_inside_articles(spark):
    """Boilerplate without class words goes from a main element too, and standing blocks do not split a text."""
    body = '<body><div class=top>Welcome</div><main><h1>Title {0}</h1><p>Body {0} is long enough to be text.</p><p>Licensed to all.</p><p>After {0} more.</p><p>By the staff</p></main></body>'
    split = '<body><div class=top>Welcome</div><div id=text><p>The first half {0} is the longer one of both.</p><h2 class=q>Summary</h2><p>Second half {0}.</p></div><div class=links><a href=x>Next of page {0}</a></div></body>'
    rows = [(i, f"http://a.example/{i}", body.format(i)) for i in range(8)] + [(i, f"http://b.example/{i}", split.format(i)) for i in range(8, 16)]
    rows += [(i, "http://c.example/", "<body><main><h1>Same</h1><p>on every page</p></main>") for i in range(16, 24)]
    texts = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts[3] == "Title 3\n\nBody 3 is long enough to be text.\n\nAfter 3 more."
    assert texts[9] == "The first half 9 is the longer one of both.\n\nSecond half 9."
    assert texts[17] == "Same\n\non every page"


def test_unclosed_and_wrappers():
    text = "<h1>A title</h1><p>The text of the page.</p>"
    want = "A title\n\nThe text of the page."
    for page in (
        f"<html><head><meta charset=x><title>t</title>{text}",
        f"<html><head><title>t</title><body>{text}",
        f"<button>{text}",
        f"<object data=x>{text}<button>b</button>",
        f'<div class="content no-sidebar">{text}</div>',
        f'<div class="post has-comments">{text}<div class="share-line">Share</div></div>',
        f'<div class="site-navigation-top">{text}</div>',
    ):
        assert html.main_text(page) == want, page
    assert html.main_text("<head><title>t</title>plain text") == "plain text"
    assert html.main_text(f'{text}<div class="related-posts"><p>Other</p></div><object>a<object>b</object></object>') == want
