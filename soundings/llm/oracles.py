"""DuckDB SQL of those text queries that SQL can express: all pairs instead of hashing, plain regexes instead of an index."""

from __future__ import annotations

import re

from .decontam import EXACT_WORDS, LEAST_WORDS, LONGEST, MATCHED
from .secrets import BASE_RULES, RULES

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COMPONENTS = """
reach(node, seen) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
least AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)"""

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, '{_CAPITALS}', '{_SMALL}'), ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, len(ws) AS m, unnest(ws) AS w FROM w),
s AS (SELECT doc_id, i, m, CASE WHEN m < 5 THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
ELSE concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM s WHERE i <= greatest(m - 4, 1)),
n AS (SELECT d.doc_id, count(x.g) AS n FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.c >= 75 * (p.n + q.n - c.c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), {_COMPONENTS}
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id, n.doc_id <= coalesce(low, n.doc_id) AS kept FROM n LEFT JOIN least ON node = n.doc_id
"""

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), {_COMPONENTS},
d AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id, v.vec_id <= coalesce(low, v.vec_id) AS kept FROM v LEFT JOIN d ON d.a = v.vec_id LEFT JOIN least ON node = v.vec_id
"""


_WORDS = "list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Every pair of equal words of a text and an item votes for the shift at which it lays the item on the text.
OP5 = f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '') x),
dw AS (SELECT r, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT r, {_WORDS} AS ws FROM d) y),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL), iw AS (SELECT item_id, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS j, unnest(ws) AS w FROM i WHERE len(ws) >= {LEAST_WORDS}),
m AS (SELECT r, item_id, n, pos - j AS shift, count(*) AS c, list(j) AS js FROM dw JOIN iw ON dw.w = iw.w GROUP BY ALL HAVING count(*) >= CASE WHEN n < {EXACT_WORDS} THEN n ELSE {MATCHED} * least(n, {LONGEST}) END),
h AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY c DESC, shift) AS place FROM m
WHERE c >= {MATCHED} * n OR list_max(list_transform(js, lambda a: len(list_filter(js, lambda b: b >= a AND b < a + {LONGEST})))) >= {MATCHED} * least(n, {LONGEST}))
SELECT doc_id, item_id, shift::BIGINT AS start_word, c::BIGINT AS n_matched, n::BIGINT AS n_item_words FROM h JOIN d ON d.r = h.r WHERE place = 1
"""


def _spans(rank: int) -> str:
    r = RULES[rank]
    regex = r.regex.replace("'", "''")
    if one := re.fullmatch(r"([A-Za-z]*)(\[[^]]*\])\+", regex):  # one greedy run: its least length can be asked of the regex
        regex = f"{one[1]}{one[2]}{{{r.least - len(one[1])},}}"
    counted = f"regexp_extract_all(text, '{regex}', {r.group})"
    return f"""SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(s := list_sum(gaps[1:i])::BIGINT + coalesce(list_sum(sizes[1:i - 1]), 0)::BIGINT, e := list_sum(gaps[1:i])::BIGINT + list_sum(sizes[1:i])::BIGINT, c := len(counted[i])))) AS x, {rank} AS rank, '{r.kind}' AS kind
FROM (SELECT doc_id, hits, counted, list_transform(hits, lambda h: length(h)) AS sizes, list_transform(string_split_regex(text, '{regex}'), lambda h: length(h)) AS gaps
FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}', 0) AS hits, {counted} AS counted FROM documents WHERE regexp_matches(text, '{regex}')) t WHERE len(hits) > 0) u"""


_KEPT = " UNION ALL ".join(f"SELECT doc_id, x.s AS s, x.e AS e, rank, kind FROM ({_spans(k)}) y WHERE x.c >= {r.least}" for k, r in enumerate(RULES))
_LISTED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
OP9 = f"""
WITH f AS ({_KEPT}), g AS (SELECT doc_id, {", ".join(f"count_if(kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)}, {_LISTED} FILTER (WHERE rank < {len(BASE_RULES)}) AS base, {_LISTED} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(g.n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


_STEP = "CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END"
#: CRC-32 by a table of its 256 bytes, and the best repair up to each row and state (0 nothing, 1 system, 2 user, 3 assistant) row by row.
OP11 = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, x: {_STEP}) ORDER BY k) AS t FROM range(256) r(k)),
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c1 AS (SELECT c0.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256))) % 20 AS kind FROM c0, tab),
c2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c1 WHERE kind <> 0),
c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i, right(rtrim(text, E' \\t\\n\\x0b\\f\\r'), 1) AS e, left(role, 1) AS ini FROM c2),
c4 AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
lag(ini) OVER w AS ini1, lag(turn) OVER w AS turn1 FROM c3 WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated,
count_if(ini1 || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n FROM c4 GROUP BY conv_id),
ins(st, then_, way) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
move(st, ini, then_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit AS (SELECT s.st, s.st AS then_, NULL AS ini, 'D' AS letter FROM range(4) s(st) UNION ALL SELECT st, then_, ini, 'K' FROM move UNION ALL SELECT st, then_, ini, 'R' FROM move WHERE ini <> 's'),
dp AS (SELECT conv_id, 0::BIGINT AS i, then_::BIGINT AS st, struct_pack(cost := 3 * length(way)::BIGINT, audit := way) AS best FROM facts JOIN ins ON ins.st = 0 UNION ALL
SELECT conv_id, i, then_::BIGINT, min(struct_pack(cost := best.cost + 3 * length(way), audit := best.audit || way)) FROM (
 SELECT d.conv_id, d.i + 1 AS i, e.then_ AS st, min(struct_pack(cost := d.best.cost + CASE e.letter WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, audit := d.best.audit || e.letter)) AS best
 FROM dp d JOIN c4 r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i JOIN edit e ON e.st = d.st AND (e.letter = 'D' OR (coalesce(r.fault, '') NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR e.ini = r.ini))) GROUP BY ALL) q JOIN ins ON ins.st = q.st GROUP BY conv_id, i, then_),
done AS (SELECT f.conv_id, min(best) AS best FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i WHERE st IN (0, 3) GROUP BY f.conv_id),
l0 AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS x, generate_subscripts(string_split(best.audit, ''), 1) AS p FROM done WHERE best.audit <> ''),
l1 AS (SELECT *, count_if(x <> 'I') OVER w - 1 AS i, count_if(x <> 'D') OVER w - 1 AS k FROM l0 WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
l2 AS (SELECT l1.*, r.role, r.text, max(CASE WHEN x = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l1.conv_id) AS sys FROM l1 LEFT JOIN c4 r ON r.conv_id IS NOT DISTINCT FROM l1.conv_id AND r.i = l1.i),
text_ AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role ELSE CASE WHEN (k - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole FROM l2 WHERE x <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN text_ t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Every phrase of every piece, counted plainly.
OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) r(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a)),
s AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT s.lang, s.phrase, s.a, l.a AS l, r.a AS r, total.n, s.cut, ((1000::HUGEINT * s.a * total.n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM s JOIN total ON total.lang = s.lang
JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(ws[1 : cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(ws[cut + 1 :], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""


def sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_embeddings": OP2, "op5_decontamination": OP5, "op9_secrets": OP9, "op11_conversations": OP11, "op12_phrases": OP12}
