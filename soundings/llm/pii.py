"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Each document is scanned whole, on its own, so the work is one pass without a shuffle. The patterns are searched from
anchors (``@``, a digit run, ``+``), which keeps the scan linear in the text's length, also for very long runs.

Base kinds are always reported when they match and their check passes: ``email``, ``ip`` (parts of 255 at most),
``card`` (13 to 19 digits that pass Luhn), ``phone`` (9 to 15 digits). The method adds ``iban`` (mod 97) and ``ssn``,
which has no checksum and is reported only where a context word near it lifts its score to the threshold.

A null or empty text has no spans. Repeated rows, and those without an id, are scanned each on their own; an empty table gives
an empty one; masking carries extra columns as they are. Ties do not arise: spans of one kind never overlap, and spans of
different kinds are all reported.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts inside a digit run would also start at its first digit, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DOUBLE = str.maketrans("0123456789", "0246813579")

#: Score of a span whose check passed, before its context is read; the threshold; what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
THRESHOLD, LIFT, WINDOW = 0.5, 0.3, 48
#: Context words by kind.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
}


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2].translate(_DOUBLE)
    return (sum(map(int, odd)) + sum(map(int, even))) % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def _proposed(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    for m in _IBAN.finditer(text):
        if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c):
            spans.append(("iban", m.start(), m.end()))
    spans += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    return spans


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by kind and start; offsets count code points, the end is exclusive."""
    out = []
    for kind, start, end in _proposed(text or ""):
        near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
        score = min(1.0, PRIOR[kind] + LIFT * any(w in near for w in CONTEXT[kind]))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, end, round(score, 2)))
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans array<struct<kind,start,end,score>>``, one row per input row."""
    schema = "id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t)] for t in b["text"].to_pylist()]
        return pa.record_batch([b["id"], pa.array(spans, arrow)], names=["id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return by_batch(rows, schema, run).withColumnRenamed("id", id_col)


def masked(text: str | None) -> str | None:
    """The text with personal data replaced by its kind in brackets; spans that overlap are replaced as one, by the kind of the
    first (of those that start together, the longest)."""
    if not text or not (spans := scan(text)):
        return text
    out, at, covered = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= covered:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = covered = max(covered, end)
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; ``n_chars``, if there, follows the text."""
    schema = df.schema
    arrow_at = schema.names.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([masked(t) for t in b.column(arrow_at).to_pylist()], pa.string())
        return b.set_column(arrow_at, b.schema.field(arrow_at).with_type(pa.string()).with_nullable(True), texts)

    out = by_batch(df, schema, run)
    if "n_chars" in schema.names:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(schema["n_chars"].dataType))
    return out.select(*schema.names)


def pii_digest(df: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and the list of all spans."""
    found = find_pii(df)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def digest_by_hand(text: str | None) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in scan(text) if k in BASE).encode()).hexdigest()
