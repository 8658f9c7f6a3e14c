"""Byte-pair encoding and decoding by a traversal of a trie of distinct words.

The pre-tokens ("words") of a batch of texts are made distinct and put into a byte trie; a depth-first walk gives each
node, that is each prefix of some word, the last token of its encoding. The encoding of a prefix is the encoding of a
shorter prefix plus one token, and exactly one vocabulary token that ends there fits behind the last token of that
shorter prefix, so shared prefixes are encoded once and a word's tokens are read off by going back from its node.

Whether two tokens may stand side by side is decided by undoing merges at their border, latest first: the pair is
wrong if some border pair would have been merged before one of the undone merges.

Encoding equals the ``tokenizers`` library's with ``add_special_tokens=False``; strings of special tokens in a text
become those tokens. Decoding joins the tokens' bytes. A null text is an empty one: no tokens, empty decoded text.
Very long words are walked with an explicit stack of nodes, linear in their length. Work is per batch of rows and needs
no shuffle; each worker remembers the encodings of at most ``CACHE_WORDS`` words, from one task to the next.

Texts are cut into words by Arrow, a batch at once, and each distinct word of a batch is met once in Python; ids, listed
ids and decoded bytes of the texts are gathered from their words' by index.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, tokenizer_path

#: The pattern of the byte-level pre-tokenizer (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what a worker remembers: words, their ids, and pairs of tokens.
CACHE_WORDS, CACHE_IDS, CACHE_PAIRS = 300_000, 3_000_000, 200_000
VOCABULARY = "byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
    return letters


class Vocabulary:
    """Tokens as bytes, the two halves of each merged token, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.ids = ids
        self.bytes = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}  # of a merge, by its halves
        self.halves: dict[int, tuple[int, int]] = {}
        self.age: dict[int, int] = {i: 0 for i in self.single}  # when a token's merge comes; single bytes first
        for n, pair in enumerate(model["merges"], 1):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (ids[bytes(letters[c] for c in x)] for x in (left, right))
            token = ids[self.bytes[a] + self.bytes[b]]
            self.rank.setdefault((a, b), n)
            self.halves.setdefault(token, (a, b))
            self.age.setdefault(token, n)
        self.starts = {b[:n] for b in ids for n in range(len(b) + 1)}
        self.states: dict[bytes, int] = {b"": 0}  # of the automaton below: the longest end of a text that starts a token
        self.names: list[bytes] = [b""]
        self.ending: list[list[tuple[int, int]]] = [[]]  # the tokens that end there, longest first
        self.moves: dict[int, int] = {}
        self.length = {i: len(b) for i, b in self.bytes.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined bytes gives just these two tokens."""
        if (known := self._fits.get((left, right))) is None:
            if len(self._fits) > CACHE_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._stays(left, right)
        return known

    def _stays(self, a: int, b: int) -> bool:
        # Going back in time from the finished pair: before merge number `now`, a and b stand at the border.
        age, halves, rank = self.age, self.halves, self.rank
        now = len(rank) + 1
        while True:
            if rank.get((a, b), now) < now:
                return False
            older_left, older_right = age[a], age[b]
            if not older_left and not older_right:
                return True
            # Undo the later merge; of two with one number, the left one was made first, so the right goes first.
            if older_left > older_right:
                now, a = older_left, halves[a][1]
            else:
                # a merge that would take place at the very moment of the right one is tried earlier, further left
                now, b = older_right + 1, halves[b][0]

    def move(self, state: int, byte: int) -> int:
        """The automaton's next state, made when first asked for."""
        name = self.names[state] + bytes([byte])
        while name not in self.starts:
            name = name[1:]
        if (new := self.states.get(name)) is None:
            new = self.states[name] = len(self.names)
            self.names.append(name)
            ends = (name[len(name) - n :] for n in range(len(name), 0, -1))
            self.ending.append([(len(e), self.ids[e]) for e in ends if e in self.ids])
        self.moves[state << 8 | byte] = new
        return new

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words by one depth-first walk over their trie."""
        seen, fits, length = self._fits, self.fits, self.length
        moves, move, ending = self.moves, self.move, self.ending
        out: dict[bytes, tuple[int, ...]] = {}
        last: list[int] = []  # the last token of each prefix on the path from the root
        state: list[int] = [0]  # and the automaton's state there
        path = b""
        for word in sorted(words):  # sorted words meet the trie's nodes in depth-first order
            shared, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del last[shared:], state[shared + 1 :]
            at, end = state[shared], shared
            for byte in word[shared:]:
                end += 1
                if (new := moves.get(at << 8 | byte)) is None:
                    new = move(at, byte)
                at = new
                state.append(at)
                for n, token in ending[at]:
                    if n == end:
                        break
                    before = last[end - n - 1]
                    if (ok := seen.get((before, token))) is None:
                        ok = fits(before, token)
                    if ok:
                        break
                last.append(token)
            path = word
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at - 1])
                at -= length[tokens[-1]]
            out[word] = tuple(reversed(tokens))
        return out


#: Stands before a special token: no pre-token has white space between other characters.
SPECIAL = "\0 "
#: Characters that every Unicode version since 11 sorts into the same classes; texts of these alone are cut by Arrow.
_STABLE = r"\x{0001}-\x{052F}\x{2010}-\x{2027}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FEF}"
#: Other characters, white space other than blanks and line feeds, or white space that touches another.
_ODD = rf"[^{_STABLE}]|[\t\x0b\f\r\x1c-\x1f\x85\x{{A0}}]|[ \n][ \n]"
#: The same pattern for texts that are not odd, in whose single white space no look-ahead is needed.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \n\p{L}\p{N}]+|[ \n]"


class Words:
    """The pre-tokens of a batch of texts: the distinct ones, and for each place the number of the one that stands there."""

    def __init__(self, distinct: list[str], at: np.ndarray, sizes: np.ndarray):
        self.distinct, self.at, self.sizes = distinct, at, sizes  # sizes: pre-tokens of each text


class Codec:
    """Encodes and decodes whole texts; made once per worker.

    Words, once encoded, are remembered up to ``CACHE_WORDS``: their ids lie in one array, found by a word's number.
    """

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.marks = "|".join(map(re.escape, v.special)) or None
        table = [b""] * (max(v.bytes) + 1)
        for i, b in v.bytes.items():
            table[i] = b
        self.table = pa.array(table, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        """Let go of everything but the vocabulary."""
        self.known: dict[str, int] = {}
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.vocabulary._fits.clear()

    def _learn(self, words: list[str]) -> None:
        """Encode the given distinct words, which are new, and remember them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        marked = len(SPECIAL)
        codes = self.vocabulary.encode_words(set(raw))
        found = [(self.vocabulary.special[w[marked:]],) if w.startswith(SPECIAL) else codes[b] for w, b in zip(words, raw, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))
        self.known.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts, self.pool = np.concatenate([self.counts, counts]), np.concatenate([self.pool, flat])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words, which say where their ids lie."""
        if len(self.known) + len(words) > CACHE_WORDS or len(self.pool) > CACHE_IDS:
            self.forget()
        known = self.known
        if new := [w for w in words if w not in known]:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def split(self, text: str, special: bool = True) -> list[str]:
        """The pre-tokens of a text and, if asked for, its special tokens."""
        if special and self.special is not None and any(s in text for s in self.vocabulary.special):
            return [p for part in self.special.split(text) if part for p in ([SPECIAL + part] if part in self.vocabulary.special else self.words(part))]
        return self.words(text)

    def cut(self, texts: pa.Array, special: bool = True) -> Words:
        """The pre-tokens of a batch of texts. Odd texts are cut one by one by the pattern, all others at once by Arrow."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        if special and self.marks:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.marks))
        parted = pc.replace_substring_regex(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), _PLAIN, "\\0\0")
        lists = pc.split_pattern(parted, "\0")
        flat = lists.flatten().dictionary_encode()
        distinct, at = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes) - 1  # behind the last mark of each text lies an empty piece
        at = np.delete(at, ends)
        sizes = sizes - 1
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(where):
            return Words(distinct, at, sizes)
        number = {w: i for i, w in enumerate(distinct)}
        inserted, before = [], np.concatenate([[0], np.cumsum(sizes)])
        done = 0
        for i in where.tolist():
            own = self.split(texts[i].as_py(), special)
            inserted += [at[done : before[i]], np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own))]
            done, sizes[i] = before[i], len(own)
        return Words(list(number), np.concatenate([*inserted, at[done:]]), sizes)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, and how many each text has."""
        words = self.cut(texts)
        numbers = self.numbers(words.distinct)[words.at]
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words.sizes)])]
        return ids, np.diff(bounds)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        ids, counts = self.encode_texts(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def sizes(self, words: Iterable[str]) -> dict[str, int]:
        """Numbers of tokens of the given words; special tokens count as ordinary text."""
        words = list(dict.fromkeys(words))
        numbers = self.numbers(words)
        return dict(zip(words, self.counts[numbers].tolist(), strict=True))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(name: str = VOCABULARY) -> Codec:
    """This process's codec for a vocabulary file."""
    path = tokenizer_path(name)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _shown(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(df: DataFrame, name: str = VOCABULARY, text_col: str = "text", into: str = "ids") -> DataFrame:
    """The rows with a column ``into array<int>`` added, whose name must be free."""
    if into in df.columns:
        raise ValueError(f"there is a column {into} already")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = codec(name).encode_texts(b[text_col])
        return pa.record_batch([*b.columns, _lists(ids, counts)], names=[*b.schema.names, into])

    return by_batch(df, f"{_shown(df)}, `{into}` array<int>", run)


def decode(df: DataFrame, name: str = VOCABULARY, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with a column ``into string`` added, whose name must be free."""
    if into in df.columns:
        raise ValueError(f"there is a column {into} already")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(name)
        texts = [c.decode(i or ()) for i in b[ids_col].to_pylist()]
        return pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    return by_batch(df, f"{_shown(df)}, `{into}` string", run)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def _joined(values: pa.Array, counts: np.ndarray, by) -> list:
    """Buffers of the values of each list, joined."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), values)
    return [x.as_buffer() for x in pc.binary_join(lists, by)]


def _digested(df: DataFrame, name: str, carried: list[str], with_ids: bool) -> DataFrame:
    """Encode, decode and digest in one pass: the carried columns, counts, digests and, if asked for, the ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(name)
        ids, counts = c.encode_texts(b["text"])
        listed = _joined(pa.array(ids).cast(pa.large_string()), counts, pa.scalar(",", pa.large_string()))
        decoded = _joined(c.table.take(pa.array(ids)), counts, pa.scalar(b"", pa.large_binary()))
        digests = [hashlib.sha256(x).hexdigest() for x in listed]
        texts = [hashlib.sha256(bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in decoded]
        columns = [*(b[x] for x in carried), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        if with_ids:
            columns.append(_lists(ids, counts))
        return pa.record_batch(columns, names=[*carried, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = f"{_shown(df.select(*carried))}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return by_batch(df.select(*carried, F.col("text").cast("string").alias("text")), schema, run)


def round_trip(df: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    return _digested(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), name, ["doc_id"], False)


def encoded_corpus(df: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids`` of each document."""
    return _digested(df, name, ["doc_id", "lang", "source"], True)
