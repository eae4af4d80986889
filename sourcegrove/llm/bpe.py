"""Byte-pair encoding in linear time by backtracking, and decoding by an offset table.

One Aho-Corasick scan of a word from its end, over the tokens read backwards, gives the longest token that starts at each position.
The encoder takes it if the pair with the token before it is one that the merge procedure would leave standing; when no
shorter token fits, it takes the previous one back. A pair is compatible unless undoing both tokens' merges finds
a merge across their border that would have come first; what is found is kept in a table of pairs. This gives the exact result of
the merge list. What a worker remembers is bounded: some ten megabytes for words, fewer for pairs, and dropped after each partition.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as the tokenizer file's \s.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where str.split() takes more for white space than the file does.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile("[" + _WS + "]+")
_END = 0x1000  # added to a word's last symbol: "byte at the end of a word"
#: Words and pairs that a worker remembers in each of two generations: where the younger is full, it takes the older one's place.
WORDS, PAIRS = 100_000, 50_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


# Letters and numbers of Unicode 16 that Python's tables don't have yet, and capitals of Unicode 16 and 17 with their small letters.
NEWER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


@cache
def _ranges(category: str) -> str:
    """A regular expression's ranges of all code points of a general category."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == category:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*out, *NEWER[category]])


class Vocabulary:
    """A tokenizer file of kind BPE with an end-of-word suffix, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            """The token over an alphabet of 512: bytes, and bytes that end a word."""
            ended = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = [byte_of[c] for c in (token[: -len(suffix)] if ended else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + _END * ended)

        n = max([*ids.values(), *self.specials.values()]) + 1
        names = [""] * n
        for t, i in [*ids.items(), *self.specials.items()]:
            names[i] = t
        # rank: single symbols first, then merges in order; tokens are numbered by rank from here on
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        single = [t for t in ids if len(symbols(t)) == 1]
        self.id_of_rank = [ids[t] for t in single] + [ids[a + b] if not a.endswith(suffix) else ids[a[: -len(suffix)] + b] for a, b in merges]
        rank_of = {t: r for r, t in enumerate(single)}
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(single))]
        self.pairs: dict[tuple[int, int], int] = {}
        texts = [symbols(t) for t in single]
        for r, (a, b) in enumerate(merges, len(single)):
            rank_of.setdefault(a + b, r)
            self.split.append((rank_of[a], rank_of[b]))
            self.pairs[rank_of[a], rank_of[b]] = rank_of[a + b]
            texts.append(texts[rank_of[a]] + texts[rank_of[b]])
        self.length = [len(t) for t in texts]
        by_text = {t: r for r, t in reversed(list(enumerate(texts)))}
        #: The longest proper prefix that is a token, or -1.
        self.shorter = [next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1) for t in texts]
        #: Over the tokens read backwards: a scan from a word's end meets at each position the tokens that start there, the longest first.
        self.automaton = ahocorasick.Automaton()
        for t, r in by_text.items():
            self.automaton.add_word(t[::-1], r)
        self.automaton.make_automaton()
        # The offset table: token i's text and a space is blob[offset[i]:offset[i + 1]].
        parts = [t.encode() + b" " for t in names]
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.forget()
        letters, numbers = _ranges("L"), _ranges("N")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_WS}{letters}{numbers}]+")
        assert all(t.startswith("<|") for t in self.specials), "special tokens are expected to start with <|"
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def forget(self) -> None:
        """Drops what is remembered of words and pairs."""
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._older_pairs: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves `left` and `right` side by side, from the table of pairs."""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            known = self._older_pairs.get(pair)
            if known is None:
                known = self._compatible(left, right)
            if len(self._pairs) >= PAIRS:
                self._older_pairs, self._pairs = self._pairs, {}
            self._pairs[pair] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        split, pairs, limit = self.split, self.pairs, 1 << 60
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, part = left, split[left][1]
                if part != left:
                    left = part
                    continue
                limit, part = right + 1, split[right][0]
                if part == right:
                    return True
                right = part
            else:
                limit, part = right + 1, split[right][0]
                if part != right:
                    right = part
                    continue
                limit, part = left, split[left][1]
                if part == left:
                    return True
                left = part

    def encode_symbols(self, word: str) -> list[int]:
        """Ranks of one word given over the alphabet of 512."""
        n = len(word)
        longest = [-1] * n
        for end, token in self.automaton.iter(word[::-1]):
            if longest[n - 1 - end] < 0:  # at one end the longest comes first
                longest[n - 1 - end] = token
        usable = bytearray([1]) * (n + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        length, shorter, known = self.length, self.shorter, self._pairs.get
        while True:
            end = at + length[token]
            if usable[end]:
                fits = before < 0 or known(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    before, token = token, longest[at]
                    continue
            token = shorter[token]
            if token < 0:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
                # the border behind this token is closed now, so a shorter one is tried

    def word(self, piece: str) -> bytes:
        """One piece's ids as little-endian bytes."""
        raw = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        id_of = self.id_of_rank
        ids = [id_of[r] for r in self.encode_symbols(raw[:-1] + chr(ord(raw[-1]) + _END))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, token: str) -> bytes:
        """The ids of a run without white space; a piece never crosses white space. What is remembered are the pieces."""
        out = []
        for piece in self.pattern.findall(token):
            found = self._words.get(piece)
            if found is None:
                found = self._older.get(piece) or self.word(piece)
                if len(piece) <= 48:
                    if len(self._words) >= WORDS:
                        self._older, self._words = self._words, {}
                    self._words[piece] = found
            out.append(found)
        return b"".join(out)

    def ordinary(self, text: str) -> bytes:
        """The ids of a stretch of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # no final sigma: letters are lowered one by one
            if not text.isprintable() and _NEW_CAPITAL.search(text):  # code points that Python doesn't know are not printable
                text = text.translate(SMALL)
        text = text.lower()
        tokens = text.split() if not _CONTROL.search(text) else [t for t in _SPLIT.split(text) if t]
        run = self.run
        return b"".join([self._words.get(t) or run(t) for t in tokens])

    def encode(self, text: str) -> np.ndarray:
        """Ids as the file's library gives them without special tokens added; those in the text are found before it is normalised."""
        if self.cut and "<|" in text:
            raw = b"".join([struct.pack("<I", self.specials[s]) if k % 2 else self.ordinary(s) for k, s in enumerate(self.cut.split(text))])
        else:
            raw = self.ordinary(text)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts in UTF-8, gathered from the blob by the offset table, a space after each but the last (the file names no decoder)."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        end = np.cumsum(size)
        return self.blob[np.arange(end[-1]) + np.repeat(start - end + size, size)].tobytes()[:-1]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def bpe_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds ids (array<int>) and decoded (the text decoded).

    Null counts as empty: no tokens, digests of the empty string. Rows, also repeated ones, stay as they are; a null key
    stays null; other columns are not looked at. path must be readable on every executor.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for t in batch.column(1):
                found = v.encode(t.as_py() or "")
                out = v.decode(found)
                n.append(len(found))
                a.append(hashlib.sha256(found.tobytes()).hexdigest())
                b.append(hashlib.sha256(out).hexdigest())
                if with_ids:
                    ids.append(found.astype(np.int32))
                    texts.append(out.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
        v.forget()

    return rows.mapInArrow(encoded, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("k", key)
