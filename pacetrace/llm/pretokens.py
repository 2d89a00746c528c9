"""Token ids of many texts at once: vectorised pre-tokens, and a cache of pre-tokens that the tokenizer has encoded.

A text is cut into pre-tokens by the tokenizer's own rule, worked out on arrays of character classes; the tokenizer encodes
each distinct pre-token once per worker.  Texts with characters outside a set whose classes and normal forms have been the
same in every Unicode version since 3.2, or with ``<|`` (special tokens), are encoded whole by the tokenizer.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import U64, chunks, mix, utf8

LETTER, NUMBER, SPACE, OTHER, UNSAFE = 1, 2, 3, 4, 0
KEY_BYTES = 24


@functools.cache
def _classes() -> np.ndarray:
    """Class of every character; what could differ between Unicode versions or under normalisation is UNSAFE."""
    old = unicodedata.ucd_3_2_0
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER}
    for c in range(0x21, 0xFFFF):
        if 0xAC00 <= c < 0xE000 or 0x1100 <= c < 0x1200:
            continue  # Hangul syllables are below; its parts and surrogates stay UNSAFE
        ch = chr(c)
        kind = old.category(ch)
        if kind == unicodedata.category(ch) and kind[0] in kinds and unicodedata.normalize("NFC", ch) == ch:
            low = ch.lower()
            if len(low) == 1 and kinds[kind[0]] == kinds.get(unicodedata.category(low)[0]) and unicodedata.normalize("NFC", low) == low:
                out[c] = kinds[kind[0]]
    out[0xAC00:0xD7A4] = LETTER
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


_TWO = {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}
_FIRST = np.zeros(128, np.uint8)
_FIRST[[ord(c) for c in "stmd"]] = 1
_FIRST[[ord(c) for c in "rvl"]] = 2
_SECOND = np.zeros(128, np.uint8)
_SECOND[[ord(c) for c in "rv"]] = ord("e")
_SECOND[ord("l")] = ord("l")


class Cutter:
    """Pre-tokens of a run of texts for the two byte-level rules in use.

    ``spaced``: a word takes the blank before it, numbers are runs, white space is kept.  Otherwise words, single number
    characters and runs of other characters, letters in either case for the clitics, white space dropped.
    """

    def __init__(self, spaced: bool) -> None:
        self.spaced = spaced

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First byte and length of each pre-token, offset of each text in that list, and which texts are unsafe."""
        lead = None
        if (data < 0x80).all():
            cps, docs = data.astype(np.uint32), off
        else:
            cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            docs = np.searchsorted(lead, off)
        n = len(cps)
        cls = _classes()[cps]
        texts = len(off) - 1
        unsafe = np.zeros(texts, bool)
        odd = np.flatnonzero(cls == UNSAFE)
        special = np.flatnonzero((cps[:-1] == 60) & (cps[1:] == 124)) if n else odd
        unsafe[np.searchsorted(docs, np.concatenate([odd, special]), "right") - 1] = True
        start = np.zeros(n + 1, bool)
        if n:
            start[1:n] = cls[1:] != cls[:-1]
            begin = docs[:-1][docs[:-1] < n]
            start[begin] = True
            edge = np.zeros(n + 1, bool)  # a text begins here
            edge[begin] = True
            edge[n] = True
            run = np.flatnonzero(start[:n])
            run_end = np.append(run[1:], n)
            if self.spaced:
                # The last blank of white space before a word belongs to the word; other white space there stands alone.
                gap = cls[run] == SPACE
                a, b = run[gap], run_end[gap]
                a, b = a[~edge[b]], b[~edge[b]]
                start[b - 1] = True
                start[b[cps[b - 1] == 32]] = False
            else:
                number = cls == NUMBER
                start[:n] |= number
            self._clitics(cps, cls, start, edge, run, run_end)
        at = np.flatnonzero(start[:n])
        end = np.append(at[1:], n)
        if not self.spaced and n:
            solid = cls[at] != SPACE
            at, end = at[solid], end[solid]
        per = np.searchsorted(at, docs)
        if lead is not None:
            place = np.append(lead, len(data))
            return place[at], place[end] - place[at], per, unsafe
        return at, end - at, per, unsafe

    def _clitics(self, cps, cls, start, edge, run, run_end) -> None:
        """An apostrophe alone, not taken by a blank, with s, t, m, d, re, ve or ll: one pre-token, and the rest another."""
        q = run[(cps[run] == 39) & (run_end - run == 1)]
        q = q[start[q] & ~edge[q + 1]]
        if not len(q):
            return
        fold = (lambda c: np.where((c >= 65) & (c <= 90), c + 32, c)) if not self.spaced else (lambda c: c)
        one = fold(cps[q + 1])
        take = np.where(one < 128, _FIRST[np.minimum(one, 127)], 0)
        two_at = np.minimum(q + 2, len(cps) - 1)
        two = fold(cps[two_at])
        fits = (take == 1) | ((take == 2) & (q + 2 < len(cps)) & ~edge[np.minimum(q + 2, len(cps))] & (two == _SECOND[np.minimum(one, 127)]))
        q, take = q[fits], take[fits].astype(np.int64)
        start[q + 1] = False
        start[q + 1 + take] = True


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


def word_keys(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of words of up to ``KEY_BYTES`` bytes as three integers each, zero-filled (no word holds a zero byte)."""
    padded = np.zeros(len(data) + KEY_BYTES, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + KEY_BYTES - 7,), "<u8", padded, 0, (1,))
    out = np.empty((3, len(at)), U64)
    for i in range(3):
        out[i] = wide[at + 8 * i] & _MASK[np.clip(length - 8 * i, 0, 8)]
    return out


class WordTable:
    """Open-addressing hash table from words of up to ``KEY_BYTES`` bytes, as ``word_keys``, to numbers."""

    def __init__(self, slots: int = 1 << 16) -> None:
        self.n = 0
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        self.keys, self.value = np.zeros((3, slots), U64), np.full(slots, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys[0] + keys[1] * U64(0x9E3779B97F4A7C15) + keys[2] * U64(0xC2B2AE3D27D4EB4F))
        return (h & U64(len(self.value) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not in the table."""
        out = np.full(keys.shape[1], -1, np.int64)
        left = np.arange(keys.shape[1])
        slot = self._slot(keys)
        while len(left):
            v = self.value[slot]
            same = (self.keys[0][slot] == keys[0][left]) & (self.keys[1][slot] == keys[1][left]) & (self.keys[2][slot] == keys[2][left]) & (v >= 0)
            out[left[same]] = v[same]
            go = ~same & (v >= 0)
            left, slot = left[go], (slot[go] + 1) & (len(self.value) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct words that are not in the table."""
        if (self.n + len(values)) * 2 > len(self.value):
            full = self.value >= 0
            old, old_values = self.keys[:, full], self.value[full]
            self._empty(max(len(self.value), 1 << (2 * (self.n + len(values))).bit_length()))
            self._put(old, old_values)
        self._put(keys, values)
        self.n += len(values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        left, slot = np.arange(len(values)), self._slot(keys)
        while len(left):
            free = self.value[slot] == -1
            self.value[slot[free]] = -2 - left[free]  # of words that meet in a free slot one stays
            won = free & (self.value[slot] == -2 - left)
            self.keys[:, slot[won]] = keys[:, left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.value) - 1)
        settled = self.value < -1
        self.value[settled] = values[-2 - self.value[settled]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of one of each distinct word of ``keys``, which of these each word is, and how often each occurs."""
    order = np.lexsort(keys)
    k = keys[:, order]
    new = np.ones(k.shape[1], bool)
    new[1:] = (k[:, 1:] != k[:, :-1]).any(axis=0)
    which = np.empty(k.shape[1], np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], which, np.diff(np.append(first, k.shape[1]))


#: What an encoder's cache may hold when a run of texts begins; then it starts anew.
CACHE_BYTES = 64 << 20


class Encoder:
    """Ids of texts from a tokenizer file; one per worker and file."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        if kind not in ("ByteLevel", "Sequence"):
            raise ValueError(f"pre-tokens of {kind} are not known here")
        self.cutter = Cutter(spaced=kind == "ByteLevel")
        self.MAX_BYTES = cache_bytes
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable()
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.count, self.words = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def held(self) -> int:
        """Bytes of the cache."""
        return self.long_bytes + sum(x.nbytes for x in (self.table.keys, self.table.value, self.pool, self.begin, self.count))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and the number of ids of each."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)) if len(e.ids) else np.zeros(len(words), np.int64)

    def _learn(self, words: list[str]) -> int:
        """Encode new pre-tokens and keep their ids; the number of the first of them."""
        ids, count = self.encode_words(words)
        first = self.words
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.begin[first : first + len(words)] = self.filled + np.cumsum(count) - count
        self.count[first : first + len(words)] = count
        self.filled += len(ids)
        self.words += len(words)
        return first

    def numbers(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Number in this cache of each pre-token, learning those not met before."""
        if self.held() > self.MAX_BYTES:
            self._clear()
        out = np.empty(len(at), np.int64)
        short = length <= KEY_BYTES
        keys = word_keys(data, at[short], length[short]) if keys is None else keys[:, short]
        found = self.table.find(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            one, which, _ = distinct(keys[:, miss])
            where = np.flatnonzero(short)[miss[one]]
            raw = data.tobytes()
            first = self._learn([raw[a : a + n].decode() for a, n in zip(at[where].tolist(), length[where].tolist())])
            number = first + np.arange(len(one))
            self.table.add(keys[:, miss[one]], number)
            found[miss] = number[which]
        out[short] = found
        for i in np.flatnonzero(~short).tolist():
            word = data[at[i] : at[i] + length[i]].tobytes()
            number = self.long.get(word)
            if number is None:
                number = self._learn([word.decode()])
                if len(word) <= 4096:
                    self.long[word] = number
                    self.long_bytes += len(word) + 200  # with the entry itself
            out[i] = number
        return out

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts of a column: first row, their ids one after another, offset of each text in them."""
        data, off = utf8(column)
        for row, _, part, part_off in chunks(data, off):
            at, length, per, unsafe = self.cutter.cut(part, part_off)
            if unsafe.any():
                keep = np.repeat(~unsafe, np.diff(per))
                at, length, per = at[keep], length[keep], np.concatenate([[0], np.cumsum(np.where(unsafe, 0, np.diff(per)))])
            number = self.numbers(part, at, length)
            count = self.count[number]
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.pool[np.repeat(self.begin[number] - total[:-1], count) + np.arange(total[-1])]
            ends = total[per]
            if unsafe.any():
                pieces = [self.whole(part[part_off[i] : part_off[i + 1]].tobytes()) if unsafe[i] else ids[ends[i] : ends[i + 1]] for i in range(len(unsafe))]
                ids, ends = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            yield row, ids, ends


@functools.cache
def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The worker's encoder of a tokenizer file, with a cache of that size."""
    return Encoder(path, cache_bytes)
