"""Words, word hashes and shingles of many texts at once, straight from Arrow buffers.

Words are maximal runs of bytes other than ASCII white space, compared after lower-casing A-Z.  A word hash is a sum of a
random 64-bit value per byte times a random value per position, then mixed: two different words agree with a chance below
2**-56.  Shingles combine the hashes of consecutive words the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
LONG_BYTES = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_u64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers of a seed."""
    i = np.arange(1, n + 1, dtype=U64) + (U64(seed) << U64(32))
    return mix(i * U64(0x9E3779B97F4A7C15)) | U64(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = random_u64(256, 1)[_LOWER]
_PLACE = random_u64(4096, 2)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = random_u64(1 << (n - 1).bit_length(), 2)
    return _PLACE


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column and the offset of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, row after the last, bytes, offsets."""
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of every word, and the offset of each text in the list of words."""
    solid = ~_IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = off[(off > 0) & (off < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end - start, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a run of texts, and the offset of each text in that list."""
    if len(off) == 2 and len(data) > LONG_BYTES:  # a very long text, piece by piece
        parts, at = [], 0
        while at < len(data):
            end = at + LONG_BYTES // 2
            while end < len(data) and not _IS_SPACE[data[end]]:
                end += 1
            parts.append(word_hashes(data[at:end], np.array([0, len(data[at:end])]))[0])
            at = end
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    start, length, texts = word_bounds(data, off)
    if not len(start):
        return np.zeros(0, U64), texts
    solid = data[~_IS_SPACE[data]]
    before = np.cumsum(length) - length
    place = np.arange(len(solid)) - np.repeat(before, length)
    value = _BYTE[solid] * _places(int(length.max()))[place]
    return mix(np.add.reduceat(value, before) + length.astype(U64)), texts


_STEP = random_u64(64, 3)


def shingle_hashes(words: np.ndarray, texts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a text, in order, and the offset of each text in that list.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    n = np.diff(texts)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], U64)
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, U64)
        for j in range(size):
            total += words[j : j + len(total)] * _STEP[j]
        long = np.repeat(n >= size, count)
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - texts[:-1], count)
        out[long] = mix(total[at[long]])
    for i in np.flatnonzero((n > 0) & (n < size)):
        w = words[texts[i] : texts[i + 1]]
        out[offsets[i]] = mix((w * _STEP[: len(w)]).sum(keepdims=True) + U64(len(w)))[0]
    return out, offsets


def text_shingles(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, int]]:
    """Row, shingle hashes in order, and number of words of every text of a column."""
    data, off = utf8(column)
    for row, _, part, part_off in chunks(data, off):
        words, texts = word_hashes(part, part_off)
        found, at = shingle_hashes(words, texts, size)
        for i in range(len(part_off) - 1):
            yield row + i, found[at[i] : at[i + 1]], int(texts[i + 1] - texts[i])
