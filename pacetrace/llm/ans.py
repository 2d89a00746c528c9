"""Static range asymmetric numeral system over integer symbols, in many interleaved lanes.

A block holds ``n`` symbols; symbol ``i`` belongs to lane ``i % lanes``.  Every lane keeps a 64-bit state in
[2**31, 2**63) and passes 32-bit words to one stream that all lanes share: when decoding, at each step the lanes that run
low take the next words in order of their number.  A symbol's share is its frequency out of ``2**SCALE_BITS``.
"""

from __future__ import annotations

import numpy as np

from .textops import U64

SCALE_BITS = 20
LOW = U64(1 << 31)
MAX_LANES = 4096


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``2**SCALE_BITS``, at least one for each symbol that occurs."""
    total, scale = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.maximum((counts.astype(np.float64) * (scale / total)).astype(np.int64), (counts > 0).astype(np.int64))
    over = int(freq.sum()) - scale
    order = np.argsort(-freq, kind="stable")
    at = 0
    while over:  # round-off, settled on the most frequent symbols
        step = min(over, max(1, int(freq[order[at]]) // 8)) if over > 0 and freq[order[at]] > 1 else (over if over < 0 else 0)
        freq[order[at]] -= step
        over -= step
        at = (at + 1) % len(order)
    return freq.astype(np.uint32)


def lanes_for(n: int) -> int:
    return int(min(MAX_LANES, max(1, n // 64)))


def encode_block(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    """States of all lanes, then the words in the order in which a decoder takes them."""
    n, lanes = len(symbols), lanes_for(len(symbols))
    state = np.full(lanes, LOW, U64)
    words: list[np.ndarray] = []
    bits = U64(SCALE_BITS)
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        s = symbols[at : at + lanes]
        x, f = state[: len(s)], freq[s]
        full = x >= (f << U64(63 - SCALE_BITS))
        if full.any():
            words.append((x[full] & U64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> U64(32), x)
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + cum[s]
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, freq: np.ndarray, cum: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
    lanes = lanes_for(n)
    state = np.frombuffer(data, "<u8", lanes).astype(U64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(U64)
    out, at = np.empty(n, np.uint32), 0
    bits, mask = U64(SCALE_BITS), U64((1 << SCALE_BITS) - 1)
    for i in range(0, n, lanes):
        x = state[: min(lanes, n - i)]
        slot = x & mask
        s = symbol_of[slot.astype(np.int64)]
        out[i : i + len(x)] = s
        x = freq[s] * (x >> bits) + slot - cum[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << U64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return out


def decoding_tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies and their running sums as 64-bit values, and the symbol of each slot."""
    f = freq.astype(U64)
    cum = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(U64)
    return f, cum, np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
