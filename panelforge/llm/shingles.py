"""Vectorised word and shingle fingerprints over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes worked on at once; whole texts are never cut, a longer one is a piece of its own.
PIECE_BYTES = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; the longest table so far is kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES), base, np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of several texts, and where each text's words begin.

    data: the UTF-8 bytes of the texts, one after the other; offsets: where each
    begins, and the end. Words are runs without ASCII white space, A-Z lowered.
    """
    with np.errstate(over="ignore"):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        space = _SPACE[data]
        inner = ~space
        starts = inner.copy()
        starts[1:] &= space[:-1] | edge[1:-1]
        ends = inner
        ends[:-1] &= space[1:] | edge[1:-1]
        at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
        words = mix((sums[to] - sums[at]) * _powers(_inverse(_BASE), n + 1)[at])
    return words, np.searchsorted(at, offsets)


def text_pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES):
    """(first row, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece_bytes, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every run of `width` words of one text; a shorter text is one run, none if empty."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(words) if len(words) < width else width, np.uint64)
        for k in range(min(width, len(words))):
            out = (out + words[k : k + n]) * _STEP
        return mix(out)
