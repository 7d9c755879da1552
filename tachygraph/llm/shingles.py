"""Hashed five-word shingle sets of many texts at once, with numpy on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        found = _powers[name] = np.multiply.accumulate(step)
    return found[:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lowered if asked), and for each text its first word's index, one more at the end.

    data: the UTF-8 bytes of the texts on end; bounds: where each text begins, and the end.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5)) if lower else data
    word = (low != 32) & ((low < 9) | (low > 13))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = bounds[:-1]
    edges = edges[edges < n]
    begins[edges] = word[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    terms = (low.astype(np.uint64) + np.uint64(1)) * word
    terms *= _power("up", _BASE, n)
    hashes = np.add.reduceat(terms, starts) * _power("down", _INVERSE, n)[starts]
    return mix(hashes), np.searchsorted(starts, bounds).astype(np.int64)


def text_bytes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK_BYTES: the first one's index, their UTF-8 bytes on end, and where each begins, with the end. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def windows(hashes: np.ndarray) -> np.ndarray:
    """Hashes of every five word hashes on end; empty if there are fewer."""
    m = max(0, len(hashes) - WORDS + 1)
    rows = np.zeros(m, np.uint64)
    for k in range(WORDS if m else 0):
        rows += hashes[k : k + m] * _PLACES[k]
    return mix(rows)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes: every five words on end, or all words of a shorter text; none for null."""
    for _, data, bounds in text_bytes(column):
        hashes, first = word_hashes(data, bounds)
        rows = windows(hashes)
        for i in range(len(bounds) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= WORDS:
                yield np.unique(rows[a : b - WORDS + 1])
            elif b > a:
                own = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([own], np.uint64))
            else:
                yield np.empty(0, np.uint64)
