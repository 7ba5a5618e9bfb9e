"""Words of whole text columns as arrays: boundaries and 64-bit hashes without a Python object per word.

A word is a run of bytes that are no ASCII white space (`[^\\x20\\x09-\\x0D]+`). Work goes in chunks of about CHUNK bytes of whole
texts, so memory follows the longest text, not the batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # the next `done` powers are the first ones times base^done
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of whole texts, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end), the same wherever the range lies."""
    n = len(c)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("inverse", _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(c: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word in bytes that hold whole texts one after another."""
    if not len(c):
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = SPACE[c]
    before = np.empty(len(c), bool)
    before[0] = True
    before[1:] = blank[:-1]
    cut = np.zeros(len(c) + 1, bool)
    cut[doc_starts] = True  # a text's start ends the word before it
    starts = np.flatnonzero(~blank & (before | cut[:-1]))
    after = np.empty(len(c), bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(doc_starts, starts, "right") - 1


def hashed_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of rows [i, j): i, j, its bytes, and each word's row (from i), start, end and hash."""
    offsets, data = text_bytes(column)
    for i, j in chunks(offsets):
        c = data[offsets[i] : offsets[j]]
        if lower:
            c = LOWER[c]
        starts, ends, row = word_spans(c, offsets[i:j] - offsets[i])
        yield i, j, c, row, starts, ends, hashed(c, starts, ends) if len(starts) else np.zeros(0, np.uint64)
