"""NumPy kernels over Arrow string columns: word bounds, word hashes and shingles of whole texts.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Those bytes never occur
inside a multi-byte UTF-8 character, so working on bytes gives the same words as
working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The byte itself, A-Z lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), _U(base))
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, what = column.buffers()
    if len(column) == 0 or what is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(what, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK_BYTES of text each; rows are never cut."""
    _, off = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every word."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = off[:-1][off[:-1] < len(data)]
    first[begins] = inside[begins]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    return mix((total[e] - total[s]) * _power("down", _INVERSE, n + 1)[s] + (e - s).astype(np.uint64))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles.

    A row with 1 to k-1 words has one shingle, its whole sequence; a row without words has none.
    """
    s, e, row = words(data, off)
    h = span_hashes(data, s, e)
    rows = len(off) - 1
    at = np.searchsorted(row, np.arange(rows + 1))
    grams = mix(h, 1)
    n = len(h)
    for j in range(1, k):
        if n - j > 0:
            grams[: n - j] = mix(grams[: n - j] * _U(0x9FB21C651E98DF25) + h[j:], j + 1)
    out = []
    for i in range(rows):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = mix(np.array([b - a], np.uint64), 77)
            for x in h[a:b]:
                whole = mix(whole * _U(0x9FB21C651E98DF25) + x, 78)
            out.append(whole)
        else:
            out.append(h[:0])
    return out
