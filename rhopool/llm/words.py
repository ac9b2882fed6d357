"""Numpy views of Arrow text columns: byte buffers, word tables and 64-bit word hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D, so a word never splits a UTF-8 sequence.
Hashes are polynomial sums over random byte values, finished by a 64-bit mixer; two different words share a hash
with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21  # text handled at once; one longer text is a block of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All that isn't a letter or digit; bytes beyond ASCII count as letters.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        _power = np.cumprod(steps, dtype=np.uint64)
    return _power[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash for each row of several hash columns, order included."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + p)
    return h


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES):
    """Yield (batch slice, bytes, offsets) with about ``limit`` bytes of text each; a null text is empty."""
    for batch in batches:
        col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        n = len(col)
        if not n:
            continue
        offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to


def word_table(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
    """Start, end and text number of every maximal run of bytes that aren't in ``between``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~between[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ordered and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = (_BYTE_LOWER if lower else _BYTE)[data[within + np.repeat(starts, lens)]]
    values *= powers(int(lens.max()))[within]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64) * _BASE)


def per_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the texts in a table of words ordered by text."""
    return np.searchsorted(doc, np.arange(n + 1))
