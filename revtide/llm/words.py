"""Words of Arrow string columns as numpy arrays, for use inside Spark tasks.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), so UTF-8 texts need
no decoding. Words get 64-bit hashes that are the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(65535, _BASE, np.uint64)]))
    _HIGH = _POWERS[-1] * _BASE


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range (a bijection)."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(32))
        values = values * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(32)
    return values


@dataclass
class Words:
    """`hashes`, byte `starts` and `ends` of all words of all texts; `counts` has the words of each text."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and ends. NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words of every text of a column; `lower` hashes A-Z as a-z."""
    data, offsets = text_bytes(column)
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, np.zeros(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64))
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    after = np.concatenate([space[1:], [True]])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    table = _LOWER if lower else _PLAIN
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    with np.errstate(over="ignore"):
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + _CHUNK, "right")))
            span = slice(starts[low], ends[high - 1])
            letters = table[data[span][~space[span]]]
            sizes = ends[low:high] - starts[low:high]
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(letters)) - np.repeat(first, sizes)
            letters *= _POWERS[place & 0xFFFF]
            if sizes.max() > 0xFFFF:
                letters *= np.array([pow(int(_HIGH), int(i), 1 << 64) for i in range(int(sizes.max() >> 16) + 1)], np.uint64)[place >> 16]
            hashes[low:high] = np.add.reduceat(letters, first) + sizes.astype(np.uint64) * _STEP
            low = high
    return Words(data, mix(hashes), starts, ends, counts)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on; ignores borders of texts (see `inside`)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size), np.uint64)
        for i in range(size):
            out *= _BASE
            out += hashes[i : i + n]
    return mix(out)


def inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Which of the positions of `windows` have all their words in one text."""
    total = int(counts.sum())
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    return np.arange(n) + size <= np.repeat(np.cumsum(counts), counts)[:n]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator:
    """Cut a batch so that each part has about `limit` bytes of text at most (or one row)."""
    sizes = np.concatenate([[0], np.cumsum(np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1]))])
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(sizes, sizes[low] + limit, "right")) - 1
        high = min(max(high, low + 1), low + rows, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high
