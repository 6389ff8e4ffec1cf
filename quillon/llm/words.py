"""Vectorised word kernels over Arrow string buffers.

Texts reach Python as Arrow batches; these kernels work on the UTF-8 bytes of
many texts at once and never build a Python string per word.  Null texts count
as empty.  Work goes in chunks of about CHUNK bytes cut at text boundaries, so
memory follows the largest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240611))
#: One random odd-free 64-bit value per byte; words hash to a polynomial in them.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_ODD = [int(x) * 2 + 1 for x in _rng.integers(1, 2**62, 64)]

_arange = np.arange(256)
LOWER = np.where((_arange >= 65) & (_arange <= 90), _arange + 32, _arange).astype(np.uint8)
#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACE_WORDS = ~((_arange == 32) | ((_arange >= 9) & (_arange <= 13)))
#: Alphanumeric words of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = ((_arange >= 0x30) & (_arange <= 0x39)) | ((_arange >= 0x61) & (_arange <= 0x7A)) | (_arange >= 0x80)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for k, base in enumerate((_BASE, _INV)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of consecutive texts: starts, ends (byte positions) and ptr (first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORDS, lower: bool = False):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        mask = is_word[self.data]
        before, after = np.empty_like(mask), np.empty_like(mask)
        if len(mask):
            before[1:], before[0] = mask[:-1], False
            after[:-1], after[-1] = mask[1:], False
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            before[offsets[full]] = False
            after[offsets[full + 1] - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.mask = mask

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every text, batch and task."""
        power, inverse = _power_tables(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, U64)
        total[0] = 0
        np.cumsum(BYTE_VALUE[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are missing."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, U64)
    for k in range(n):
        total += hashes[k : k + size] * U64(_ODD[k % 64])
    return mix(total)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes, for any n in the same time: differences of one running sum."""
    size = max(0, len(hashes) - n + 1)
    power, inverse = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[n : n + size] - total[:size]) * inverse[:size])


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of about limit bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def batches_of(column: pa.Array, is_word: np.ndarray = SPACE_WORDS, lower: bool = False, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    data, offsets = string_buffers(column)
    for i, j, part, places in chunks(data, offsets, limit):
        yield i, j, Words(part, places, is_word, lower)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs that Spark has."""
    return x.view(np.int64)
