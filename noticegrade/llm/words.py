"""Words of many texts at once, as 64-bit hashes, straight from Arrow's text buffers.

A word is a maximal run of bytes of one class (classes are closed under UTF-8, so a run of
bytes is a run of whole characters). A word's hash is a polynomial over its bytes modulo 2^64,
finished by a bijective mix; equal words have equal hashes, and A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Bytes that separate words: white space only, or everything of ASCII but 0-9, a-z and A-Z.
SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Texts are taken together up to about so many bytes; a longer text is taken alone and whole.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    table = mix(np.arange(256, dtype=np.uint64), 7)
    table[65:91] = table[97:123]
    return table


_LETTERS = _letters()
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
        if size <= 8 * SLICE_BYTES:  # what one very long text needs isn't kept
            _powers[name] = have
    return have[:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin and end. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that results travel in small parts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; every row is in exactly one."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word range of each row, first byte of each word) of some rows.

    ``offsets`` has the rows' limits in ``data``; ``rows[i]:rows[i + 1]`` are row i's words.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[base:end], offsets - base
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    limits = offsets[:-1][offsets[:-1] < n]
    first[limits] = inside[limits]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows, starts
    with np.errstate(over="ignore"):
        value = _LETTERS[data]
        value *= _power("up", _BASE, n)
        value *= inside
        total = np.add.reduceat(value, starts) * _power("down", _INVERSE, n)[starts]
    return mix(total), rows, starts
