"""Arrow text columns as flat numpy arrays: bytes, words, hashes, windows.

A column of texts is one byte array and the offsets of its rows; nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whitespace that separates words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20_240_917).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WORD_BYTE = np.where(IS_SPACE, np.uint64(0), _BYTE)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator:
    """The batches cut so that the texts of each take about ``max_bytes`` at most.

    A longer text comes alone and whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        index = batch.schema.get_field_index(column)
        if pa.types.is_string(batch.schema.field(index).type):
            # 32-bit offsets hold a batch, not what is joined from several
            batch = batch.set_column(index, column, batch.column(index).cast(pa.large_string()))
        sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(before, before[start] + max_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a text column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, bounds)``: byte spans of all words; row ``r`` has words ``bounds[r]:bounds[r + 1]``."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values from polynomial hashes."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(np.diff(starts, append=len(data)).max()) + 1
    powers = np.cumprod(np.full(longest, BASE, dtype=np.uint64))
    data, at = data[starts[0] :], starts - starts[0]
    place = np.arange(len(data)) - np.repeat(at, np.diff(at, append=len(data)))
    sums = np.add.reduceat(_WORD_BYTE[data] * powers[place], at)
    return mixed(sums + (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, to build gram hashes from."""
    return _BYTE[data]


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of each run of ``q`` consecutive values (unmixed)."""
    if len(values) < q:
        return np.zeros(0, np.uint64)
    if q == 1:
        return values
    half = q // 2
    part = gram_hashes(values, half)
    power = np.uint64(pow(int(BASE), half, 1 << 64))
    out = part[: len(part) - half] * power + part[half:]
    return out if q % 2 == 0 else out[:-1] * BASE + values[q - 1 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``lengths[0]`` values, then the next run, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift
