"""Words and word shingles of whole texts as numpy arrays, many texts at a time.

A word is a run of characters other than space and U+0009 to U+000D. All of these are single bytes
that no multi-byte UTF-8 character contains, so the work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(*numbers: int) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for n in numbers:
        out = mix(out + np.uint64((n * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    return out[0]


_BASE = 0x9DDFEA08EB382D69
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one array of bytes, and where each begins; null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple]:
    """``(rows, bytes, offsets)`` of at most ``limit`` bytes, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = flat(batch.column(text))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of the first word of each text (and the total)."""
    inside = ~WHITE[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = ~inside[:-1]
    begins[at] = True
    start = np.flatnonzero(inside & begins[:-1])
    closes = begins[1:].copy()
    closes[:-1] |= ~inside[1:]
    return start, np.flatnonzero(inside & closes) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of ``width`` words; a shorter text is one shingle."""
    count = np.diff(first)
    of = np.repeat(np.arange(len(count)), count)
    left = first[1:][of] - np.arange(len(hashes))  # words from here to the end of the text
    size = np.minimum(left, width)
    total = mix(size.astype(np.uint64))
    for j in range(width):
        part = np.zeros(len(hashes), np.uint64)
        part[: max(len(hashes) - j, 0)] = hashes[j:]
        total = total + np.where(j < size, mix(part + salt(j)), np.uint64(0))
    whole = (left >= width) | (left == count[of])
    return mix(total[whole]), of[whole]
