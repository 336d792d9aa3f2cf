"""Word shingle sets of texts as sorted 64-bit hashes, computed on the bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are hashed in chunks of about this size, so that the 64-bit work arrays stay small

_RNG = np.random.default_rng(20240611)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), _BASE, np.uint64)
        steps[0] = 1
        have = _POWERS["p"] = np.cumprod(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text bytes, offsets of the rows in them) for runs of rows of about CHUNK_BYTES; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_hashes(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each row has. Words are maximal runs without ASCII space."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[text]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[text]] * powers, out=sums[1:])
    # The sum of a word carries base^begin; multiplying by base^(n - begin) gives all words the same factor base^n, which
    # differs between chunks, so it is divided out with the inverse of base^n.
    raised = (sums[end] - sums[begin]) * _powers(n + 1)[n - begin]
    factor = pow(int(_BASE), -n, 1 << 64)
    hashes = mixed(raised * np.uint64(factor) + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, offsets)
    return hashes, np.diff(first)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its `width`-word shingles; fewer words are one shingle, none none."""
    for _, text, offsets in chunks(column):
        words, counts = word_hashes(text, offsets)
        seen = 0
        for k in counts.tolist():
            own = words[seen:seen + k]
            seen += k
            if k == 0:
                yield own
                continue
            w = min(k, width)
            h = np.full(k - w + 1, np.uint64(w), np.uint64)
            for i in range(w):
                h = (h ^ own[i:k - w + 1 + i]) * _STEP
                h ^= h >> np.uint64(29)
            h = mixed(h)
            h.sort()
            if len(h) > 1:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
            yield h
