"""Words, lines and their hashes straight from Arrow buffers, without one Python object per word.

A batch of texts is one array of UTF-8 bytes with an offset per text. Spans (words, lines) are found by byte
class, and a span's hash is a polynomial over random byte codes taken from running totals, so that the work is a
few numpy passes over the bytes. Blocks bound the memory, however long a text, line or word is.
Hashes have 64 bits; equal spans always have equal hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16
#: Odd and 3 modulo 8, so that powers differ as much as they can modulo 2**64.
BASE = 0x9E3779B97F4A7C1B
MASK = (1 << 64) - 1
STEP = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

RAW_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = RAW_CODES.copy()
LOWER_CODES[65:91] = RAW_CODES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(BLOCK + 1, BASE, np.uint64)
    down = np.full(BLOCK + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column one after another, and each text's first byte; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no break, and the index of each text's first run.

    A run never crosses from one text into the next.
    """
    n = len(data)
    solid = ~breaks[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens, closes = solid.copy(), solid
    if n:
        opens[1:] &= ~solid[:-1] | first[1:n]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def _long_span(data: np.ndarray, codes: np.ndarray) -> int:
    up, _ = _powers()
    total, scale, leap = 0, 1, pow(BASE, BLOCK, 1 << 64)
    for k in range(0, len(data), BLOCK):
        part = codes[data[k : k + BLOCK]]
        total = (total + scale * int((part * up[: len(part)]).sum(dtype=np.uint64))) & MASK
        scale = scale * leap & MASK
    return total


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + BLOCK, "right"))
        if j <= i:
            out[i] = _long_span(data[a : ends[i]], codes)
            i += 1
            continue
        total = np.zeros(ends[j - 1] - a + 1, np.uint64)
        np.cumsum(codes[data[a : ends[j - 1]]] * up[: len(total) - 1], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mix(out)


def batches_of(column, most_bytes: int = 2 << 20):
    """Slices (first, last) of an Arrow column of at most `most_bytes` each, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most_bytes, "right")) - 1)
        yield i, j
        i = j


def word_hashes(column, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and the index of each text's first word (one more at the end)."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = find_spans(data, offsets, SPACE)
    return hash_spans(data, starts, ends, LOWER_CODES if lower else RAW_CODES), bounds


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words that begin at each word, as far as they fit."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= STEP
        out += words[k : k + n]
    return mix(out)
