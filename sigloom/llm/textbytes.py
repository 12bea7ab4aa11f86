"""Words, shingles and hashes of Arrow text columns, computed on the raw UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))
#: Bytes of text handled at once, so that the 8-byte arrays made from it stay small.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and the len+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """Runs of rows of about `size` bytes (one row at least): (first row, bytes, offsets)."""
    raw, offs = buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the len+1 offsets of each row's words among them."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offs] = True
    begins = begins[:-1]
    before = np.empty(len(raw), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (begins | ~before))
    after = np.empty(len(raw), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~begins[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    powers = np.full(int(lengths.max()), BASES[base], dtype=U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)
    firsts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = raw[within + np.repeat(starts, lengths)].astype(U64) + U64(1)
    values *= powers[within]
    return mix(np.add.reduceat(values, firsts) ^ (lengths.astype(U64) * BASES[1 - base]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one row; of the whole sequence if it has fewer words; none without words."""
    if not len(words):
        return np.zeros(0, U64)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, U64(k), dtype=U64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * BASES[0]
        out ^= out >> U64(29)
    return mix(out)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the len+1 offsets of each row's words."""
    low = LOWER[raw]
    starts, ends, rows = word_spans(low, offs)
    return span_hashes(low, starts, ends), rows
