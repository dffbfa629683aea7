"""Vectorised text kernels: words and their 64-bit hashes straight from Arrow's UTF-8 buffers.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one
prefix sum over the whole batch, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that one numpy pass takes; one longer text is taken whole.
SLICE = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but blank and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits and every byte of a longer code point.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_powers = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        if size > 1:
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same rows in pieces of about ``size`` bytes of text, with the text's bytes and offsets.

    After the last one, what Arrow's pool keeps goes back to the system: idle workers hold no buffers.
    """
    for batch in batches:
        raw, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, end - start), raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
    pa.default_memory_pool().release_unused()


def words(raw: np.ndarray, offsets: np.ndarray, of: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and each row's first word (one more entry than rows)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    if lower:
        raw = LOWER[raw]
    inside = of[raw]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    cut = offsets[offsets < n]
    before[cut] = False
    first = inside & ~before[:n]
    after[cut] = False
    last = inside & ~after[1:]
    if len(cut):  # a row's last byte ends its word
        ends_at = cut[cut > 0] - 1
        last[ends_at] = inside[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers_of(BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers_of(INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), starts, ends, np.searchsorted(starts, offsets)


def beginnings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of each word's first ``size`` bytes (A-Z lowered), words by sizes; 0 where the word is not longer."""
    out = np.zeros((len(starts), len(sizes)), np.uint64)
    if not len(starts):
        return out
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers_of(BASE, len(raw)), out=sums[1:])
    base, back = sums[starts], _powers_of(INVERSE, len(raw))[starts]
    for k, size in enumerate(sizes):
        h = (sums[np.minimum(starts + size, len(raw))] - base) * back
        out[:, k] = np.where(ends - starts > size, mix(h ^ np.uint64(size * 0x51ED2701)), np.uint64(0))
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within a row, and each row's first run.

    A row with fewer words has one run of all of them; a row without words has none.
    """
    counts = np.diff(rows)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.zeros(len(rows), np.int64)
    np.cumsum(runs, out=first[1:])
    if not len(hashes):
        return np.zeros(0, np.uint64), first
    pad = np.concatenate([hashes, np.zeros(n, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        total += pad[k : k + len(hashes)] * np.uint64(0xA0761D6478BD642F * (2 * k + 3) % (1 << 64) | 1)
    out = np.zeros(int(first[-1]), np.uint64)
    long = counts >= n
    keep = np.ones(len(hashes), bool)  # the last n - 1 words of a row begin no run
    for k in range(1, n):
        tail = rows[1:] - k
        keep[tail[(tail >= rows[:-1])]] = False
    where = np.repeat(long, runs)
    keep &= np.repeat(long, counts)
    out[where] = mix(total[keep])
    for r in np.flatnonzero((counts > 0) & ~long):
        h = np.array([counts[r]], np.uint64)
        for w in hashes[rows[r] : rows[r + 1]]:
            h = mix(h * np.uint64(31) + w)
        out[first[r]] = h[0]
    return out, first


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    bits = 1 << max(16, int(8 * len(of)).bit_length())
    seen = np.zeros(bits, bool)
    seen[of & np.uint64(bits - 1)] = True
    out = seen[values & np.uint64(bits - 1)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(of, values[maybe])
    at[at == len(of)] = 0
    out[maybe] = of[at] == values[maybe]
    return out
