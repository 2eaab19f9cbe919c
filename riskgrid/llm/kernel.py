"""Vectorised text primitives shared by the operators: numpy over the UTF-8 buffers of Arrow columns.

Texts never become Python strings here. A batch is ``data`` (uint8, all texts one after another) and
``offs`` (int64, text i is ``data[offs[i]:offs[i+1]]``); a null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Bytes hashed at a time, whatever the length of a text.
HASH_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so invertible modulo 2**64

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 0x51ED270B + 1))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may keep bytes behind it
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        if lengths.sum() != offs[-1] - offs[0]:
            keep = np.repeat(lengths > 0, np.diff(offs))
            data = data[offs[0] : offs[-1]][keep]
            return data, np.concatenate([[0], np.cumsum(lengths)])
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES, texts: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, data, offs) of runs of whole texts of about ``limit`` bytes, ``texts`` at most."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = min(n, i + texts, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def tokens(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't separators: starts, ends, and for each text the index of its first token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each slice; the slices are in order and don't overlap. ``fold`` maps bytes first."""
    table = byte_table(seed) if fold is None else byte_table(seed)[fold]
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + HASH_BYTES, "right")))
        width = int(ends[j - 1] - at)
        up, down = powers(_BASE, width + 1)
        sums = np.empty(width + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[at : at + width]] * up[:width], out=sums[1:])
        s = starts[i:j] - at
        out[i:j] = (sums[ends[i:j] - at] - sums[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive word hashes, whatever text they are of."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n - size + 1, np.uint64), HASH_BYTES
    for i in range(0, len(out), step):
        part = words[i : i + step + size - 1]
        up, down = powers(_WORD_BASE, len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - size + 1
        out[i : i + m] = (sums[size:] - sums[:m]) * down[:m]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of ``size`` words that lie in one text: word index of the start, and text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return ramp(counts) + np.repeat(first[:-1], counts), text


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of Latin-1 (in UTF-8: C3 80 to C3 9E, but C3 97) in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices one after another."""
    return data[ramp(lengths) + np.repeat(starts, lengths)]


def release() -> None:
    """Give memory that is free back to the system: a worker serves task after task, and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run):
    """``run``, a function of batches as mapInArrow wants it, which releases memory when it has come to its end."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def mapper(function):
    """A function of one RecordBatch as mapInArrow wants it; ``function`` may return None. Memory is released after each batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                release()
                yield out
                del out
            del batch
            release()

    return run
