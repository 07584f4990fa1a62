"""Vectorised word splitting and hashing over Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so multi-byte UTF-8
never splits. Hashes are 64-bit: per-byte random values in a polynomial modulo
2^64, finished with a mixer. They depend only on the bytes, so every task on
every executor gives the same value.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on at once; one longer document is taken alone.
CHUNK_BYTES = 2_000_000
_TILE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (the 64-bit one of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, _TILE + 1)
        with np.errstate(over="ignore"):
            for k, b in (("p", _BASE), ("q", _INV)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


class Words(NamedTuple):
    """Words of a run of documents: document index, byte range and hash of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, with one more entry: index of its first word
    data: np.ndarray  # bytes of the run

    def pos(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.first[self.doc]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return o - o[0], b


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + _TILE, "right")))
            hi = end[j - 1]
            p, q = powers(int(hi - lo) + 1)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[data[lo:hi]] * p[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def split(offsets: np.ndarray, data: np.ndarray, lower: bool = False, stops: np.ndarray = _SPACE, hashed: bool = True) -> Words:
    """Words of the documents whose bytes data[offsets[i]:offsets[i+1]] holds; `stops` marks the bytes between words.
    Hashes are zero if not asked for."""
    data = _LOWER[data] if lower else data
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    full = np.zeros(n + 2, bool)
    full[1:-1] = ~stops[data]
    start = np.flatnonzero(full[1:-1] & (~full[:-2] | cut[:-1]))
    end = np.flatnonzero(full[1:-1] & (~full[2:] | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(doc, start, end, word_hashes(data, start, end) if hashed else np.zeros(len(start), np.uint64), first, data)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive entries; the caller masks runs that cross documents."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        p, q = powers(len(hashes) + 1)
        sums = np.empty(len(hashes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * p[: len(hashes)], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * q[:n] + U(width))


def runs(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most `limit` bytes of text (or one row): rows, offsets, bytes."""
    offsets, data = text_buffers(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
