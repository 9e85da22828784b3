"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Texts are never decoded to Python strings here.  Work is done in chunks of rows
of bounded bytes, so memory stays bounded whatever the Arrow batch size is; one
text longer than the bound is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

CHUNK_BYTES = 500_000

#: Bytes beyond which a span is hashed by itself.
LONG_SPAN = 256

#: Bytes of rows that Spark hands to Python at once; ten thousand long texts would be too much at a time.
BATCH_BYTES = 8_000_000

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case ASCII letters and every byte of a character beyond ASCII.
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grown_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def bounded_batches(spark) -> None:
    """Lowers the session's limit of bytes per Arrow batch to ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(key)).rstrip("b"))
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, memory that is free goes back to the system, as workers stay for other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads differences over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xA0761D6478BD642F)


def duplicated(keys: np.ndarray, keep) -> np.ndarray:
    return pd.Series(keys.view(np.int64)).duplicated(keep=keep).to_numpy()


@dataclass
class Chunk:
    """Some consecutive texts: their bytes, one after another, and where each begins and ends."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes in ``member`` (a table of 256), cut at text borders."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = member[self.data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        begins = self.off[:-1]
        before[begins[begins < len(inside)]] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[self.off[1:][self.off[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """For each text, the index of its first position; one more entry at the end."""
        return np.searchsorted(positions, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without the break) and text numbers of all lines, in order; each text has one at least."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.off[:-1], breaks + 1])
        text = np.concatenate([np.arange(self.hi - self.lo), np.searchsorted(self.off, breaks, "right") - 1])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = self.off[1:][text]
        same = np.flatnonzero(text[1:] == text[:-1])
        end[same] = start[same + 1] - 1
        return start, end, text

    def prefix_hash(self) -> PrefixHash:
        return PrefixHash(self.data)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span that no equation of its bytes predicts: eight bytes at a time are mixed in."""
        size = ends - starts
        h = mix(size.astype(np.uint64) + _BASE)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at = 0
        while len(live):
            block = np.ascontiguousarray(eight[starts[live] + at]).view("<u8").ravel()
            left = np.minimum(size[live] - at, 8).astype(np.uint64)
            block &= np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8))
            h[live] = mix((h[live] ^ mix(block + _BASE)) + _BASE_INV)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG_SPAN).tolist():  # few, as each is long
            h[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]].tobytes())
        return h

    def lowered(self) -> Chunk:
        return Chunk(self.lo, self.hi, LOWER[self.data], self.off)


class PrefixHash:
    """Polynomial prefix hashes modulo 2**64: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _grown_powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column (null: empty) in chunks of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64))
        lo = hi


def chunk_of(texts: list[str | None], most: int = CHUNK_BYTES) -> list[Chunk]:
    return list(chunks(pa.array(texts, pa.string()), most))
