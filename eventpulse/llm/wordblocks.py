"""Vectorised views of the words of Arrow text columns.

Texts are handled in blocks of a few MB, whatever the batch size, so that a task's memory stays bounded by
the block and the longest single text. Words are runs of bytes other than space and 0x09-0x0D; in UTF-8
that is the same as runs of such characters. Hashes are 64-bit, deterministic and equal on all executors.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
PIECE_SPANS = 1 << 16
LONG_SPAN = 1 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The low 0 to 8 bytes of a 64-bit value.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), x)]) for x in (_BASE, _INVERSE))
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] of each span: every eight bytes are folded in by a bijective mix, so spans of
    one length up to eight bytes never collide, and no algebra of texts makes longer ones collide."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    for at in range(0, len(starts), PIECE_SPANS):
        s, n = starts[at : at + PIECE_SPANS], (ends - starts)[at : at + PIECE_SPANS]
        h = mix(n.astype(np.uint64))
        short = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
        done = 0
        while len(short):
            left = n[short] - done
            h[short] = mix(h[short] ^ (eight[s[short] + done] & _LOW_BYTES[np.minimum(left, 8)])) + np.uint64(done)
            short, done = short[left > 8], done + 8
        for i in np.flatnonzero(n > LONG_SPAN).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : s[i] + n[i]], digest_size=8).digest(), "little")
        out[at : at + PIECE_SPANS] = h
    return out


@functools.cache
def _factors(n: int) -> list[np.uint64]:
    return list(mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1))


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each n consecutive values; len(h) - n + 1 of them. Every place has a factor of its own."""
    count = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        x = np.full(count, n, dtype=np.uint64)
        for i, factor in enumerate(_factors(n)):
            x += h[i : i + count] * factor
    return mix(x)


class WordBlock:
    """Some consecutive texts: bytes, text bounds, word bounds, and how the words fall to texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, separators: np.ndarray = SEPARATORS):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1
        inside = ~separators[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        full = bounds[:-1] < bounds[1:]
        heads, tails = bounds[:-1][full], bounds[1:][full] - 1
        begins[heads] = inside[heads]
        stops[tails] = inside[tails]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.word_bounds)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, text bounds in them, number of the first text) of blocks of about limit bytes; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at
        at = to


def word_blocks(texts: pa.Array, lower: bool = False, separators: np.ndarray = SEPARATORS, limit: int = BLOCK_BYTES) -> Iterator[WordBlock]:
    """The blocks of texts with their words."""
    for part, bounds, at in text_blocks(texts, limit):
        yield WordBlock(LOWER[part] if lower else part, bounds, at, separators)


def released(run: Callable) -> Callable:
    """The Arrow function run; after its last batch the worker gives freed memory back to the system."""

    @functools.wraps(run)
    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return with_release


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
