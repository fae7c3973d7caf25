"""Vectorised word and shingle arithmetic on Arrow string columns, used inside Spark tasks.

A slice of texts is one byte buffer; words are found with masks, and the hash of any byte
range comes from one prefix sum, so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_INV = pow(_ODD, -1, 1 << 64)
SLICE_BYTES = 1 << 20

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which a Python worker that lives on returns the memory it no longer uses."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _trim() is not None:
            _trim()(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy and wraps silently."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_byte_value = mix(np.arange(1, 257, dtype=U64) * _MULT)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, U64(base), U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    off, _ = as_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words (runs without white space) of a slice of texts.

    ``doc`` is the text each word belongs to, ``start`` and ``end`` its byte range in
    ``data`` (A-Z lower-cased unless ``keep_case``), ``first`` the index of a text's first word.
    ``solid`` marks the bytes that words are made of, where white space shall not be the only border.
    """

    def __init__(self, texts: pa.Array, keep_case: bool = False, solid: np.ndarray = ~_space):
        self.off, raw = as_bytes(texts)
        self.raw = raw
        self.data = raw if keep_case else _lower[raw]
        self.n_docs = len(self.off) - 1
        solid = solid[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.off] = True
        begins, ends = solid.copy(), solid.copy()
        if len(raw):
            begins[1:] &= ~solid[:-1] | edge[1:-1]
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self._sum: np.ndarray | None = None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges of ``data``."""
        if self._sum is None:
            terms = _byte_value[self.data] * _power_table(_ODD, len(self.data))
            self._sum = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        back = _power_table(_INV, len(self.data) + 1)
        return mix((self._sum[end] - self._sum[start]) * back[start] + (end - start).astype(U64) * _MULT)

    def code_points(self, at: np.ndarray) -> np.ndarray:
        """Code-point offsets, within their text, of byte positions of the words' texts."""
        begins = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))
        owner = np.searchsorted(self.off, at, "right") - 1
        return begins[at] - begins[self.off[owner]]

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)


class ShingleSets:
    """Sorted distinct shingles of each text, as flat arrays.

    With fewer words than ``width`` the whole sequence is the one shingle; a text without
    words has none. ``value[first[i]:first[i + 1]]`` is the set of text i.
    """

    def __init__(self, words: Words, width: int = 5):
        h, doc = words.hashes(), words.doc
        salt = [mix(np.array([k], U64) * _MULT)[0] for k in range(width + 1)]
        owners, values = [], []
        if len(h) >= width:
            full = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :])
            acc = np.zeros(len(full), U64)
            for k in range(width):
                acc = acc * _MULT + h[full + k]
            owners.append(doc[full])
            values.append(mix(acc + salt[width]))
        for n in range(1, width):
            short = np.flatnonzero(words.count == n)
            acc = np.zeros(len(short), U64)
            for k in range(n):
                acc = acc * _MULT + h[words.first[short] + k]
            owners.append(short)
            values.append(mix(acc + salt[n]))
        own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        val = np.concatenate(values) if values else np.zeros(0, U64)
        order = np.lexsort((val, own))
        own, val = own[order], val[order]
        if len(own):
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (val[1:] != val[:-1])
            own, val = own[new], val[new]
        self.own, self.value = own, val
        self.count = np.bincount(own, minlength=words.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def keys(self) -> np.ndarray:
        """One 64-bit number per text that is equal for equal sets."""
        run = np.concatenate((np.zeros(1, U64), np.cumsum(mix(self.value ^ _MULT), dtype=U64)))
        total = run[self.first[1:]] - run[self.first[:-1]]
        return mix(total + self.count.astype(U64) * _MULT).view(np.int64)

    def profiles(self) -> np.ndarray:
        """How many shingles fall into each of 64 hash classes, at most 255 counted."""
        cell = self.own * 64 + (self.value & U64(63)).astype(np.int64)
        return np.minimum(np.bincount(cell, minlength=len(self.count) * 64), 255).astype(np.uint8).reshape(-1, 64)


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(columns: Sequence[tuple[np.ndarray, int]]) -> bytes:
    """Columns of unsigned numbers, compressed byte plane by byte plane; of each, so many of its low bytes."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T) for c, w in columns]
    return _codec().compress(b"".join(p.tobytes() for p in planes), asbytes=True)


def unpack(raw: bytes | pa.Buffer, size: int, widths: Sequence[int]) -> list[np.ndarray]:
    """The columns that ``pack`` was given, ``size`` numbers each."""
    data = np.frombuffer(_codec().decompress(raw, size * sum(widths)), np.uint8)
    out, at = [], 0
    for w in widths:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :w] = data[at : at + size * w].reshape(w, size).T
        out.append(wide.view("<u8").ravel())
        at += size * w
    return out


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
