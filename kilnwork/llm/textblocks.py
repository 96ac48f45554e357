"""Vectorised word hashing of whole Arrow text columns.

A block is a slice of a string column handled as one byte array: word
boundaries, word hashes and shingle hashes of all its documents come from a few
numpy passes, with no Python object per word.  Documents are never cut; a block
holds at least one document however long that is.

A word's hash is a polynomial in wrapping 64-bit arithmetic: every byte is
mapped to a random 64-bit constant, weighted by a power of an odd base, summed
and then mixed.  Equal words always get equal hashes.  Null texts count as
empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
SPACES = (9, 10, 11, 12, 13, 32)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Kinds of bytes: white space ends a word; with TOKEN_KINDS so does a change between letters and signs.
WORD_KINDS = np.where(_IS_SPACE, 0, 1).astype(np.uint8)
TOKEN_KINDS = np.array([0 if _IS_SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` whose texts hold about ``limit`` bytes each."""
    offsets = text_buffer(column)[1]
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end
        row = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's start in them, without a copy."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets


class Words:
    """The words of the documents of one block, in compressed sparse rows.

    ``hashes[ptr[i]:ptr[i + 1]]`` are those of document i; ``start`` and ``end``
    are byte positions in ``data``.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, *, lower: bool, kinds: np.ndarray = WORD_KINDS):
        base = int(offsets[0])
        data = raw[base : int(offsets[-1])]
        rows = offsets - base
        kind = kinds[data]
        solid = kind > 0
        first = solid.copy()
        last = solid.copy()
        change = kind[1:] != kind[:-1]
        first[1:] &= change
        last[:-1] &= change
        inner = rows[(rows > 0) & (rows < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.data, self.rows = data, rows
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, rows)
        power = _power_table(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
        shift = power[len(data) - self.start] if len(self.start) else np.empty(0, np.uint64)
        self.hashes = mix64((total[self.end] - total[self.start]) * shift * power_fix(len(data)) + (self.end - self.start).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        return self.data[self.start[i] : self.end[j - 1]].tobytes()


_fix: dict[int, np.uint64] = {}


def power_fix(n: int) -> np.uint64:
    """Undoes the block's length in the weights, so that equal words agree across blocks."""
    if n not in _fix:
        if len(_fix) > 100_000:
            _fix.clear()
        _fix[n] = np.uint64(pow(pow(int(_BASE), -1, 1 << 64), n, 1 << 64))
    return _fix[n]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, ignoring document ends."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _GRAM[k]
    return mix64(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats numpy's hash table on short arrays and long ones."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a shingle; differs from any full shingle's."""
    return mix64((hashes * _GRAM[32 : 32 + len(hashes)]).sum(dtype=np.uint64)[None] + _GRAM[63])[0]


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct n-word shingle hashes.

    With fewer than n words, the whole sequence is the one shingle; no word, no shingle.
    """
    every = grams(words.hashes, n)
    for i in range(len(words.ptr) - 1):
        a, b = int(words.ptr[i]), int(words.ptr[i + 1])
        if b - a >= n:
            yield distinct(every[a : b - n + 1])
        elif b > a:
            yield np.array([whole(words.hashes[a:b])], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end, as workers wait for the next task with what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def each_block(batch: pa.RecordBatch, text: str, *, lower: bool, limit: int = BLOCK_BYTES, kinds: np.ndarray = WORD_KINDS) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) of each block of a batch."""
    column = batch.column(batch.schema.get_field_index(text))
    raw, offsets = text_buffer(column)
    for a, b in blocks(column, limit):
        yield a, b, Words(raw, offsets[a : b + 1], lower=lower, kinds=kinds)
