"""Hierarchical packing into windows of several lengths.

Every document goes to a tier by what remains of it after its full windows of
the longest tier: 1..256 tokens to the shortest, then up to 512, 1024, 2048.
Tiers are packed from the longest: the tier's own piece opens a window, and its
gap is filled with the largest pieces of shorter tiers that fit; where none
fits, the smallest is cut.  All window lengths are powers of two and all are
full; what is left over at a partition's end is cut into full windows of falling
powers of two (their ``tier`` is that length, which may be below the shortest of
TIERS), so nothing is padded.

Packing is local to a partition and needs no shuffle.  Documents are taken in
groups of bounded size; pieces that don't fill a window wait for the next group.
Sequences of a group are dealt to step groups of nearly equal token counts,
longest first to the least loaded.

Ids of sequences and step groups hold the partition's number, so they are unique
in a result, and a task that runs again gives the same ones.

Edge cases: a null or empty text is the end id alone; equal ids and repeated
rows are packed as rows of their own; pieces of equal length go in the order of
their rows; a text may be longer than any window; an empty table gives no pieces.
A null doc_id is carried.  Only doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kilnwork.llm.textblocks import blocks, released
from kilnwork.llm.tokens import encoder

TIERS = (2048, 1024, 512, 256)
GROUP_ROWS, GROUP_TOKENS = 8192, 4_000_000
STEP_TOKENS = 64 * 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int, int]  # length, document, start, order


class Packer:
    """Packs (document, token count) pairs; yields full windows as lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self._tiers = tiers
        self._pool: list[tuple[int, int, int]] = []  # sorted (length, document, start)

    def add(self, document: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        """Routes a document; its full windows of the longest tier come at once."""
        longest = self._tiers[0]
        for start in range(0, tokens - tokens % longest, longest):
            yield [(longest, document, start)]
        if tokens % longest:
            insort(self._pool, (tokens % longest, document, tokens - tokens % longest))

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """All windows that can be filled; the rest stays for later."""
        pool = self._pool
        for tier, below in zip(self._tiers, (*self._tiers[1:], 0), strict=True):
            while pool and pool[-1][0] > below:
                window, gap = [pool.pop()], 0
                gap = tier - window[0][0]
                while gap and pool:
                    at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                    if at >= 0:
                        window.append(pool.pop(at))
                    else:
                        length, document, start = pool.pop(0)
                        window.append((gap, document, start))
                        insort(pool, (length - gap, document, start + gap))
                    gap -= window[-1][0]
                if gap:
                    for piece in window:
                        insort(pool, piece)
                    return
                yield window

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, cut into full windows of falling powers of two."""
        pool, self._pool = self._pool[::-1], []
        left = sum(x[0] for x in pool)
        while left:
            size = min(1 << (left.bit_length() - 1), self._tiers[0])
            window, gap = [], size
            while gap:
                length, document, start = pool.pop(0)
                take = min(gap, length)
                window.append((take, document, start))
                if take < length:
                    pool.insert(0, (length - take, document, start + take))
                gap -= take
            left -= size
            yield window

    def waiting(self) -> set[int]:
        return {x[1] for x in self._pool}


def step_groups(sizes: list[int], budget: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence, so that groups hold about the same number of tokens."""
    groups = max(1, -(-sum(sizes) // budget))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + sizes[k], g))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The pieces of all documents, with their ids (unsigned little-endian 32-bit)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names, packer = encoder(tokenizer), Packer(tiers)
        held: dict[int, tuple[int | None, bytes]] = {}
        number = sequence = steps = tokens = 0

        def out(windows: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, steps
            groups = step_groups([sum(x[0] for x in w) for w in windows])
            rows: list[tuple] = []
            for window, group in zip(windows, groups, strict=True):
                offset, size = 0, sum(x[0] for x in window)
                for length, document, start in window:
                    doc_id, ids = held[document]
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, (part << 40) + sequence, offset, size, (part << 40) + steps + group))
                    offset += length
                sequence += 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            steps += max(groups, default=-1) + 1
            if rows:
                yield batch_of(rows)

        ready: list[list[tuple[int, int, int]]] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b in blocks(batch.column(1)):
                every, at = names.column(batch.column(1).slice(a, b - a), end_id)
                every = every.astype("<u4")
                for k, doc_id in enumerate(doc_ids[a:b]):
                    ids = every[at[k] : at[k + 1]].tobytes()
                    held[number] = (doc_id, ids)
                    ready += packer.add(number, len(ids) // 4)
                    number += 1
                    tokens += len(ids) // 4
                if tokens >= GROUP_TOKENS or len(held) >= GROUP_ROWS:
                    ready += packer.windows()
                    yield from out(ready)
                    ready, tokens = [], 0
                    held = {k: held[k] for k in packer.waiting()}
        ready += packer.windows()
        ready += packer.rest()
        yield from out(ready)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(work), PIECES)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
