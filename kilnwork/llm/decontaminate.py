"""Benchmark decontamination by containment search.

An item is found in a document if at least THRESHOLD of the item's distinct
word shingles occur in the document, wherever and in whatever order.  Words are
runs of letters and digits in lower case; signs and white space only separate.

Items are partitioned by size (powers of two of their number of shingles).  Each
partition has its own sketch size, index and bounds, all from the sizes of its
items: up to SKETCH shingles an item is its own sketch, larger items keep the
SKETCH smallest hashes (a bottom-k MinHash sample); the containment threshold
becomes a least number of sketch hits, at which a pair at the threshold misses
with a probability under MISS (none for whole sketches), and a least number of
shingles of a document, below which it can't hold an item of the partition and
doesn't probe it.  A document streams all its shingle hashes past the
partitions, however long it is, so short items are found in long documents.
Candidates are verified by the exact containment of all the item's shingles.

Items travel to executors in blocks of at most BLOCK_BYTES of text, a bound that
is checked (only a single item may exceed it); a larger benchmark takes further
passes over the documents, block by block.

Edge cases: an item or document with fewer words than a shingle is one shingle,
its whole sequence; one without words has none and matches nothing.  Null ids
are carried, null texts count as empty.  Repeated items or documents are
reported each on their own; there are no ties to break.  An empty benchmark or
table gives no rows, and removes none.  Only doc_id, item_id and the texts are
read; ``clean`` carries all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kilnwork.llm.textblocks import TOKEN_KINDS, Words, distinct, each_block, grams, released, shingle_sets, whole

SHINGLE, THRESHOLD = 5, 0.8
SKETCH = 128
BLOCK_BYTES = 16_000_000
MISS = 1e-9
KINDS = np.where(TOKEN_KINDS == 1, 1, 0).astype(np.uint8)
HITS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
_FILTER_BITS = 20


def least_hits(k: int, threshold: float, full: bool) -> int:
    """Sketch hits that a candidate must have."""
    if full:
        return max(1, math.ceil(threshold * k - 1e-9))
    chance, miss = (1 - threshold) ** k, 0.0
    for m in range(k):  # chance: that exactly m of k are hit
        miss += chance
        if miss > MISS:
            return max(1, m)
        chance *= (k - m) / (m + 1) * threshold / (1 - threshold)
    return k


@dataclass(frozen=True)
class Partition:
    """Sketches of the items of one size class, as postings sorted by hash."""

    least_hits: int  # sketch hits that a candidate needs
    least_size: int  # shingles that a document needs
    hashes: np.ndarray
    starts: np.ndarray
    postings: np.ndarray

    @staticmethod
    def build(members: list[int], sets: list[np.ndarray], threshold: float) -> Partition:
        smallest = min(len(sets[i]) for i in members)
        whole_sets = max(len(sets[i]) for i in members) <= SKETCH
        sketches = [sets[i] if whole_sets else sets[i][:SKETCH] for i in members]  # sets are sorted by hash
        every = np.concatenate(sketches)
        owners = np.repeat(np.array(members, np.int64), [len(s) for s in sketches])
        order = np.argsort(every, kind="stable")
        hashes, starts = np.unique(every[order], return_index=True)
        hits = least_hits(min(smallest, SKETCH), threshold, whole_sets)
        return Partition(hits, least_hits(smallest, threshold, True), hashes, np.append(starts, len(every)), owners[order])

    def candidates(self, mine: np.ndarray) -> np.ndarray:
        """Items with enough hits among a document's hashes."""
        spot = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
        spot = spot[self.hashes[spot] == mine]
        if not len(spot):
            return np.empty(0, np.int64)
        hit = np.concatenate([self.postings[self.starts[k] : self.starts[k + 1]] for k in spot.tolist()])
        items, counts = np.unique(hit, return_counts=True)
        return items[counts >= self.least_hits]


@dataclass(frozen=True)
class Index:
    """The partitions of one block of items."""

    item_ids: list[int | None]
    copies: list[int]
    sets: list[np.ndarray]
    partitions: list[Partition]
    seen: np.ndarray  # a bit filter in front of the binary searches

    @staticmethod
    def build(item_ids: list[int | None], texts: list[str | None], shingle: int, threshold: float, copies: list[int] | None = None) -> Index:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        sets = [s for a, b, w in each_block(batch, "text", lower=True, kinds=KINDS) for s in shingle_sets(w, shingle)]
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_size.setdefault(len(s).bit_length(), []).append(i)
        partitions = [Partition.build(by_size[k], sets, threshold) for k in sorted(by_size)]
        seen = np.zeros(1 << _FILTER_BITS, bool)
        for p in partitions:
            seen[(p.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return Index(item_ids, copies or [1] * len(item_ids), sets, partitions, seen)

    def search(self, words: Words, shingle: int, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each contained item, for the documents of a block."""
        if not self.partitions:
            return
        every = grams(words.hashes, shingle)
        found = np.flatnonzero(self.seen[(every >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        rows = np.searchsorted(words.ptr, found, side="right") - 1
        inside = found + shingle <= words.ptr[rows + 1]
        found, rows = found[inside], rows[inside]
        n_words = np.diff(words.ptr)
        short = (n_words > 0) & (n_words < shingle)
        at_most = np.where(short, 1, n_words - shingle + 1)  # shingles of each document
        active = np.flatnonzero(short | (np.bincount(rows, minlength=len(n_words)) > 0))
        for row in active.tolist():
            a, b = int(words.ptr[row]), int(words.ptr[row + 1])
            hashes = whole(words.hashes[a:b])[None] if short[row] else None
            mine = hashes if short[row] else distinct(every[found[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]])
            for p in self.partitions:
                if p.least_size > at_most[row]:
                    break  # partitions rise in size
                for i in p.candidates(mine).tolist():
                    if hashes is None:
                        hashes = distinct(every[a : b - shingle + 1])
                    at = np.minimum(np.searchsorted(hashes, self.sets[i]), len(hashes) - 1)
                    shared = int((hashes[at] == self.sets[i]).sum())
                    if shared >= threshold * len(self.sets[i]) - 1e-9:
                        yield row, i, shared


def item_blocks(items: DataFrame, shingle: int, threshold: float, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of all items, one for each block; equal rows are one item with a number of copies.

    Blocks are made smaller until each holds at most block_bytes of text or one item.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, blocks = rows.agg(F.sum(size).alias("n")).first()["n"] or 0, 1
    if total > block_bytes:
        blocks = -(-2 * total // block_bytes)
    while True:
        place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block")
        loads = rows.groupBy(place).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")) if blocks > 1 else None
        if loads is None or loads.where((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    numbers = range(blocks) if blocks == 1 else [r["block"] for r in loads.select("block").orderBy("block").collect()]
    for k in numbers:
        part = rows.where(place == k) if blocks > 1 else rows
        got = sorted(part.toArrow().to_pylist(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        yield Index.build([r["item_id"] for r in got], [r["text"] for r in got], shingle, threshold, [r["copies"] for r in got])


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it contains; none for an empty benchmark."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_blocks(items, shingle, threshold):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    (a + row, i, n)
                    for a, _, words in each_block(batch, "text", lower=True, kinds=KINDS)
                    for row, i, n in index.search(words, shingle, threshold)
                    for _ in range(index.copies[i])
                ]
                sizes = [len(index.sets[i]) for _, i, _ in found]
                numbers = ([index.item_ids[i] for _, i, _ in found], sizes, [n for _, _, n in found])
                share = pa.array([n / s for (_, _, n), s in zip(found, sizes, strict=True)], pa.float64())
                at = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(x, pa.int64()) for x in numbers), share], names=[x.split()[0] for x in HITS.split(", ")])

        part = source.mapInArrow(released(work), HITS)
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    at = docs.columns.index("text")
    for index in item_blocks(items, shingle, threshold):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
                keep = np.ones(batch.num_rows, bool)
                for a, _, words in each_block(texts, "text", lower=True, kinds=KINDS):
                    for row, _, _ in index.search(words, shingle, threshold):
                        keep[a + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(released(work), docs.schema)
    return docs
