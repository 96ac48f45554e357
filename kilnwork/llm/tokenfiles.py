"""Token files: canonical length-limited Huffman coding in independent blocks.

Writing: texts are tokenized, ids are counted over all documents, lengths come
from the package-merge method (optimal under the limit), codes are canonical, so
the table of lengths is the whole code.  Documents are range-partitioned and
sorted by doc_id; each partition becomes a shard of blocks.

A block holds whole documents and can be decoded alone.  Its bytes, all
little-endian:

    magic "KHB1" | documents u32 | tokens u64 | tokens of the shard before it u64
    | interval u32 | checkpoints u32 | doc_id i64 each | doc_id present u8 each
    | tokens u32 of each document | bit offset u64 of each checkpoint | payload

Payload bits go from the highest to the lowest of each byte.  A checkpoint is
the bit offset of every INTERVAL-th token, so that a block decodes in many lanes
at once with one table lookup a token.

A file set is a folder: ``blocks`` (Parquet rows shard, block, first_doc,
last_doc, n_tokens, data) and ``code`` (the lengths).  Parquet only carries the
block bytes, so that any store that Spark reaches can hold them.

Edge cases: null and empty texts are the end id alone; documents without a
doc_id sort first; repeated ids are kept, in the order of their tokens' hash
(equal rows in any order); an empty table gives an empty file set; a document of
any length is one block's.  Only doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.llm.shared import drop, small_batches, stored
from kilnwork.llm.textblocks import blocks, released, text_buffer
from kilnwork.llm.tokens import encoder

MAX_BITS = 18
INTERVAL = 256
BLOCK_TOKENS = 1 << 15
LANE_TOKENS = 1 << 20
MAGIC = b"KHB1"
_HEAD = struct.Struct("<4sIQQII")
BLOCKS = "shard int, block long, first_doc long, last_doc long, n_tokens long, data binary"
_TOKENIZED = ["doc_id", "wide", "ids", "counts"]
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (more only where the symbols need it); 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    bits = max(max_bits, (n - 1).bit_length())
    order = np.argsort(counts[used], kind="stable")
    weight = counts[used][order].astype(np.float64)
    levels = []  # of each level: which of the merged items are symbols
    merged, is_symbol = weight, np.ones(n, bool)
    for _ in range(bits - 1):
        levels.append(is_symbol)
        even = merged[: len(merged) // 2 * 2]
        packages = even[0::2] + even[1::2]
        every = np.concatenate([weight, packages])
        place = np.argsort(every, kind="stable")
        merged, is_symbol = every[place], place < n
    levels.append(is_symbol)
    lengths = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[used[order]] = lengths
    return out


class Code:
    """Canonical code: codes rise with length, then with the id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.bits = max(1, int(lengths.max(initial=0)))
        span = np.left_shift(np.uint64(1), (self.bits - lengths[order].astype(np.int64)).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(span)])[: len(order)].astype(np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (self.bits - lengths[order].astype(np.int64)).astype(np.uint64)
        self._order, self._span = order, span
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``bits`` bits."""
        if self._table is None:
            ids = np.zeros(1 << self.bits, np.uint32)
            sizes = np.ones(1 << self.bits, np.uint8)
            filled = np.repeat(self._order, self._span.astype(np.int64))
            ids[: len(filled)] = filled
            sizes[: len(filled)] = self.lengths[filled]
            self._table = ids, sizes
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Payload bytes, and the bit offset of every INTERVAL-th token."""
        if not len(ids):
            return np.empty(0, np.uint8), np.empty(0, np.int64)
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        codes, word, free = self.codes[ids], begins >> 6, 64 - (begins & 63) - sizes
        # Codes are shorter than a word, so a code begins in every word; no two share a bit, so sums are unions.
        head = np.where(free >= 0, codes << np.maximum(free, 0).astype(np.uint64), codes >> np.maximum(-free, 0).astype(np.uint64))
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[: len(first)] = np.add.reduceat(head, first)
        over = np.flatnonzero(free < 0)
        out[word[over] + 1] |= codes[over] << (64 + free[over]).astype(np.uint64)
        return out.astype(">u8").view(np.uint8)[: -(-int(ends[-1]) // 8)], begins[::INTERVAL]

    def decode(self, payload: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Tokens of lanes that begin at the bit ``offsets`` and have ``counts`` tokens, lane after lane."""
        if not len(offsets):
            return np.empty(0, np.uint32)
        ids, sizes = self.table()
        wide = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint64)
        words = np.zeros(len(wide) - 4, np.uint64)
        for lane in range(5):
            words |= wide[lane : len(wide) - 4 + lane] << np.uint64(32 - 8 * lane)
        out = np.zeros((len(offsets), int(counts.max())), np.uint32)
        bit = offsets.astype(np.int64).copy()
        mask, last = np.uint64((1 << self.bits) - 1), len(words) - 1
        for k in range(out.shape[1]):
            look = (words[np.minimum(bit >> 3, last)] >> (40 - self.bits - (bit & 7)).astype(np.uint64)) & mask
            out[:, k] = ids[look]
            bit += sizes[look]
        return out[np.arange(out.shape[1]) < counts[:, None]]


def write_block(code: Code, doc_ids: list[int | None], ids: list[np.ndarray], before: int) -> bytes:
    every = np.concatenate(ids)
    payload, points = code.encode(every)
    head = _HEAD.pack(MAGIC, len(ids), len(every), before, INTERVAL, len(points))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), points.astype("<u8").tobytes(), payload.tobytes()])


class Block:
    """The parsed parts of a block."""

    def __init__(self, data: bytes):
        magic, docs, self.tokens, self.before, interval, points = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        raw = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(raw, known, strict=True)]
        self.sizes = np.frombuffer(data, "<u4", docs, at := at + docs).astype(np.int64)
        self.points = np.frombuffer(data, "<u8", points, at := at + 4 * docs).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, offset=at + 8 * points)
        self.counts = np.full(points, interval, np.int64)
        if points:
            self.counts[-1] = self.tokens - interval * (points - 1)


def read_blocks(code: Code, blocks: list[Block]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of every document, all blocks' lanes decoded together."""
    shifts = np.cumsum([0, *(len(b.payload) for b in blocks)])
    offsets = np.concatenate([b.points + 8 * s for b, s in zip(blocks, shifts, strict=False)])
    ids = code.decode(np.concatenate([b.payload for b in blocks]), offsets, np.concatenate([b.counts for b in blocks]))
    at = 0
    for b in blocks:
        start = b.before
        for doc_id, size in zip(b.doc_ids, b.sizes.tolist(), strict=True):
            yield doc_id, start, ids[at : at + size]
            start += size
            at += size


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, wide, ids, counts): a row with the ids of each document, and a row with the counts of each task.

    ids end with the end id; they are unsigned 16-bit where all of a block's fit,
    else 32-bit (``wide``).  counts, null in documents' rows, holds pairs of an id
    and its count as 64-bit numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = encoder(tokenizer), np.zeros(1, np.int64)
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                ids, at = names.column(batch.column(1).slice(a, b - a), end_id)
                found = np.bincount(ids, minlength=len(counts))
                found[: len(counts)] += counts
                counts, wide = found, bool(ids.max() > 0xFFFF)
                data = ids.astype("<u4" if wide else "<u2")
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                columns = [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, wide)), raw, pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=_TOKENIZED)
        used = np.flatnonzero(counts)
        pairs = np.stack([used, counts[used]], axis=1).astype("<i8").tobytes()
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=_TOKENIZED)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(released(work), "doc_id long, wide boolean, ids binary, counts binary")


def count_ids(ids: DataFrame) -> np.ndarray:
    """Counts over all documents; the driver gets one row for each id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                pairs = np.frombuffer(raw.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["id", "n"])

    pairs = ids.where("counts is not null").select("counts").mapInArrow(released(work), "id long, n long")
    got = pairs.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, max_bits: int = MAX_BITS) -> None:
    """Writes all documents' ids as a file set, in ascending doc_id order."""
    spark = docs.sparkSession
    with small_batches(spark):
        ids, working = stored(tokenized(docs, tokenizer, end_id), "token-ids", "zstd")
    lengths = code_lengths(count_ids(ids), max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, code = TaskContext.get().partitionId(), Code(lengths)
        number = before = size = 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number, before, size, names, held
            data, tokens = write_block(code, names, held, before), sum(map(len, held))
            out = [[shard], [number], [names[0]], [names[-1]], [tokens], [data]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            number, before, size, names, held = number + 1, before + tokens, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            raw, at = text_buffer(batch.column(2))
            for k, (doc_id, wide) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                names.append(doc_id)
                held.append(np.frombuffer(raw[at[k] : at[k + 1]].tobytes(), "<u4" if wide else "<u2"))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
        if held:
            yield block()

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ids.where("ids is not null").select("doc_id", "wide", "ids")
    # The hash of the ids only orders rows that repeat a doc_id.
    with small_batches(spark):
        rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids")).mapInArrow(released(work), BLOCKS).write.parquet(f"{path}/blocks")
    drop(spark, working)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are unsigned 32-bit, start counts all ids before.

    The driver gets one row for each shard and the table of code lengths.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = found.groupBy("shard").agg(F.min("first_doc").alias("first_doc"), F.count(F.when(F.col("first_doc").isNull(), 1)).alias("nameless"), F.sum("n_tokens").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(shards, key=lambda r: (not r["nameless"], r["first_doc"] if r["first_doc"] is not None else 0)):
        starts[row["shard"]] = total
        total += row["n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            waiting: list[tuple[int, Block]] = []
            size = 0
            for k, (shard, data) in enumerate(zip(*batch.columns, strict=True)):
                block = Block(data.as_py())
                waiting.append((shard.as_py(), block))
                size += block.tokens
                if size >= LANE_TOKENS or k == batch.num_rows - 1:
                    shift = [starts[s] for s, b in waiting for _ in b.doc_ids]
                    rows = list(read_blocks(code, [b for _, b in waiting]))
                    begin = [s + x for (_, s, _), x in zip(rows, shift, strict=True)]
                    numbers = [pa.array(x, pa.int64()) for x in ([d for d, _, _ in rows], begin, [len(i) for _, _, i in rows])]
                    raw = pa.array([i.astype("<u4").tobytes() for _, _, i in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([*numbers, raw], names=["doc_id", "start", "n_tokens", "ids"])
                    waiting, size = [], 0

    return found.select("shard", "data").mapInArrow(released(work), DOCUMENTS)
