"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is WINDOW consecutive words (ASCII white space separates, nothing else
is changed).  A word goes if a window over it has a word sequence that also
starts earlier: in a document with a smaller doc_id, or earlier in its own.

1. Anchors.  Every window selects the smallest hash among its ANCHOR-word runs,
   so equal windows select equal anchors.  Anchors that occur twice or more set
   bits in a filter of 8 bits for each (at most 2**FILTER_BITS bits in all; a full
   filter costs speed, never results).
2. Confirmation.  Documents are dealt to shards by a hash of doc_id and text.  A
   shard sends each distinct window with a recurring anchor once, by a 96-bit
   hash, with its first place there; the window's bucket finds those that recur,
   the shard that holds the first place of all, and the shards that hold others.
   A window comes from each shard at most once, however many copies there are.
3. Passages.  The shard of a first place cuts the passages out of its texts:
   maximal runs of windows that begin there and recur in the same shards.  Each
   passage goes to all shards that hold it.
4. Automata.  Each shard compiles an Aho-Corasick automaton of the passages sent
   to it, cut into blocks of WINDOW / 2 words: any window of a passage holds a
   whole block.  All documents of the shard stream through it; each hit is extended
   word by word against its passage, and where WINDOW words agree they are removed,
   unless that place is the passage's own.  So every document meets an automaton of
   all recurring passages that it can hold, wherever they first occur, at a cost in
   proportion to the texts; and nothing is removed whose words, as text, don't equal
   an earlier place's.  A collision of hashes could only hide a repetition.

Bulk arrays cross shuffles as binary columns.

Edge cases: null and empty texts have no words; a document shorter than a window
loses nothing; periodic texts lose all but the first places of their windows.
A null doc_id sorts first; rows with the same doc_id follow one another in the
order of their shards and texts' hashes, and equal rows in any order.  Texts of any length are
read whole.  An empty table gives an empty result.  Only doc_id and text are read,
whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kilnwork.llm.shared import drop, stored
from kilnwork.llm.textblocks import Words, distinct, each_block, grams, mix64, released

WINDOW, ANCHOR = 20, 8
FILTER_BITS = 30
SHARD_BYTES = 12_000_000
_FLUSH, _COMPARED = 4_000_000, 500_000
_SECOND = np.uint64(0xA0761D6478BD642F)
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """Smallest or largest of each n neighbours, by doubling."""
    out, width = values, 1
    while 2 * width <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


class Windows:
    """The windows of a block: their starts, and each one's anchor value."""

    def __init__(self, words: Words, window: int, anchor: int):
        n = len(words.hashes)
        self.runs = grams(words.hashes, anchor)
        span = window - anchor + 1
        starts = np.arange(max(0, n - window + 1))
        row = np.searchsorted(words.ptr, starts, side="right") - 1
        self.valid = starts + window <= words.ptr[row + 1] if len(starts) else np.zeros(0, bool)
        self.anchors = _sliding(self.runs, span, np.minimum) if len(starts) else np.empty(0, np.uint64)
        self._span = span

    def anchor_places(self) -> np.ndarray:
        """Places of runs that some window selects."""
        if not self.valid.any():
            return np.empty(0, np.int64)
        chosen = np.where(self.valid, self.anchors, np.uint64(0))
        pad = np.zeros(self._span - 1, np.uint64)
        most = _sliding(np.concatenate([pad, chosen, pad]), self._span, np.maximum)
        return np.flatnonzero((self.runs == most[: len(self.runs)]) & (most[: len(self.runs)] > 0))


def _bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _split(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins, and the end."""
    return np.searchsorted(_bucket_of(sorted_hashes, bits), np.arange((1 << bits) + 1))


def _anchors(bits: int, window: int, anchor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = text = 0

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            edge = _split(values, bits)
            used = np.flatnonzero(np.diff(edge))
            parts = [(k, slice(edge[k], edge[k + 1])) for k in used.tolist()]
            rows = [(k, values[at].tobytes(), np.packbits(counts[at] > 1).tobytes(), 0) for k, at in parts]
            rows.append((-1, b"", b"", text))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "hashes", "twice", "bytes"])

        for batch in batches:
            for _, _, words in each_block(batch, "text", lower=False):
                text += len(words.data)
                windows = Windows(words, window, anchor)
                held.append(windows.runs[windows.anchor_places()])
                size += len(held[-1])
                if size > _FLUSH:
                    yield out()
                    held, size, text = [], 0, 0
        yield out()

    return work


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each run of equal first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's recurring anchors."""
    for bucket, rows in _grouped(batches):
        values = [np.frombuffer(h, np.uint64) for h, _ in rows]
        twice = [v[np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)).astype(bool)] for v, (_, t) in zip(values, rows, strict=True)]
        every = np.sort(np.concatenate(values))
        again = distinct(np.concatenate([every[1:][every[1:] == every[:-1]], *twice]))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["bucket", "hashes"])


def _bits(bucket_bits: int, filter_bits: int):
    """Each bucket's part of the filter, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.zeros(1 << (filter_bits - bucket_bits), bool)
                part[(np.frombuffer(raw, np.uint64) >> np.uint64(64 - filter_bits)).astype(np.int64) - (bucket << (filter_bits - bucket_bits))] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["bucket", "bits"])

    return work


def _parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucket_bits(df: DataFrame) -> int:
    return min(20, max(4, (2 * _parts(df) - 1).bit_length()))


def recurring_filter(docs: DataFrame, window: int, anchor: int, most_bits: int) -> tuple[np.ndarray, int]:
    """The packed filter of recurring anchors, and the bytes of all texts.  The driver gets at most 2**most_bits bits."""
    spark, bucket_bits = docs.sparkSession, min(_bucket_bits(docs), most_bits - 3)
    sent, sent_path = stored(docs.select("text").mapInArrow(released(_anchors(bucket_bits, window, anchor)), "bucket int, hashes binary, twice binary, bytes long"), "anchors")
    total = sent.where("bucket < 0").agg(F.sum("bytes").alias("n")).first()["n"] or 0
    rows = sent.where("bucket >= 0").select("bucket", "hashes", "twice").repartition(_parts(docs), "bucket").sortWithinPartitions("bucket")
    again, again_path = stored(rows.mapInArrow(released(_recurring), "bucket int, hashes binary"), "recurring")
    anchors = again.agg(F.sum(F.octet_length("hashes")).alias("n")).first()["n"] or 0  # 8 bytes each, so 8 bits each
    filter_bits = min(most_bits, max(bucket_bits + 3, int(anchors).bit_length()))
    packed = np.zeros(1 << (filter_bits - 3), np.uint8)
    width = len(packed) >> bucket_bits
    for row in again.mapInArrow(_bits(bucket_bits, filter_bits), "bucket int, bits binary").toLocalIterator():
        packed[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(bytes(row["bits"]), np.uint8)
    drop(spark, sent_path, again_path)
    return packed, total


def _in_filter(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    filter_bits = (8 * len(packed)).bit_length() - 1
    place = (values >> np.uint64(64 - filter_bits)).astype(np.int64)
    return (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def _ordered(table: pa.Table) -> pa.RecordBatch:
    """A shard's rows in document order, with a null doc_id as the smallest number."""
    table = table.select(["doc_id", "text", "tie"]).combine_chunks()
    key = np.asarray(table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(), np.int64)
    known = np.asarray(table["doc_id"].is_valid().to_numpy(zero_copy_only=False), bool)
    tie = np.asarray(table["tie"].to_numpy(), np.int64)
    order = np.lexsort((tie, key, known))
    ordered = table.take(pa.array(order)).combine_chunks()
    column = lambda name: ordered[name].chunk(0) if ordered[name].num_chunks else pa.array([], ordered[name].type)
    return pa.RecordBatch.from_arrays([column("doc_id"), column("text"), pa.array(key[order]), column("tie")], names=["doc_id", "text", "key", "tie"])


def _packed(values: np.ndarray, *, rising: bool = False) -> bytes:
    """Numbers as planes of their bytes, which compress well; those that rise as differences."""
    values = np.diff(values, prepend=values[:1] * 0) if rising else values
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpacked(raw: bytes, kind: type, *, rising: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


_CANDIDATES = "bucket int, shard int, h1 binary, h2 binary, row binary, start binary, twice binary, rows binary, keys binary"


def _candidates(packed_of, bucket_bits: int, window: int, anchor: int, hash_bits: int):
    """A shard's distinct windows that may recur, by bucket, each with its first place, and the documents of those."""
    mask = np.uint64(((1 << hash_bits) - 1) << (64 - hash_bits))

    def work(table: pa.Table) -> pa.Table:
        shard, batch = table["shard"][0].as_py(), _ordered(table)
        keys = np.asarray(batch.column(2).to_numpy(), np.int64)
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32))]
        for a, _, words in each_block(batch, "text", lower=False):
            windows = Windows(words, window, anchor)
            starts = np.flatnonzero(windows.valid)
            starts = starts[_in_filter(packed_of(), windows.anchors[starts])]
            row = np.searchsorted(words.ptr, starts, side="right") - 1
            first = grams(words.hashes, window)[starts] & mask
            second = (grams(mix64(words.hashes ^ _SECOND), window)[starts] & mask) >> np.uint64(32)
            found.append((first, second.astype(np.uint32), (row + a).astype(np.int32), (starts - words.ptr[row]).astype(np.int32)))
        h1, h2, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h2, h1))  # stable: of equal windows, the first place comes first
        h1, h2, row, start = h1[order], h2[order], row[order], start[order]
        head = np.ones(len(h1), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begin = np.flatnonzero(head)
        twice = np.diff(np.append(begin, len(h1))) > 1
        h1, h2, row, start = h1[begin], h2[begin], row[begin], start[begin]
        edge = _split(h1, bucket_bits)
        out = []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            part = edge[k] + np.lexsort((start[edge[k] : edge[k + 1]], row[edge[k] : edge[k + 1]]))
            docs = distinct(row[part])
            places = (_packed(row[part], rising=True), _packed(start[part]), np.packbits(twice[part]).tobytes())
            out.append((k, shard, h1[part].tobytes(), h2[part].tobytes(), *places, _packed(docs, rising=True), _packed(keys[docs], rising=True)))
        names = [x.split()[0] for x in _CANDIDATES.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return work


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard, the recurring windows with their first place there, and each shard that holds them again."""
    for _, rows in _grouped(batches):
        h1 = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        h2 = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        place = [_unpacked(r[3], np.int32, rising=True) for r in rows]
        row, start = np.concatenate(place), np.concatenate([_unpacked(r[4], np.int32) for r in rows])
        sizes = [len(r[1]) // 8 for r in rows]
        source = np.repeat(np.arange(len(rows)), sizes)
        twice = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(bool)
        at = [np.searchsorted(_unpacked(r[6], np.int32, rising=True), p) for r, p in zip(rows, place, strict=True)]
        key = np.concatenate([_unpacked(r[7], np.int64, rising=True)[i] for r, i in zip(rows, at, strict=True)])
        shards = np.array([r[0] for r in rows], np.int32)
        order = np.lexsort((shards[source], key, h2, h1))
        head = np.ones(len(order), bool)
        head[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        owner = order[np.flatnonzero(head)][np.cumsum(head) - 1]  # of each window in order: the entry with the first place
        again = (owner != order) | twice[order]
        owner, target = owner[again], shards[source[order[again]]]
        by = np.argsort(source[owner], kind="stable")
        owner, target = owner[by], target[by]
        edge = np.searchsorted(source[owner], np.arange(len(rows) + 1))
        used = np.flatnonzero(np.diff(edge)).tolist()
        parts = [slice(edge[k], edge[k + 1]) for k in used]
        columns = [[x[at].tobytes() for at in parts] for x in (row[owner], start[owner], target)]
        yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in used], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "row", "start", "target"])


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").split()


_PASSAGES = "owner int, row int, start int, text binary, targets array<int>"


def _passages(window: int):
    """The passages of a shard that recur, and the shards that hold them."""

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(found) and len(docs):
            owner, texts = docs["shard"][0].as_py(), _ordered(docs).column(1)
            row, start, target = (np.frombuffer(b"".join(found[c].to_pylist()), np.int32) for c in ("row", "start", "target"))
            order = np.lexsort((start, target, row))
            row, start, target = row[order], start[order], target[order]
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(target) != 0) | (np.diff(start) != 1)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
            runs: dict[tuple[int, int, int], list[int]] = {}
            for r, a, b, t in zip(row[first].tolist(), start[first].tolist(), start[last].tolist(), target[first].tolist(), strict=True):
                runs.setdefault((r, a, b + window), []).append(t)
            words, of_row = [], -1
            for (r, a, b), targets in runs.items():  # rows rise
                if r != of_row:
                    words, of_row = _words(texts[r]), r
                out.append((owner, r, a, b" ".join(words[a:b]), targets))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _PASSAGES.split(", ")])

    return work


class Automaton:
    """The passages of a shard, found in texts by their blocks and confirmed word by word."""

    def __init__(self, texts: list[bytes], own: list[bool], rows: list[int], starts: list[int], window: int):
        self.window, self.step = window, window // 2
        self._ids: dict[bytes, int] = {}
        words = [self._numbered(t.split()) for t in texts]
        self._begin = np.cumsum([0, *(len(w) for w in words)])
        self._passage = np.concatenate(words)
        self._own, self._row, self._start = np.array(own, bool), np.array(rows, np.int64), np.array(starts, np.int64)
        blocks: dict[str, list[tuple[int, int]]] = {}
        for p, text in enumerate(texts):
            parts = text.split()
            for at in range(0, len(parts) - self.step + 1, self.step):
                key = (b" %b " % b" ".join(parts[at : at + self.step])).decode("latin-1")
                blocks.setdefault(key, []).append((p, at))
        self._automaton = ahocorasick.Automaton()
        self._origin: list[np.ndarray] = []
        for key, origin in blocks.items():
            self._automaton.add_word(key, (len(self._origin), len(key)))
            self._origin.append(np.array(origin, np.int64).reshape(-1, 2))
        self._automaton.make_automaton()

    def _numbered(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers, the same for the same word only."""
        ids = self._ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def gone(self, row: int, words: list[bytes]) -> np.ndarray | None:
        """Which words of a document are removed; None for none."""
        plain = b" %b " % b" ".join(words)
        stops, patterns = [], []
        for stop, (pattern, length) in self._automaton.iter(plain.decode("latin-1")):
            stops.append(stop - length + 1)
            patterns.append(pattern)
        if not stops:
            return None
        at = np.searchsorted(np.flatnonzero(np.frombuffer(plain, np.uint8) == 32), stops)
        counts = np.array([len(self._origin[k]) for k in patterns], np.int64)
        limit = np.cumsum(counts)
        known = self._ids
        mine = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        edge = np.zeros(len(words) + 1, np.int64)
        k = 0
        while k < len(at):  # a bounded number of comparisons at a time
            upto = max(k + 1, int(np.searchsorted(limit, (limit[k - 1] if k else 0) + _COMPARED, side="right")))
            origin = np.concatenate([self._origin[p] for p in patterns[k:upto]])
            self._extend(row, mine, np.repeat(at[k:upto], counts[k:upto]), origin[:, 0], origin[:, 1], edge)
            k = upto
        return np.cumsum(edge[:-1]) > 0

    def _extend(self, row: int, mine: np.ndarray, word: np.ndarray, passage: np.ndarray, at: np.ndarray, edge: np.ndarray) -> None:
        """Extends hits (a block's place here and in its passage) by word, and marks what is long enough."""
        itself = self._own[passage] & (self._row[passage] == row) & (self._start[passage] + at == word)
        word, passage, at = word[~itself], passage[~itself], at[~itself]
        begin, size = self._begin[passage], self._begin[passage + 1] - self._begin[passage]
        reach = self.window - self.step
        left, right = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        more = np.ones(len(word), bool)
        for k in range(1, reach + 1):
            more &= (word - k >= 0) & (at - k >= 0)
            more[more] = mine[word[more] - k] == self._passage[begin[more] + at[more] - k]
            left += more
        more = np.ones(len(word), bool)
        for k in range(self.step, self.step + reach):
            more &= (word + k < len(mine)) & (at + k < size)
            more[more] = mine[word[more] + k] == self._passage[begin[more] + at[more] + k]
            right += more
        enough = left + self.step + right >= self.window
        np.add.at(edge, (word - left)[enough], 1)
        np.subtract.at(edge, (word + self.step + right)[enough], 1)


def _removed(window: int):
    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        batch = _ordered(docs)
        columns = [found[c].to_pylist() for c in ("text", "own", "row", "start")]
        automaton = Automaton(*columns, window) if len(found) else None
        n_words, n_removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = _words(batch.column(1)[i])
            gone = automaton.gone(i, words) if automaton and len(words) >= window else None
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            if gone is not None and n_removed[-1]:
                words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one blank) of every document.

    hash_bits: fewer than 64 make windows' hashes collide; results then keep too much, never too little.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed, total = recurring_filter(source, window, anchor, filter_bits)
    shared = spark.sparkContext.broadcast(packed)
    shards = max(1, -(-total // shard_bytes))
    tie = F.xxhash64("text")
    sharded = source.select("doc_id", "text", tie.alias("tie"), F.pmod(F.xxhash64("doc_id", tie), F.lit(shards)).cast("int").alias("shard"))
    bits = _bucket_bits(docs)
    sent = sharded.groupBy("shard").applyInArrow(_candidates(lambda: shared.value, bits, window, anchor, hash_bits), _CANDIDATES)
    found = sent.repartition(_parts(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(released(_confirmed), "shard int, row binary, start binary, target binary")
    passages = sharded.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_passages(window), _PASSAGES)
    target = passages.select("owner", "row", "start", "text", F.explode("targets").alias("shard"))
    routed = target.select("shard", (F.col("shard") == F.col("owner")).alias("own"), "row", "start", "text")
    return sharded.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_removed(window), RESULT)
