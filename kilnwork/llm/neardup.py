"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is its set of distinct n-word shingles (words without ASCII white
space, A-Z in lower case).  Two documents are linked if their sets' Jaccard
similarity reaches the threshold, a fraction of integers; groups are the
connected components of the links.

1. Signatures.  An element gives each of the signature's places a rank by a
   random permutation and a random fraction; a place keeps the smallest.  Ranks
   are generated one stage at a time for all elements at once, and a document is
   done when its largest value can no longer fall (early stopping).
2. Classes.  Documents with the same set (a 128-bit digest) are one class, named
   after its smallest doc_id; from here on only classes are compared, so copies
   cost nothing more.
3. Banding.  Classes that share a band meet in a bucket.  The number of bands
   makes a pair at the threshold miss with a probability under MISS.  Buckets
   with the same members are kept once.  Only texts of classes in a bucket are
   read again; a broadcast of at most FEW ids picks them in the scan (beyond that, a
   join does).
4. Verification on full sets, bucket by bucket, without emitting pairs.  A pair
   at the threshold shares one of either set's rarest shingles, as many as may be
   missing (prefix filtering, exact); members meet by those.  Of those that meet,
   a member of the smallest group is compared with all of other groups at once,
   until at most one group holds members that were not compared.  A bucket returns
   the links of a spanning forest.
   Buckets of more than BLOCK_ELEMENTS shingles or BLOCK_MEMBERS classes are split
   into blocks, each with the bucket's first class.  After the components of all
   those links, members of such buckets meet again by their rarest shingles, on
   tables; where several components meet, members outside the main one are
   compared with all others, in blocks.
5. Components by alternating large-star and small-star steps on tables; the
   driver gets a count and a checksum.  Hubs with more than a partition's share of
   the edges are joined by broadcast, at most one for each partition.

Sets hold 64-bit hashes of shingles.  Edge cases: a document with fewer words
than a shingle is one shingle, its whole sequence; one without words or with a
null text has an empty set, links with nothing and is its own group.  A null
doc_id takes no part and keeps a null group.  Repeated rows are copies; rows of
one doc_id with different texts are of one group.  A group's name is its smallest
doc_id, so ties don't arise.  Texts of any length are read whole.  Other columns
are not read, and keep_one carries them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnwork.llm.shared import drop, stored
from kilnwork.llm.textblocks import each_block, mix64, released, shingle_sets

ROWS_PER_BAND = 6
MISS = 1e-5
BLOCK_ELEMENTS, BLOCK_MEMBERS = 2_000_000, 20_000
_DIGEST = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_STAGE_ELEMENTS = 60_000
#: The most rows of a broadcast: of one or two numbers, and of bucket members (about 40 bytes each).
FEW, BROADCAST_ROWS = 1 << 20, 1 << 19
#: A graph with fewer edges needs no split of hubs.
HUB_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    """Shingle length and threshold numerator / denominator."""

    shingle: int = 5
    numerator: int = 4
    denominator: int = 5

    @property
    def bands(self) -> int:
        hit = (self.numerator / self.denominator) ** ROWS_PER_BAND
        return max(1, math.ceil(math.log(MISS) / math.log1p(-hit))) if hit < 1 else 1


def _draw(x: np.ndarray, stage: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """A fraction (32 bits) and a place in [stage, places) of each element."""
    r = mix64(x + np.uint64((2 * stage + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    k = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(places - stage) >> np.uint64(32)).astype(np.int64) + stage
    return r >> np.uint64(32), k


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set; those of empty sets are all ones."""
    out = np.full((len(sets), places), np.uint64(0xFFFFFFFFFFFFFFFF))
    sizes = np.array([len(s) for s in sets], np.int64)
    first = 0
    while first < len(sets):  # as many sets at once as keep the permutations small
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), _STAGE_ELEMENTS)))
        _sign(sets[first:last], out[first:last], places)
        first = last
    return out


def _sign(sets: list[np.ndarray], out: np.ndarray, places: int) -> None:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return
    x = np.concatenate(sets)
    flat = out.reshape(-1)
    fraction, place = _draw(x, 0, places)
    np.minimum.at(flat, owner * places + place, fraction)
    open_rows = (out.max(axis=1) >> np.uint64(32)) >= 1
    live = open_rows[owner]
    x, owner, place = x[live], owner[live], place[live]
    # Permutations as small tables of places; the swap of stage 0 comes first.
    order = np.tile(np.arange(places, dtype=np.uint16), (len(x), 1))
    rows = np.arange(len(x))
    order[rows, place] = 0
    order[:, 0] = place
    for stage in range(1, places):
        if not len(x):
            return
        fraction, k = _draw(x, stage, places)
        chosen = order[rows, k]
        order[rows, k] = order[:, stage]
        order[:, stage] = chosen
        np.minimum.at(flat, owner * places + chosen, (np.uint64(stage) << np.uint64(32)) | fraction)
        done = (out.max(axis=1) >> np.uint64(32)) < stage + 1
        if done[owner].any():
            live = ~done[owner]
            x, owner, order = x[live], owner[live], order[live]
            rows = np.arange(len(x))


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A key per set and band; bands differ, so equal keys mean equal bands."""
    parts = signature.reshape(len(signature), bands, ROWS_PER_BAND)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for r in range(ROWS_PER_BAND):
        key = mix64(key ^ (parts[:, :, r] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)))
    return key.view(np.int64)


def digest(elements: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix64(elements * c + c).sum(dtype=np.uint64).astype(np.int64)) for c in _DIGEST)


def signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) of every document."""
    bands = rule.bands

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in each_block(batch, "text", lower=True):
                sets = list(shingle_sets(words, rule.shingle))
                keys = band_keys(signatures(sets, bands * ROWS_PER_BAND), bands)
                digests = [digest(s) for s in sets]
                ends = np.arange(len(sets) + 1, dtype=np.int32) * bands
                numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests])]
                every = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *numbers, every], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return _texts(docs).mapInArrow(released(work), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _few(ids: DataFrame) -> bool:
    """Whether a stored table is small enough to be broadcast: at most FEW rows of two numbers."""
    return ids.limit(FEW + 1).count() <= FEW


def _narrowed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is in ids; by a broadcast if those are few."""
    wanted = ids.select(column).distinct()
    return rows.join(F.broadcast(wanted) if _few(wanted) else wanted, column, "left_semi")


def sets_of(docs: DataFrame, needed: DataFrame, rule: Rule, repeats: bool = True) -> DataFrame:
    """(class_id, d1, elements) of the classes in ``needed`` (class_id).

    repeats: rows may repeat a doc_id; each of its sets is returned once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in each_block(batch, "text", lower=True):
                sets = list(shingle_sets(words, rule.shingle))
                first = pa.array([digest(s)[0] for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), first, pa.array([s.tobytes() for s in sets], pa.binary())], names=["class_id", "d1", "elements"])

    named = _texts(docs).withColumnRenamed("doc_id", "class_id")
    found = _narrowed(named, "class_id", needed).select("class_id", "text").mapInArrow(released(work), "class_id long, d1 long, elements binary")
    return found.dropDuplicates(["class_id", "d1"]) if repeats else found


class _Groups:
    """Union-find over the members of one bucket, many at a time."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[inverse]
        self.size = np.bincount(self.parent, minlength=len(labels))

    def roots(self, members: np.ndarray) -> np.ndarray:
        root = self.parent[members]
        while len(moved := np.flatnonzero(self.parent[root] != root)):
            root[moved] = self.parent[root[moved]]
        self.parent[members] = root
        return root

    def join(self, roots: np.ndarray) -> None:
        """Makes one group of distinct groups."""
        top = roots[np.argmax(self.size[roots])]
        self.size[top] = self.size[roots].sum()
        self.parent[roots] = top


def _prefix(size: np.ndarray, rule: Rule) -> np.ndarray:
    """How many of a set's rarest elements to compare: a similar set has to share one of them."""
    return size - -(-rule.numerator * size // rule.denominator) + 1


def _meetings(inverse: np.ndarray, sizes: np.ndarray, rule: Rule) -> Iterator[np.ndarray]:
    """Members that share one of their rarest elements, for each such element."""
    rarity = np.bincount(inverse)
    rank = np.empty(len(rarity), np.int64)
    rank[np.argsort(rarity, kind="stable")] = np.arange(len(rarity))
    # One number for each element: its member, then its rarity.
    both = np.repeat(np.arange(len(sizes)) * len(rarity), sizes)
    both += rank[inverse]
    both.sort()
    ends = np.cumsum(sizes)
    prefix = _prefix(sizes, rule)
    starts = np.repeat(ends - sizes - (np.cumsum(prefix) - prefix), prefix)
    kept = both[starts + np.arange(len(starts))]
    owner, token = kept // len(rarity), kept % len(rarity)
    lone = int(np.count_nonzero(rarity == 1))  # the rarest of all
    owner, token = owner[token >= lone], token[token >= lone]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for members in np.split(owner, np.flatnonzero(np.diff(token)) + 1) if len(token) else []:
        if len(members) > 1:
            yield members


def links(ids: list[int], sets: list[np.ndarray], rule: Rule, labels: np.ndarray | None = None, centres: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join the members as all links among them would.

    labels: groups already known to be connected.  centres: only pairs with one of
    these members are compared, but all of those.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2 and labels is None:
        both = np.sort(np.concatenate(sets))
        shared = int((both[1:] == both[:-1]).sum())
        linked = rule.denominator * shared >= rule.numerator * (int(sizes.sum()) - shared)
        return [(ids[0], ids[1])] if linked and ids[0] != ids[1] else []
    groups = _Groups(np.arange(len(ids)) if labels is None else labels)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    inverse = np.empty(len(every), np.int32)
    inverse[order] = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]), dtype=np.int32)
    del every, order
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(inverse.max()) + 1, np.int16)
    is_centre = np.ones(len(ids), bool)
    if centres is not None:
        is_centre[:] = False
        is_centre[centres] = True
    out: list[tuple[int, int]] = []
    first = int(np.flatnonzero(is_centre)[0]) if is_centre.any() else 0

    def meetings() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Members that meet, those of them to compare, and whether that is one with all, which may join them all."""
        yield np.arange(len(ids)), np.array([first]), True
        if len(np.unique(groups.roots(np.arange(len(ids))))) > 1:
            for members in _meetings(inverse, sizes, rule):
                yield members, members[is_centre[members]], False

    for members, waiting, star in meetings():
        while len(waiting):
            root, mine = groups.roots(members), groups.roots(waiting)
            if (root == root[0]).all() or (centres is None and not star and (mine == mine[0]).all()):
                break
            i = int(waiting[np.argmin(groups.size[mine])])
            waiting = waiting[waiting != i]
            near = rule.denominator * np.minimum(sizes[members], sizes[i]) >= rule.numerator * np.maximum(sizes[members], sizes[i])
            others = members[near & (root != groups.roots(np.array([i]))[0])]
            if not len(others):
                continue
            ends = np.cumsum(sizes[others])
            at = np.repeat(starts[others] - (ends - sizes[others]), sizes[others]) + np.arange(ends[-1])
            own = inverse[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[inverse[at]], ends - sizes[others], dtype=np.int64)
            mark[own] = 0
            linked = others[rule.denominator * shared >= rule.numerator * (sizes[others] + sizes[i] - shared)]
            if len(linked):
                values, first = np.unique(groups.roots(linked), return_index=True)
                out += [(ids[i], ids[int(k)]) for k in linked[first]]
                groups.join(np.concatenate([groups.roots(np.array([i])), values]))
    return [(a, b) for a, b in out if a != b]


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each run of equal first ``width`` columns, without those columns."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _linked(rows: DataFrame, rule: Rule, width: int, across: bool) -> DataFrame:
    """Links of every bucket; rows come sorted by their first ``width`` columns.

    Further columns: class_id, d1, elements, and for ``across`` label and centre.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, members in _buckets(batches, width):
            merged: dict[tuple, tuple] = {}
            for m in members:
                seen = merged.get(m[:2])
                merged[m[:2]] = m if seen is None or not across else (*m[:4], m[4] or seen[4])
            members = list(merged.values())
            if len(members) > 1:
                sets = [np.frombuffer(m[2], np.uint64) for m in members]
                ids = [m[0] for m in members]
                if across:
                    labels = np.array([m[3] for m in members], np.int64)
                    out += links(ids, sets, rule, labels, np.flatnonzero([m[4] for m in members]))
                else:
                    out += links(ids, sets, rule)
            if len(out) >= 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.mapInArrow(released(work), "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["a", "b"])


def _parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(_parts(rows), *keys).sortWithinPartitions(*keys)


def components(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """(node, root): the smallest node of each node's component, for nodes with an edge other than roots.

    edges: (a, b), a > b.  Returns the working table's path too.
    """

    def star(pairs: DataFrame, large: bool, n_edges: int) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"), "n")
        if n_edges < HUB_ROWS:
            joined = both.join(least, F.col("a") == F.col("u"))
        else:
            share = max(HUB_ROWS, 2 * n_edges // _parts(pairs))
            hubs = F.broadcast(least.where(F.col("n") > share).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))  # at most one for each partition
            marked = both.join(hubs, F.col("a") == F.col("hub"), "left")
            cold = marked.where("hub is null").select("a", "b").join(least, F.col("a") == F.col("u")).select("a", "b", "m")
            joined = cold.unionAll(marked.where("hub is not null").select("a", "b", F.col("hub_m").alias("m")))
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        kept = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.unionAll(joined.select("a", F.col("m").alias("b"))).distinct()

    def checksum(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    spark = edges.sparkSession
    now, path = stored(edges.where("a <> b").distinct(), "links")
    before = checksum(now)
    while before[0]:
        nearer, next_path = stored(star(star(now, True, before[0]), False, before[0]), "links")
        after = checksum(nearer)
        drop(spark, path)
        now, path = nearer, next_path
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")), path


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), block_elements: int = BLOCK_ELEMENTS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document; a stored table."""
    signs, signs_path = stored(signed(docs, rule), "signatures")
    named = signs.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal bands.
    by_set = named.groupBy("d1", "d2", "n_shingles")
    classes, classes_path = stored(by_set.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    repeats = not named.groupBy("doc_id").count().where("count > 1").isEmpty()

    members, members_path = stored(bucket_members(classes, block_elements, block_members), "buckets")
    within = _in_blocks(members, sets_of(docs, members.select("class_id").distinct(), rule, repeats))
    found, found_path = stored(_linked(within, rule, 2, False), "links")
    roots, roots_path = components(found)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        more, more_path = stored(_links_across(docs, large, roots, rule, repeats, block_elements, block_members), "links")
        drop(docs.sparkSession, roots_path)
        roots, roots_path = components(found.unionAll(more))
        drop(docs.sparkSession, more_path)

    alone = signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    result, _ = stored(_grouped(named, classes, roots).unionAll(alone), "near-duplicates")
    drop(docs.sparkSession, signs_path, classes_path, members_path, found_path, roots_path)
    return result


def bucket_members(classes: DataFrame, block_elements: int, block_members: int) -> DataFrame:
    """(key, class_id, d1, n_shingles, first, blocks): members of buckets with more than one class.

    A bucket's key is the smallest of the bands with exactly these members; first
    is its smallest class, blocks how many parts it needs.
    """
    banded = classes.select("class_id", "d1", "n_shingles", F.explode("bands").alias("key"))
    again, again_path = stored(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "bands")
    hits, hits_path = stored(_narrowed(banded, "key", again), "bands")
    drop(classes.sparkSession, again_path)
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / block_elements), F.ceil(F.count("*") / block_members)).cast("int")
    who = F.bit_xor(F.xxhash64("class_id", "d1"))
    summed = hits.groupBy("key").agg(F.count("*").alias("n"), who.alias("who"), F.min("class_id").alias("first"), blocks.alias("blocks"))
    kept = summed.groupBy("n", "who", "first", "blocks").agg(F.min("key").alias("key")).select("key", "first", "blocks")
    members, _ = stored(hits.join(kept, "key").select("key", "class_id", "d1", "n_shingles", "first", "blocks"), "buckets")
    drop(classes.sparkSession, hits_path)
    return members


def _block(width: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "class_id"), width).cast("int")


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, block, class_id, d1, elements), sorted by bucket and block; a bucket's first class is in each of its blocks."""
    in_all = (F.col("class_id") == F.col("first")) & (F.col("blocks") > 1)
    at = F.when(in_all, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(F.col("blocks"), 0)))
    placed = members.select("key", "class_id", "d1", F.explode(at).alias("block"))
    if members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and members.where("blocks > 1").isEmpty():
        placed = F.broadcast(placed)
    return _gathered(sets.join(placed, ["class_id", "d1"]).select("key", "block", "class_id", "d1", "elements"), "key", "block")


def _links_across(docs: DataFrame, large: DataFrame, roots: DataFrame, rule: Rule, repeats: bool, block_elements: int, block_members: int) -> DataFrame:
    """Links between the components that meet in buckets of several blocks."""
    label = large.join(roots, F.col("class_id") == F.col("node"), "left").select("key", "class_id", "d1", "n_shingles", F.coalesce("root", "class_id").alias("label"))
    mixed = label.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows, rows_path = stored(label.join(mixed, "key"), "mixed")

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_py()) // 8 for x in batch.column(5)], np.int64)
            token = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), pa.array(token)], names=["key", "class_id", "d1", "n_shingles", "label", "token"])

    with_sets = rows.join(sets_of(docs, rows.select("class_id").distinct(), rule, repeats), ["class_id", "d1"]).select("key", "class_id", "d1", "n_shingles", "label", "elements")
    tokens = with_sets.mapInArrow(released(rarest), "key long, class_id long, d1 long, n_shingles long, label long, token long")
    rarity = tokens.groupBy("key", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key", "class_id", "d1").orderBy("n", "token"))
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * rule.numerator / rule.denominator) + 1
    met = tokens.join(rarity, ["key", "token"]).withColumn("rank", rank).where((F.col("rank") <= prefix) & (F.col("n") > 1))
    met, met_path = stored(met.select("key", "token", "class_id", "d1", "n_shingles", "label"), "meetings")

    of = ["key", "token"]
    counts = met.groupBy(*of, "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    largest = F.max_by("label", F.struct("n", "label")).alias("main")
    sums = [F.sum("n").alias("n"), F.max("n").alias("n_main"), F.sum("elements").alias("elements")]
    main = counts.groupBy(*of).agg(largest, *sums).where("n > n_main")
    blocks = F.greatest(F.ceil(F.col("elements") / block_elements), F.ceil(F.col("n") / block_members)).cast("int")
    main = main.withColumn("blocks", blocks).withColumn("out_blocks", F.ceil(F.col("blocks") * (F.col("n") - F.col("n_main")) / F.col("n")).cast("int"))
    open_ = met.join(main, of)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = [*of, "class_id", "d1", "label"]
    centre = open_.where("label <> main").select(*row, _block(F.col("out_blocks"), 1).alias("out"), each("blocks").alias("block"), F.lit(True).alias("centre"))
    other = open_.select(*row, each("out_blocks").alias("out"), _block(F.col("blocks"), 0).alias("block"), F.lit(False).alias("centre"))
    placed = centre.unionByName(other)
    keys = [*of, "out", "block"]
    across = sets_of(docs, open_.select("class_id").distinct(), rule, repeats).join(placed, ["class_id", "d1"]).select(*keys, "class_id", "d1", "elements", "label", "centre")
    more, _ = stored(_linked(_gathered(across, *keys), rule, 4, True), "links")
    drop(docs.sparkSession, rows_path, met_path)
    return more


def _grouped(named: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id).

    Copies of hot classes don't meet in one task: classes with more than a
    partition's share of the rows, at most one for each partition, are broadcast.
    """
    total = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    named_sets = classes.select("d1", "d2", "copies", "class_id").join(roots, F.col("class_id") == F.col("node"), "left")
    rooted = named_sets.select("d1", "d2", "copies", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    share = max(1, total // _parts(named))
    large = classes.where(F.col("copies") > share).select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), F.lit(True).alias("hot"))
    rows = named.select("doc_id", "n_shingles", "d1", "d2")
    marked = rows.join(F.broadcast(large), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left")
    few = F.broadcast(rooted.where(F.col("copies") > share).select("d1", "d2", "class_id", "component_id"))
    hot = marked.where("hot").select("doc_id", "n_shingles", "d1", "d2").join(few, ["d1", "d2"])
    cold = marked.where("hot is null").select("doc_id", "n_shingles", "d1", "d2").join(rooted.drop("copies"), ["d1", "d2"])
    out = ["doc_id", "n_shingles", "class_id", "component_id"]
    return hot.select(*out).unionAll(cold.select(*out))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows without a doc_id stay.  Rows that repeat a doc_id count as copies; the one
    with the smallest hash of its text stays.  Documents that are neither dropped nor
    repeated, which most are, stay where they are; only the others are shuffled.
    """
    found = near_duplicates(docs, rule)
    judged = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    special, _ = stored(judged.where("not stays or n > 1").select(F.col("doc_id").alias("id"), "stays"), "dropped")
    # All columns travel in one, so that no name clashes.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    if _few(special):
        marked = rows.join(F.broadcast(special), "id", "left")
        plain = marked.where("stays is null").select("row")
    else:  # rows without an id would meet in one task
        marked = rows.where("id is not null").join(special, "id", "left")
        plain = marked.where("stays is null").select("row").unionAll(rows.where("id is null").select("row"))
    maybe = marked.where("stays").select("id", "row", "tie")
    one = maybe.groupBy("id").agg(F.min_by("row", "tie").alias("row"))
    return plain.select("row.*").unionAll(one.select("row.*"))
