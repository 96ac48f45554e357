"""URL rules in a memory-mapped sorted array of 64-bit digests.

An index holds the xxhash of every rule string in ascending order, the strings
themselves in the same order, each rule's verdict, and the lengths of the rules'
paths.  It is written to files, shipped to each executor once
(SparkContext.addFile) and mapped there.  All candidate strings of a batch of urls
are probed with one binary search; a digest that is found is confirmed by
comparing the stored string, so a collision can't give a wrong verdict.  Hosts and
paths are cut out by Spark.

A rule is a host followed by a path prefix.  Candidates of a url are all
suffixes of its host at dots, each with the prefixes of its path that are as
long as some rule's path.  The longest rule string wins, then the longer host.

An index is for rule sets of a size that an executor can map: ``build`` refuses
more than MAX_INDEX_BYTES.  Larger sets are judged by ``judge_by_join``, an
equi-join on the candidates.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule and gets the default verdict, as does any url without a fitting rule.
Repeated urls are judged row by row; duplicates of a rule keep the last verdict.
A null page_id is carried; urls of any length are read whole; an empty table or
rule set gives no rows or no fitting rule.  Only page_id and url are read,
whatever else there is.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnwork.llm.shared import new_path, put_bytes

MAX_INDEX_BYTES = 1 << 28
DEFAULT_VERDICT = "allow"
#: The contract's rules: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z), and path; empty for a null url or one without ://."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, f"(?s)^.*?://{pattern}", 1), F.lit(""))
    return F.translate(part("([^/?#]*)"), _UPPER, _LOWER), part("[^/?#]*([^?#]*)")


def candidates(host: str, path: str, lengths: Iterable[int]) -> list[str]:
    """Strings of rules that would fit, longest first; then those with the longer host."""
    if not host:
        return []
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts if h for n in lengths if n <= len(path)]
    return [x[2] for x in sorted(found, reverse=True)]


class DigestIndex:
    """Sorted digests, probed by binary search; the strings confirm."""

    def __init__(self, prefix: str):
        self._digests = np.load(f"{prefix}.digests.npy", mmap_mode="r")
        self._meta = np.load(f"{prefix}.strings.npy", mmap_mode="r")
        #: Lengths of the rules' paths, rising.
        self.lengths = np.load(f"{prefix}.lengths.npy").tolist()
        n = len(self._digests)
        self._starts = self._meta[: 8 * (n + 1)].view(np.int64)
        self._blocked = self._meta[8 * (n + 1) : 8 * (n + 1) + n]
        self._bytes = self._meta[8 * (n + 1) + n :]

    @staticmethod
    def build(rules: dict[str, bool]) -> dict[str, bytes]:
        """The contents of the files; rules: string to whether it blocks."""
        if sum(len(x.encode()) + 17 for x in rules) > MAX_INDEX_BYTES:
            raise ValueError("too many rules for a mapped index; use judge_by_join")
        order = sorted((xxhash.xxh64_intdigest(x.encode()), x) for x in rules)
        raw = [x.encode() for _, x in order]
        starts = np.cumsum([0, *(len(x) for x in raw)]).astype(np.int64)
        blocked = np.array([rules[x] for _, x in order], np.uint8)
        strings = np.concatenate([starts.view(np.uint8), blocked, np.frombuffer(b"".join(raw), np.uint8)])
        out = {}
        lengths = np.array(sorted({len(x) - len(x.partition("/")[0]) for x in rules}), np.int64)
        for part, array in (("digests", np.array([d for d, _ in order], np.uint64)), ("strings", strings), ("lengths", lengths)):
            np.save(file := io.BytesIO(), array)
            out[part] = file.getvalue()
        return out

    def probe(self, strings: list[str]) -> np.ndarray:
        """Position of each string, or -1."""
        raw = [x.encode("utf-8", "surrogatepass") for x in strings]
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        out = np.full(len(raw), -1, np.int64)
        if not len(self._digests) or not len(raw):
            return out
        at = np.searchsorted(self._digests, wanted)
        for k in np.flatnonzero(self._digests[np.minimum(at, len(self._digests) - 1)] == wanted):
            i = int(at[k])
            while i < len(self._digests) and self._digests[i] == wanted[k]:
                if self._bytes[self._starts[i] : self._starts[i + 1]].tobytes() == raw[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def blocks(self, position: int) -> bool:
        return bool(self._blocked[position])


_open: dict[str, DigestIndex] = {}


def _mapped(name: str) -> DigestIndex:
    if name not in _open:
        _open[name] = DigestIndex(os.path.join(SparkFiles.getRootDirectory(), name))
    return _open[name]


def ship(spark: SparkSession, rules: dict[str, bool]) -> str:
    """Builds an index, puts it in the shared folder and has every executor fetch it once; returns its name."""
    name = "rules-" + xxhash.xxh64_hexdigest(repr(sorted(rules.items())).encode())
    sent = {os.path.basename(x) for x in spark.sparkContext.listFiles}
    for part, data in DigestIndex.build(rules).items():
        if f"{name}.{part}.npy" not in sent:
            path = f"{new_path(spark, 'url-index')}/{name}.{part}.npy"
            put_bytes(spark, path, data)
            spark.sparkContext.addFile(path)
    return name


def judge(pages: DataFrame, rules: dict[str, bool]) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""
    name = ship(pages.sparkSession, rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for batch in batches:
            tries = [candidates(h, p, index.lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = index.probe([x for y in tries for x in y])
            rule, verdict, at = [], [], 0
            for y in tries:
                hit = next((k for k in range(at, at + len(y)) if found[k] >= 0), None)
                rule.append(None if hit is None else y[hit - at])
                verdict.append(DEFAULT_VERDICT if hit is None else "block" if index.blocks(found[hit]) else "allow")
                at += len(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(work, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, lengths: list[int]) -> DataFrame:
    """As judge, for rule tables (rule string, blocks boolean) of any size; lengths: of all rules' paths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = [candidates(h, p, lengths) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tries, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "tries"])

    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.mapInArrow(work, "row long, page_id long, host string, path string, tries array<string>")
    tried = rows.select("row", "page_id", "host", "path", F.posexplode_outer("tries").alias("order", "rule"))
    hit = tried.join(rules.select("rule", "blocks"), "rule", "left")
    best = hit.groupBy("row", "page_id", "host", "path").agg(F.min(F.when(F.col("blocks").isNotNull(), F.struct("order", "rule", "blocks"))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.blocks"), "block").otherwise(DEFAULT_VERDICT).alias("verdict"))
