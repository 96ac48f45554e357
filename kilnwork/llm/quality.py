"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio.

``fit`` counts hashed unigrams and bigrams of tokens (runs of letters and digits,
runs of other signs; case kept) for two multinomials: the raw corpus, over all
documents, and the trusted target, over half of all trusted rows.  A bucket's weight is log((n + PRIOR) / (e + PRIOR)), where n is its target
count and e the count that the raw corpus leads to expect there; without evidence
it is near zero.  A document's score is the mean weight of its n-grams, so length
does not matter.  One threshold holds for every document: of the scores of
labelled rows that the target did not see, the cut that best tells trusted from
distrusted rows (see ``choose_threshold``).

Edge cases: a null or empty text has zeros everywhere and score 0, and fails the
base rule; an empty corpus or one without labelled rows gives a model that keeps
whatever the base rule keeps; a single-class sample does too.  Repeated rows are
judged alike, one by one, and count as often as they occur; a score equal to the
threshold is kept.  A null doc_id is carried and never labelled.  Texts of any
length are read whole.  Only doc_id, text and the labels' named columns are read,
whatever else there is; ``keep`` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kilnwork.llm.shared import drop, stored
from kilnwork.llm.textblocks import TOKEN_KINDS, each_block, grams, released

BUCKET_BITS = 16
#: Of the labelled rows, so many are broadcast at once.
SLICE_ROWS = 1 << 20
#: Scores are counted in cells of this part of one.
CELLS = 1024
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Pseudo-count of a bucket, in the target and in what is expected there.
PRIOR = 5.0
#: Of the trusted rows that the target did not see, at most this share may fall under the threshold.
MAX_TRUSTED_LOSS = 0.005
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bucket
    threshold: float


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a document's unigrams and bigrams."""
    return (np.concatenate([hashes, grams(hashes, 2)]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _feature_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, object]]:
    yield from each_block(batch, "text", lower=False, kinds=TOKEN_KINDS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BUCKET_BITS
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        trusted = np.array(batch.column(1).to_pylist(), object) if batch.num_rows else []
        for a, b, words in _feature_blocks(batch):
            for i in range(a, b):
                ids = buckets(words.hashes[words.ptr[i - a] : words.ptr[i - a + 1]])
                np.add.at(raw, ids, 1)
                if trusted[i]:
                    np.add.at(target, ids, 1)
    used = np.flatnonzero(raw + target)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "n_raw", "n_target"])


def _repeat_words(g: np.ndarray) -> int:
    """Words in windows that are found twice or more; g: hashes of a text's windows."""
    ordered = np.sort(g)
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return 0
    found = np.flatnonzero(np.isin(g, np.unique(ordered[1:][again])))
    edge = np.zeros(len(g) + WINDOW, np.int64)
    edge[found] += 1
    np.subtract.at(edge, found + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    solid = [x for x in lines if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    return len(solid) - len(set(solid))


def text_stats(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Counts over whole texts; words are runs of bytes other than ASCII white space."""
    n = batch.num_rows
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for a, b, words in each_block(batch, "text", lower=False):
        ptr, rows, data = words.ptr, words.rows, words.data
        out["n_words"][a:b] = np.diff(ptr)
        head = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~((data == 32) | ((data >= 9) & (data <= 13))))])
        out["word_chars"][a:b] = np.diff(head[rows])
        signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        out["n_symbols"][a:b] = np.diff(signs[rows])
        every = grams(words.hashes, WINDOW)
        for i in range(b - a):
            x, y = int(ptr[i]), int(ptr[i + 1])
            if y - x > WINDOW:
                out["n_repeat_words"][a + i] = _repeat_words(every[x : y - WINDOW + 1])
            out["n_dup_lines"][a + i] = _dup_lines(data[rows[i] : rows[i + 1]].tobytes())
    return out


def scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for a, b, words in _feature_blocks(batch):
        for i in range(a, b):
            part = words.hashes[words.ptr[i - a] : words.ptr[i - a + 1]]
            if len(part):
                out[i] = weights[buckets(part)].mean()
    return out


def _gains(good_below: np.ndarray, bad_below: np.ndarray, good: int, bad: int) -> np.ndarray:
    """Gain of cuts with so many rows of either class below; -1 for those that lose too many trusted rows."""
    lost, caught = good_below / good, bad_below / bad
    return np.where(lost <= MAX_TRUSTED_LOSS, caught - lost, -1.0)


def choose_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the highest balanced accuracy among those that lose few trusted rows.

    Ties go to the lowest cut; the threshold is halfway from there to the next
    score below.  Without both classes, minus infinity.
    """
    if not len(good) or not len(bad):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    k = int(np.argmax(_gains(np.searchsorted(good, cuts, side="left"), np.searchsorted(bad, cuts, side="left"), len(good), len(bad))))
    return float((cuts[k] + cuts[k - 1]) / 2) if k else float("-inf")


def threshold_of(scored: DataFrame) -> float:
    """choose_threshold over all rows (trusted, score); the driver gets counts by cells of scores.

    Cells whose best cut could still be the best of all are then counted score by score.
    """
    scored = scored.withColumn("cell", F.floor(F.col("score") * CELLS))
    counts = (F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    cells = scored.groupBy("cell").agg(*counts).toPandas().sort_values("cell", ignore_index=True)
    good, bad = int(cells["good"].sum()), int(cells["bad"].sum())
    if not good or not bad:
        return float("-inf")
    good_to, bad_to = (cells[n].cumsum().to_numpy(np.int64) for n in ("good", "bad"))
    good_from, bad_from = good_to - cells["good"].to_numpy(np.int64), bad_to - cells["bad"].to_numpy(np.int64)
    at_most, sure = _gains(good_from, bad_to, good, bad), _gains(good_from, bad_from, good, bad)
    left = np.flatnonzero(at_most >= sure.max())
    best, cut = -2.0, 0.0
    found = scored.where(F.col("cell").isin(cells["cell"].iloc[left].tolist())).groupBy("cell", "score").agg(*counts).toPandas()
    by_cell = dict(list(found.sort_values("score").groupby("cell")))
    for k in left.tolist():
        rows = by_cell[cells["cell"].iloc[k]]
        below = [first + rows[n].cumsum().to_numpy(np.int64) - rows[n].to_numpy(np.int64) for n, first in (("good", good_from[k]), ("bad", bad_from[k]))]
        gain = _gains(*below, good, bad)
        if gain.max() > best:
            best, cut = float(gain.max()), float(rows["score"].iloc[int(np.argmax(gain))])
    under = scored.where(F.col("score") < cut).agg(F.max("score").alias("score")).first()["score"]
    return float("-inf") if under is None else (cut + under) / 2


def judged_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted, target) of every labelled doc_id.

    Trusted: quality 1 and not toxic; half of them, by hash, make the target.
    Distrusted: quality 0.  Rows with null labels or ids are left out; a doc_id
    that is labelled both ways counts as distrusted.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = F.when(F.col("quality") == 0, F.lit(False)).when(good, F.lit(True))
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), trusted.alias("trusted")).where("trusted is not null and doc_id is not null")
    judged = judged.groupBy("doc_id").agg(F.bool_and("trusted").alias("trusted"))
    return judged.withColumn("target", F.col("trusted") & (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0))


#: Its name when it took a sample.
labelled_sample = judged_labels


def fit(docs: DataFrame, labels: DataFrame, slice_rows: int = SLICE_ROWS) -> Model:
    """Counts over all documents and all labelled rows.

    Labelled rows are broadcast in slices, each a job of its own, so that texts are
    never shuffled; the driver gets 2**16 buckets and what threshold_of counts.
    """
    spark, size = docs.sparkSession, 1 << BUCKET_BITS
    judged, place = stored(judged_labels(labels), "judged")
    n = max(1, -(-judged.count() // slice_rows))
    part = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(n))
    slices = [F.broadcast(judged.where(part == k) if n > 1 else judged) for k in range(n)]
    raw, target = np.zeros(size), np.zeros(size)
    for k, mine in enumerate(slices):
        # The first slice's job counts all documents, others their own.
        joined = docs.select("doc_id", "text").join(mine, "doc_id", "left") if k == 0 else docs.select("doc_id", "text").join(mine.where("target"), "doc_id")
        counted = joined.select("text", "target").mapInArrow(released(_count), "bucket long, n_raw long, n_target long")
        got = counted.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).toPandas()
        at = got["bucket"].to_numpy(np.int64)
        target[at] += got["n_target"].to_numpy(float)
        if k == 0:
            raw[at] += got["n_raw"].to_numpy(float)
    if not target.sum():
        drop(spark, place)
        return Model(np.zeros(size), float("-inf"))
    weights = np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores(batch, weights))], names=["trusted", "score"])

    places, every = [place], None
    for mine in slices:
        unseen = docs.select("doc_id", "text").join(mine.where("not target"), "doc_id")
        scored, at = stored(unseen.select("text", "trusted").mapInArrow(released(score), "trusted boolean, score double"), "label-scores")
        places.append(at)
        every = scored if every is None else every.unionAll(scored)
    threshold = threshold_of(every)
    drop(spark, *places)
    return Model(weights, threshold)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the statistics, score, base_failed and kept of every document."""
    weights, threshold = model.weights, model.threshold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_stats(batch)
            score = scores(batch, weights)
            failed = base_failed(stats["n_words"], stats["n_repeat_words"])
            verdicts = [pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
            names = ["doc_id", *stats, "score", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in stats.values()), *verdicts], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(work), STATS + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with all their columns."""
    weights, threshold = model.weights, model.threshold
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            stats = text_stats(texts)
            failed = base_failed(stats["n_words"], stats["n_repeat_words"])
            yield batch.filter(pa.array(~failed & (scores(texts, weights) >= threshold)))

    return docs.mapInArrow(released(work), docs.schema)
