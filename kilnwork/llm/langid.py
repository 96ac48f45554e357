"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words bounded
by a separator, lower case) in order of rank.  A document's distance to a
language is the sum over its own profile of how far each n-gram is out of place
in the language's, at most PROFILE for one that is absent.

Learning uses a hash-chosen sample of about SAMPLE_ROWS labelled rows of each of
the MAX_LANGUAGES most frequent languages, documented bounds; prediction reads
every whole text, however long.  Profiles are ranked in Spark; the driver gets at
most PROFILE rows a language.

Edge cases: null texts and texts without a letter give ``und`` and score 0, as
does an empty training table.  Ties between n-grams go to the smaller code,
between languages to the alphabetically first.  Repeated rows are predicted one
by one.  A null doc_id is carried and not held out.  Null or empty languages are
not learned.  Only named columns are read, whatever else there is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnwork.llm.textblocks import released

PROFILE = 400
SAMPLE_ROWS, MAX_LANGUAGES = 3_000, 1_000
UNDETERMINED = "und"
_SEPARATOR = 1
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a whole text; 21 bits a character, so lengths can't clash."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    s = np.full(len(points) + 2, _SEPARATOR, np.uint64)
    s[1:-1][letter] = points[letter]
    solid = s != _SEPARATOR
    solid[1:] |= solid[:-1].copy()
    solid[0] = True
    s = s[solid]
    if s[0] == _SEPARATOR and len(s) > 1 and s[1] == _SEPARATOR:
        s = s[1:]
    two = (s[:-1] << np.uint64(21)) | s[1:]
    three = (two[:-1] << np.uint64(21)) | s[2:]
    return np.concatenate([s[s != _SEPARATOR], two, three])


def top_grams(codes: np.ndarray, limit: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:limit]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    codes: np.ndarray  # sorted codes of all profiles
    ranks: np.ndarray  # code x language; PROFILE where a language lacks it

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        mine = top_grams(codes)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        known = self.codes[at] == mine
        place = np.arange(len(mine))[known][:, None]
        apart = np.abs(place - self.ranks[at[known]]).clip(max=PROFILE)
        apart[self.ranks[at[known]] == PROFILE] = PROFILE
        distance = apart.sum(axis=0) + PROFILE * int((~known).sum())
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(mine)))


def profiles_of(ranked: dict[str, np.ndarray]) -> Profiles:
    languages = sorted(ranked)
    codes = np.unique(np.concatenate([ranked[x] for x in languages])) if languages else np.empty(0, np.uint64)
    ranks = np.full((len(codes), len(languages)), PROFILE, np.int64)
    for k, x in enumerate(languages):
        ranks[np.searchsorted(codes, ranked[x]), k] = np.arange(len(ranked[x]))
    return Profiles(languages, codes, ranks)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles from labelled rows that are not held out; the driver gets those of the sample only."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != "")).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    shares = counts.select(F.col("lang").alias("learned"), (F.lit(float(sample_rows)) / F.col("n")).alias("share"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, n = np.unique(gram_codes(text), return_counts=True)
                mine = found.setdefault(lang, Counter())
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    mine[v] += c
        for lang, mine in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "code", "n"])

    # At most MAX_LANGUAGES rows.
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("learned")).where(part < F.col("share"))
    totals = sample.select("text", "lang").mapInArrow(released(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Each task keeps the first PROFILE of a language before they meet.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    got = totals.withColumn("rank", rank).where(F.col("rank") <= PROFILE).toPandas()
    return profiles_of({lang: of.sort_values("rank")["code"].to_numpy(np.uint64) for lang, of in got.groupby("lang")})


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(2)]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(released(work), "doc_id long, held_out boolean, lang_pred string, score double")
