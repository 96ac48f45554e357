"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents, whatever further ones there are and whatever their names.
Rows without a doc_id pass the stages that compare documents; null texts count as
empty, which the quality rules reject.  Of rows that repeat a doc_id one stays in
near-dedup; ties between near copies go to the smallest doc_id, between lines to
the largest.  Texts of any length are read whole.  An empty table gives an empty
result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.llm import decontaminate, linededup, neardup, packing, quality
from kilnwork.llm.queries import tokenizer_path
from kilnwork.llm.shared import drop, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the likelihood ratio."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents that lose all their text stay, with an empty one.

    n_chars, where the table has it, is the number of characters that are left.
    """
    runs = linededup.bitmaps(docs)
    done = linededup.apply(docs, runs)
    text = F.when(F.col("line_dedup.had_text"), F.col("line_dedup.kept_text"))
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        shorter = F.col("line_dedup.n_dropped") > 0
        fresh["n_chars"] = F.when(shorter, F.char_length("line_dedup.kept_text")).otherwise(F.col("doc.n_chars"))
    column = lambda c: fresh[c] if c in fresh else F.col(f"doc.`{c}`")
    return done.select(*[column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8 or more)."""
    return neardup.keep_one(docs, neardup.Rule())


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of up to 2048 tokens."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The likelihood ratio, the tokenizer and the packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, fresh = stored(stage(spark, docs, sf_dir), name)
        if path:
            drop(spark, path)
        path = fresh
    return STAGES[-1][1](spark, docs, sf_dir)
