"""Catalogs as they arrive in a folder, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.sources.catalog import parse_frame

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, table: str = "renditions", files_per_batch: int = 1000) -> DataFrame:
    """A streaming relation of all catalogs that come into a folder; each file is parsed once."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(path)
    return parse_frame(files, table)


def running_census(renditions: DataFrame) -> DataFrame:
    """Renditions by kind and compression so far; the state is one row for each pair."""
    return renditions.groupBy("kind", F.coalesce("compression", F.lit("none")).alias("compression")).agg(F.count("*").alias("n"))
