"""Queries over embeddings: nearest entries and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnwork.functions import pixels
from kilnwork.plans.registry import query, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


_PAIRS = "FROM embeddings e, (SELECT min(vec_id) AS entry, arg_min(embedding, vec_id) AS other FROM embeddings GROUP BY label ORDER BY entry LIMIT 256) p"
_SQUARED = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - other[i]::DOUBLE) ** 2))"


@query("nearest_l2", f"SELECT vec_id, arg_min(entry, (d, entry)) AS entry, round(min(d), 4) AS distance FROM (SELECT vec_id, entry, {_SQUARED} AS d {_PAIRS}) GROUP BY vec_id")
def nearest_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest palette entry by squared distance; ties go to the first.

    The palette is each label's first vector, up to the 256 entries that a palette can hold.
    """
    vectors = _vectors(spark, sf_dir)
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding")).orderBy("vec_id").limit(256)
    palette = first.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("palette"))
    each = F.transform("palette", lambda p: F.struct(_squared(F.col("embedding"), p["embedding"]).alias("d"), p["vec_id"].alias("entry")))
    found = vectors.crossJoin(F.broadcast(palette)).select("vec_id", F.array_min(each).alias("best"))
    return found.select("vec_id", F.col("best.entry").alias("entry"), F.round("best.d", 4).alias("distance"))


@query("best_match_per_key", "SELECT label, arg_min(vec_id, n) AS vec_id, round(min(n), 4) AS norm FROM (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2)) AS n FROM embeddings) GROUP BY label")
def best_match_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = _vectors(spark, sf_dir).select("label", "vec_id", norm.alias("n"))
    return rows.groupBy("label").agg(F.min_by("vec_id", F.struct("n", "vec_id")).alias("vec_id"), F.round(F.min("n"), 4).alias("norm"))


_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_DIFF = "list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))"


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute differences between each vector and the one with the next id."""
    vectors = _vectors(spark, sf_dir)
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    diff = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return vectors.join(after, "vec_id").select("vec_id", diff.alias("diff"))


@query("max_abs_diff", f"SELECT a.vec_id, round(list_max({_DIFF}), 5) AS peak {_NEXT}")
def max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir).select("vec_id", F.round(F.array_max("diff"), 5).alias("peak"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the one with the next id; those of ids divisible by 7 lose their last value."""
    vectors = _vectors(spark, sf_dir)
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", F.lit(1), F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return vectors.select("vec_id", cut.alias("embedding")).join(after, "vec_id")


@query("count_over_tol", f"SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN -1 ELSE len(list_filter({_DIFF}, lambda d: d > 0.25)) END AS n_over {_NEXT}")
def count_over_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples beyond the tolerance; -1 for vectors of different lengths."""
    return _neighbours(spark, sf_dir).select("vec_id", pixels.samples_over(F.col("embedding"), F.col("other"), 0.25).alias("n_over"))


@query("pixels_over_tol", f"SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE len(list_filter(range(0, len(d) // 4), lambda k: list_max(d[k * 4 + 1:k * 4 + 4]) > 0.25)) END AS n_over FROM (SELECT a.vec_id, {_DIFF} AS d {_NEXT})")
def pixels_over_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As count_over_tol, for groups of four samples."""
    return _neighbours(spark, sf_dir).select("vec_id", pixels.pixels_over(F.col("embedding"), F.col("other"), 0.25).alias("n_over"))


@query("mean_abs_err", f"SELECT a.vec_id, round(list_avg({_DIFF}), 5) AS mean {_NEXT}")
def mean_abs_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("diff", F.lit(0.0), lambda s, d: s + d)
    return _differences(spark, sf_dir).select("vec_id", F.round(total / F.size("diff"), 5).alias("mean"))
