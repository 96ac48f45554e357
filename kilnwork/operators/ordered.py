"""Runs, residuals, layouts and grids: what depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnwork.functions import pixels


def runs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal neighbours: group, run, first, value, n."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.select(*group, F.col(value).alias("value"), F.row_number().over(w).alias("pos"), F.lag(value).over(w).alias("before"))
    changed = (~F.col("value").eqNullSafe(F.col("before")) | (F.col("pos") == 1)).cast("int")
    numbered = marked.withColumn("run", F.sum(changed).over(Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run").agg(F.min("pos").cast("long").alias("first"), F.first("value").alias("value"), F.count("*").alias("n"))


def run_tokens(runs_df: DataFrame, group: list[str], limit: int = (1 << 24) - 1) -> DataFrame:
    """Tokens of runs: a run of two or more is a fill, single elements between fills make one literal.

    group, token, part, kind, first, n; a token over the limit is cut into parts of
    at most ``limit`` elements.
    """
    w = Window.partitionBy(*group).orderBy("first")
    lone = (F.col("n") == 1).cast("int")
    new = F.when((lone == 1) & (F.lag(lone).over(w) == 1), 0).otherwise(1)
    marked = runs_df.withColumn("kind", F.when(lone == 1, "literal").otherwise("fill")).withColumn("new", new)
    numbered = marked.withColumn("token", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy(*group, "token").agg(F.first("kind").alias("kind"), F.min("first").alias("start"), F.sum("n").alias("total"))
    cut = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), pixels.div(F.col("total") - 1, limit))))
    before = F.col("part") * limit
    return cut.select(*group, "token", "part", "kind", (F.col("start") + before).alias("first"), F.least(F.col("total") - before, F.lit(limit).cast("long")).alias("n"))


def expand(runs_df: DataFrame, columns: list[str], n: str = "n") -> DataFrame:
    """One row for each element of each run."""
    return runs_df.where(F.col(n) > 0).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("k"))


def running_start(df: DataFrame, group: list[str], order: list[str], size: Column, name: str) -> DataFrame:
    """Sum of the sizes before each row, within its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(size).over(w) - size)


def chunked(df: DataFrame, group: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Numbers blocks of ``rows`` rows within each group; the last may be short."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn(name, pixels.div(at, rows))


def grid(df: DataFrame, width: str, height: str, tile: int) -> DataFrame:
    """Tiles of each row's rectangle, row-major, clipped at the edges."""
    def starts(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(tile)))

    out = df.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("y0", starts(height)).withColumn("x0", starts(width))
    return out.withColumn("w", F.least(F.lit(tile), F.col(width) - F.col("x0"))).withColumn("h", F.least(F.lit(tile), F.col(height) - F.col("y0")))


def neighbours(df: DataFrame, image: list[str], row: str, column: str, value: str) -> DataFrame:
    """Adds left, up and corner values, 0 outside the image; cells must be unique."""
    across = Window.partitionBy(*image, row).orderBy(column)
    down = Window.partitionBy(*image, column).orderBy(row)
    zero = F.lit(0)
    up = df.withColumn("up", F.coalesce(F.lag(value).over(down), zero))
    return up.withColumn("left", F.coalesce(F.lag(value).over(across), zero)).withColumn("corner", F.coalesce(F.lag("up").over(across), zero))
