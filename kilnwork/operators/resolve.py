"""Resolution of names and links: equi-joins with fallback, reports and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def link_join(links: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a full key; a missing target gives nulls."""
    return links.join(targets, keys, "left")


def required_join(links: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """As link_join, but a missing target is an error when the row is read."""
    marked = targets.withColumn("__found", F.lit(True))
    joined = links.join(marked, keys, "left")
    ok = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no target for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean")).otherwise(F.lit(True))
    return joined.where(ok).drop("__found")


def resolve(names: DataFrame, primary: DataFrame, fallback: DataFrame, name: str) -> DataFrame:
    """(name, target, via): primary matches of each name, or its fallback matches if there is none.

    primary and fallback have the columns name and target.
    """
    first = names.join(primary, name).select(name, "target", F.lit("primary").alias("via"))
    rest = names.join(primary.select(name).distinct(), name, "left_anti")
    return first.unionAll(rest.join(fallback, name).select(name, "target", F.lit("fallback").alias("via")))


def contains_all(needles: Column, haystack: Column) -> Column:
    """Whether each entry of one map is in the other."""
    return F.forall(F.map_entries(needles), lambda e: F.try_element_at(haystack, e["key"]).eqNullSafe(e["value"]))


def unmatched(names: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return names.join(matches.select(key).distinct(), key, "left_anti")


def reachable(rows: DataFrame, wanted: DataFrame, key: str, links: DataFrame, source: str, target: str) -> DataFrame:
    """Keys of wanted rows, and of what they link to (one level)."""
    direct = rows.join(wanted, key, "left_semi").select(key)
    linked = links.join(direct.select(F.col(key).alias(source)), source, "left_semi").select(F.col(target).alias(key))
    return direct.unionAll(linked).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with the side that holds more of them, as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """base with the values of changes where the key matches; changes hold one row per key."""
    fresh = changes.select(key, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return base.join(fresh, key, "left").withColumn("replaced", F.coalesce("__hit", F.lit(False))).withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def changed(original: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """Status of each original by content hash; a missing current row counts as unedited."""
    now = current.select(key, F.sha2(content, 256).alias("__now"))
    before = F.sha2(content, 256)
    status = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") == before, "same").otherwise("changed")
    return original.join(now, key, "left").withColumn("status", status).drop("__now")


def insert_missing(base: DataFrame, names: DataFrame, name: str, identifier: str, limit: int = 65535) -> DataFrame:
    """base with a row for each distinct new name; ids follow the largest in name order, null past the limit."""
    from kilnwork.operators.keyed import global_index

    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(base.select(name), name, "left_anti")
    top = base.agg(F.coalesce(F.max(identifier), F.lit(0)).cast("long").alias("__top"))
    # The largest id is one row.
    numbered = global_index(fresh, [F.col(name)], "__k").crossJoin(F.broadcast(top))
    number = F.col("__top") + F.col("__k") + 1
    return base.select(name, F.col(identifier).cast("long").alias(identifier)).unionAll(numbered.select(name, F.when(number <= limit, number).alias(identifier)))


def crop(pixels: DataFrame, width: int, height: int, rect: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of a rectangle given bottom-up, moved to its own origin; empty if it leaves the image."""
    x, y, w, h = rect
    if x < 0 or y < 0 or x + w > width or y + h > height:
        return pixels.limit(0)
    top = height - y - h
    inside = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(top, top + h - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - top)


def paste(base: DataFrame, patches: DataFrame, value: str, order: str) -> DataFrame:
    """base (image, x, y, value) with patch pixels over it; the patch with the largest order wins."""
    top = patches.groupBy("image", "x", "y").agg(F.max_by(value, order).alias("__over"), F.max(order).alias("__order"))
    return base.join(top, ["image", "x", "y"], "left").withColumn(value, F.when(F.col("__order").isNotNull(), F.col("__over")).otherwise(F.col(value))).drop("__over", "__order")
