"""Sparse and dense keys, dictionaries of ids, and de-duplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kilnwork.functions.workspace import stored


def sparse_from_dense(names: list[str], values: list[Column]) -> Column:
    """Map of the values that are not 0; 0 means absent."""
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    return F.map_filter(every, lambda k, v: v != 0)


def dense_from_sparse(key: Column, names: list[str]) -> Column:
    """Values in the order of the names, 0 where absent."""
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at(key, n), F.lit(0)))


def take_until(values: Column, stop: Column) -> Column:
    """The values before the first that equals ``stop``; all without one."""
    at = F.array_position(values, stop).cast("int")
    return F.when(at > 0, F.slice(values, F.lit(1), at - 1)).otherwise(values)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order, by an aggregate with partial results."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A gapless number from 0 in global order, without a single-partition window.

    Rows are range-partitioned, sorted and written to the shared folder; each
    partition's rows are numbered in place, and the driver gets one count for
    each partition.  Ties in order are numbered arbitrarily; give a full order.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.orderBy(*order).withColumn("__at", at), "indexed")
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("part")).count().collect()
    before, total = {}, 0
    for row in sorted(counts, key=lambda r: r["part"]):
        before[row["part"]] = total
        total += row["count"]
    starts = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, start long")
    # One row for each partition.
    return rows.join(F.broadcast(starts), part == F.col("part")).withColumn(name, F.col("start") + local).drop("__at", "part", "start")


def dense_ids(names: DataFrame, column: str, name: str = "id", limit: int = 65535) -> DataFrame:
    """1-based ids of the sorted distinct names; an id over the limit is an error."""
    found = global_index(names.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], name)
    number = F.col(name) + 1
    return found.withColumn(name, F.when(number > limit, F.raise_error(F.lit(f"more than {limit} names")).cast("long")).otherwise(number))


def next_id(df: DataFrame, column: str, limit: int = 65535) -> DataFrame:
    """One row: the largest id and one, null if that passes the limit."""
    top = F.coalesce(F.max(column), F.lit(0)).cast("long") + 1
    return df.agg(F.when(top <= limit, top).alias("next_id"))


def smallest_free_id(df: DataFrame, column: str) -> DataFrame:
    """One row: the smallest positive id that is not used."""
    used = df.select(F.col(column).cast("long").alias("k")).where("k >= 1").distinct()
    after = used.select((F.col("k") + 1).alias("k")).unionAll(df.sparkSession.range(1, 2).select(F.col("id").alias("k")))
    return after.join(used, "k", "left_anti").agg(F.min("k").alias("free_id"))


def disambiguated(df: DataFrame, stem: str, order: list[Column], name: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds a free name per row: the stem, then stem-1, stem-2, in order within the stem.

    Names that are another row's stem, or in the first column of ``taken``, are left
    out, so names are unique.  A row's place among its stem's comes from a global
    order, so a frequent stem is no single task's.
    """
    placed = global_index(df, [F.col(stem), *order], "__place")
    stems = placed.groupBy(stem).agg(F.min("__place").alias("__first")).select(F.col(stem).alias("__stem"), "__first")
    used = stems.select(F.col("__stem").alias("used"))
    if taken is not None:
        held = taken.select(F.col(taken.columns[0]).alias("used"))
        used = used.unionAll(held)
        whole = held.distinct().select(F.col("used").alias("__stem"), F.lit(1).alias("__held"))
    else:
        whole = stems.limit(0).select("__stem", F.lit(1).alias("__held"))
    # Numbers that are not free for a stem, as a sorted array.
    number = F.regexp_extract("used", "^.*-([1-9][0-9]{0,8})$", 1).try_cast("int")
    numbered = used.select(F.regexp_extract("used", "^(.*)-[1-9][0-9]{0,8}$", 1).alias("__stem"), number.alias("k")).where("k is not null")
    gone = numbered.groupBy("__stem").agg(F.array_sort(F.collect_set("k")).alias("__gone"))
    every = stems.join(gone, "__stem", "left").join(whole, "__stem", "left")
    joined = placed.join(every, placed[stem].eqNullSafe(every["__stem"]), "left")
    n = F.col("__place") - F.col("__first") + F.coalesce("__held", F.lit(0))
    # The n-th free number: one more for each number in the array that it passes.
    skipped = F.size(F.filter(F.transform("__gone", lambda k, i: k - i), lambda k: k <= n))
    free = (n + F.coalesce(skipped, F.lit(0))).cast("string")
    return joined.withColumn(name, F.when(n == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), free))).select(*df.columns, name)
