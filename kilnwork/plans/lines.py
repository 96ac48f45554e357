"""Queries over lineitem: censuses, predictors, layouts and channel arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kilnwork.functions import pixels
from kilnwork.operators import keyed, ordered
from kilnwork.plans.registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("census_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def census_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("census_filtered", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus")
def census_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_returnflag = 'R'").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("census_conditional", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS total FROM lineitem GROUP BY l_suppkey")
def census_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.count("*").alias("total"))


#: An image per supplier: a cell per order and line number, the smallest quantity of equal places.
_CELLS = "SELECT l_suppkey AS image, l_orderkey % 64 AS y, l_linenumber AS x, CAST(min(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL"
_NEAR = f"""WITH c AS ({_CELLS}), u AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image, x ORDER BY y), 0) AS up FROM c),
    nb AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image, y ORDER BY x), 0) AS lf, coalesce(lag(up) OVER (PARTITION BY image, y ORDER BY x), 0) AS corner FROM u)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 64).alias("y"), F.col("l_linenumber").alias("x")]
    return _lines(spark, sf_dir).groupBy(*keys).agg(F.min("l_quantity").cast("long").alias("v"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbours(_cells(spark, sf_dir), ["image"], "y", "x", "v")


@query("predict_left_fold", _NEAR + " SELECT image, y, x, CASE WHEN v - lf < 0 THEN -(v - lf) * 2 + 1 ELSE (v - lf) * 2 END AS code FROM nb")
def predict_left_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("image", "y", "x", pixels.fold(F.col("v") - F.col("left")).alias("code"))


@query("predict_up", _NEAR + " SELECT image, y, x, v - up AS residual FROM nb")
def predict_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("image", "y", "x", (F.col("v") - F.col("up")).alias("residual"))


@query("predict_gradient", _NEAR + " SELECT image, y, x, v - CASE WHEN abs(up - corner) <= abs(lf - corner) THEN lf ELSE up END AS residual FROM nb")
def predict_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = pixels.gradient_choice(F.col("left"), F.col("up"), F.col("corner"))
    return _near(spark, sf_dir).select("image", "y", "x", (F.col("v") - choice).alias("residual"))


@query("predict_mean", _NEAR + " SELECT image, y, x, v - ((lf + up + 1) >> 1) AS residual FROM nb")
def predict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("image", "y", "x", (F.col("v") - pixels.mean_floor(F.col("left"), F.col("up"))).alias("residual"))


@query("unpredict_left", _CELLS)
def unpredict_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals summed along each row give the values back."""
    residuals = _near(spark, sf_dir).withColumn("d", F.col("v") - F.col("left"))
    row = Window.partitionBy("image", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return residuals.select("image", "y", "x", F.sum("d").over(row).alias("v"))


@query("unfold", "SELECT DISTINCT CAST(l_quantity AS BIGINT) - 25 AS d, CAST(l_quantity AS BIGINT) - 25 AS again FROM lineitem")
def unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_quantity").cast("long") - 25
    return _lines(spark, sf_dir).select(d.alias("d")).distinct().select("d", pixels.unfold(pixels.fold(F.col("d"))).alias("again"))


_COSTS = """, k AS (SELECT image, y, 0 AS sel, sum(abs(v))::BIGINT AS cost FROM nb GROUP BY ALL UNION ALL SELECT image, y, 1, sum(abs(v - lf))::BIGINT FROM nb GROUP BY ALL
    UNION ALL SELECT image, y, 2, sum(abs(v - up))::BIGINT FROM nb WHERE y > 0 GROUP BY ALL)"""


@query("argmin_per_group", _NEAR + _COSTS + " SELECT image, y, arg_min(sel, cost * 10 + sel) AS sel, min(cost) AS cost FROM k GROUP BY image, y")
def argmin_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest predictor of each row; the first row may not look up; ties go to the first."""
    near = _near(spark, sf_dir).groupBy("image", "y").agg(F.sum(F.abs("v")).alias("c0"), F.sum(F.abs(F.col("v") - F.col("left"))).alias("c1"), F.sum(F.abs(F.col("v") - F.col("up"))).alias("c2"))
    options = F.array(F.struct(F.col("c0").alias("cost"), F.lit(0).alias("sel")), F.struct(F.col("c1").alias("cost"), F.lit(1).alias("sel")), F.struct(F.when(F.col("y") > 0, F.col("c2")).alias("cost"), F.lit(2).alias("sel")))
    best = F.array_min(F.filter(options, lambda o: o["cost"].isNotNull()))
    return near.select("image", "y", best["sel"].alias("sel"), best["cost"].alias("cost"))


@query("chunk_bands", "SELECT l_suppkey, chunk, count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM (SELECT l_suppkey, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) // 100 AS chunk FROM lineitem) GROUP BY ALL")
def chunk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.chunked(_lines(spark, sf_dir), ["l_suppkey"], ["l_orderkey"], 100, "chunk")
    return rows.groupBy("l_suppkey", "chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


_BANDS = "SELECT l_suppkey, l_orderkey, sum(l_linenumber)::BIGINT AS rows FROM lineitem GROUP BY ALL"


@query("bands_running_start", f"SELECT l_suppkey, l_orderkey, rows, (sum(rows) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - rows)::BIGINT AS start FROM ({_BANDS})")
def bands_running_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _lines(spark, sf_dir).groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_linenumber").alias("rows"))
    return ordered.running_start(bands, ["l_suppkey"], ["l_orderkey"], F.col("rows"), "start")


@query("offset_layout", f"SELECT l_suppkey, l_orderkey, padded, (sum(padded) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - padded)::BIGINT AS start FROM (SELECT l_suppkey, l_orderkey, ((rows + 15) // 16) * 16 AS padded FROM ({_BANDS}))")
def offset_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks padded to 16, laid out one after the other."""
    bands = _lines(spark, sf_dir).groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_linenumber").alias("rows")).withColumn("padded", pixels.round_up(F.col("rows"), 16))
    return ordered.running_start(bands.drop("rows"), ["l_suppkey"], ["l_orderkey"], F.col("padded"), "start")


_LEAVES = "SELECT l_suppkey, leaf, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n FROM (SELECT l_suppkey, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) // 14 AS leaf FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) GROUP BY l_suppkey, leaf"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a tree with nodes of 128 bytes: (128 - 12) div 8 entries each."""
    keys = ordered.chunked(_lines(spark, sf_dir).select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], ["l_orderkey"], (128 - 12) // 8, "leaf")
    return keys.groupBy("l_suppkey", "leaf").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("*").alias("n"))


@query("btree_leaf_ranges", _LEAVES)
def btree_leaf_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir)


@query("leaf_siblings", f"SELECT l_suppkey, leaf, coalesce(lag(leaf) OVER w, -1) AS before, coalesce(lead(leaf) OVER w, -1) AS after FROM ({_LEAVES}) WINDOW w AS (PARTITION BY l_suppkey ORDER BY leaf)")
def leaf_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, none = Window.partitionBy("l_suppkey").orderBy("leaf"), F.lit(-1).cast("long")
    return _leaves(spark, sf_dir).select("l_suppkey", "leaf", F.coalesce(F.lag("leaf").over(w), none).alias("before"), F.coalesce(F.lead("leaf").over(w), none).alias("after"))


_CA = "SELECT l_orderkey % 256 AS c, l_partkey % 256 AS a FROM lineitem GROUP BY ALL"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select((F.col("l_orderkey") % 256).alias("c"), (F.col("l_partkey") % 256).alias("a")).distinct()


@query("premul", f"SELECT c, a, (c * a + 127) // 255 AS p FROM ({_CA})")
def premul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).select("c", "a", pixels.premultiply(F.col("c"), F.col("a")).alias("p"))


@query("unpremul", f"SELECT c, a, CASE WHEN a = 0 THEN 0 ELSE least((least(c, a) * 255 + a // 2) // a, 255) END AS s FROM ({_CA})")
def unpremul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).select("c", "a", pixels.unpremultiply(F.least("c", "a"), F.col("a")).alias("s"))


@query("hi_lo_split", "SELECT l_partkey % 65536 AS v, (l_partkey % 65536) >> 8 AS high, (l_partkey % 65536) & 255 AS low, (((l_partkey % 65536) >> 8) << 8) | ((l_partkey % 65536) & 255) AS again FROM lineitem GROUP BY ALL")
def hi_lo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines(spark, sf_dir).select((F.col("l_partkey") % 65536).alias("v")).distinct()
    high, low = F.shiftright("v", 8), F.col("v").bitwiseAND(255)
    return v.select("v", high.alias("high"), low.alias("low"), F.shiftleft(high, 8).bitwiseOR(low).alias("again"))


@query("round_up_32", "SELECT CAST(l_quantity AS BIGINT) AS width, ((CAST(l_quantity AS BIGINT) * 4 + 31) // 32) * 32 AS stride FROM lineitem GROUP BY ALL")
def round_up_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = _lines(spark, sf_dir).select(F.col("l_quantity").cast("long").alias("width")).distinct()
    return width.select("width", pixels.round_up(F.col("width") * 4, 32).alias("stride"))


_TRIPLE = "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 45) AS a, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 45) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 45) AS r FROM lineitem GROUP BY l_suppkey"


@query("zero_omit_map", f"SELECT l_suppkey, attr, value FROM (SELECT l_suppkey, unnest(['a', 'n', 'r']) AS attr, unnest([a, n, r]) AS value FROM ({_TRIPLE})) WHERE value <> 0")
def zero_omit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("l_quantity") > 45
    counts = [F.count_if(big & (F.col("l_returnflag") == f.upper())).alias(f) for f in "anr"]
    sparse = _lines(spark, sf_dir).groupBy("l_suppkey").agg(*counts).select("l_suppkey", keyed.sparse_from_dense(list("anr"), [F.col(f) for f in "anr"]).alias("key"))
    return sparse.select("l_suppkey", F.explode("key").alias("attr", "value"))


@query("any_predicate", "SELECT l_orderkey, bool_or(l_discount > 0.09) AS any_large FROM lineitem GROUP BY l_orderkey")
def any_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.09).alias("any_large"))


@query("all_predicate", "SELECT l_orderkey, bool_and(l_tax <= 0.06 AND l_quantity >= 5) AS all_small FROM lineitem GROUP BY l_orderkey")
def all_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.bool_and((F.col("l_tax") <= 0.06) & (F.col("l_quantity") >= 5)).alias("all_small"))


@query("sortedness_check", "SELECT l_orderkey, bool_and(coalesce(before <= l_shipdate, true)) AS ascending FROM (SELECT l_orderkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS before FROM lineitem) GROUP BY l_orderkey")
def sortedness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate"))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_shipdate", before.alias("before"))
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.col("before") <= F.col("l_shipdate"), F.lit(True))).alias("ascending"))
