"""Queries over part: names, dictionaries, palettes, colour arithmetic, grids, crops and pastes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kilnwork.functions import names, pixels
from kilnwork.operators import keyed, ordered, resolve
from kilnwork.plans.registry import query, table
from kilnwork.sources import codecs


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("dense_id", "SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS id FROM (SELECT DISTINCT p_name FROM part)")
def dense_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.dense_ids(_parts(spark, sf_dir), "p_name", limit=100_000_000)


@query("sanitize", "SELECT p_partkey, CASE WHEN p_type = '' THEN '_' ELSE regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') END AS name FROM part")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", names.sanitize(F.concat("p_type", F.lit("/"), "p_brand")).alias("name"))


_SUFFIXED = "SELECT p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN '' ELSE '@' || p_size % 4 || 'x' END AS name FROM part"


@query("suffix_parse", f"SELECT p_partkey, regexp_replace(name, '@[123]x$', '') AS base, coalesce(TRY_CAST(nullif(regexp_extract(name, '@([123])x$', 1), '') AS INTEGER), 1) AS scale FROM ({_SUFFIXED})")
def suffix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = (F.col("p_size") % 4).cast("string")
    named = _parts(spark, sf_dir).select("p_partkey", F.concat("p_name", F.when(rest == "0", "").otherwise(F.concat(F.lit("@"), rest, F.lit("x")))).alias("name"))
    base, scale = names.scale_suffix(F.col("name"))
    return named.select("p_partkey", base.alias("base"), scale.alias("scale"))


@query("suffix_disambiguate", "SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE p_name || '-' || n END AS file FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def suffix_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.disambiguated(_parts(spark, sf_dir), "p_name", [F.col("p_partkey")], "file").select("p_partkey", "file")


_STEMS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '-' || (p_size % 7) ELSE p_brand END AS stem FROM part"


@query(
    "suffix_clash",
    f"""WITH s AS ({_STEMS}), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) - 1 AS n FROM s),
        free AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) AS n FROM (SELECT stem, unnest(range(1, max(n) + 10)) AS k FROM n GROUP BY stem)
            WHERE stem || '-' || k NOT IN (SELECT stem FROM s))
        SELECT p_partkey, CASE WHEN n.n = 0 THEN stem ELSE stem || '-' || k END AS file FROM n LEFT JOIN free USING (stem, n)""",
)
def suffix_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: numbered names leave out those that are another row's own."""
    brand = F.col("p_brand")
    stem = F.when(F.col("p_partkey") % 5 == 0, F.concat(brand, F.lit("-"), (F.col("p_size") % 7).cast("string"))).otherwise(brand)
    rows = _parts(spark, sf_dir).select("p_partkey", stem.alias("stem"))
    return keyed.disambiguated(rows, "stem", [F.col("p_partkey")], "file").select("p_partkey", "file")


@query("format_path", "SELECT p_partkey, 'renditions/' || CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END || '-' || p_name AS path FROM part")
def format_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", names.ordinal_path("renditions", F.col("p_partkey"), F.col("p_name")).alias("path"))


@query("strip_numeric_prefix", "SELECT p_partkey, regexp_replace(p_partkey || '-' || p_name, '^[0-9]*-', '') AS name FROM part")
def strip_numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", names.strip_ordinal(F.concat(F.col("p_partkey").cast("string"), F.lit("-"), "p_name")).alias("name"))


@query("name_substitute", "SELECT p_partkey, replace(p_type, 'STEEL', 'BRASS') AS name FROM part")
def name_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.replace("p_type", F.lit("STEEL"), F.lit("BRASS")).alias("name"))


_KNOWN = {"scale": 12, "idiom": 15, "element": 1, "part": 2, "identifier": 17}
_NAME_SQL = "CASE p_size " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in _KNOWN.items()) + " ELSE 'attr' || p_size END"
_CODE_SQL = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _KNOWN.items()) + " ELSE TRY_CAST(regexp_extract(name, '^attr([0-9]+)$', 1) AS INTEGER) END"


@query("dict_encode_open", f"SELECT p_partkey, name, {_CODE_SQL} AS code FROM (SELECT p_partkey, p_size, {_NAME_SQL} AS name FROM part)")
def dict_encode_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _parts(spark, sf_dir).select("p_partkey", names.decode_open(F.col("p_size"), _KNOWN, "attr").alias("name"))
    return named.select("p_partkey", "name", names.encode_open(F.col("name"), _KNOWN, "attr").alias("code"))


@query("enum_open_tail", "SELECT p_partkey, CASE p_size WHEN 0 THEN 'none' WHEN 1 THEN 'rle' WHEN 2 THEN 'zip' ELSE '0x' || lower(lpad(hex(p_size), 8, '0')) END AS name FROM part")
def enum_open_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") == 0, "none").when(F.col("p_size") == 1, "rle").when(F.col("p_size") == 2, "zip").otherwise(names.hex_code(F.col("p_size")))
    return _parts(spark, sf_dir).select("p_partkey", name.alias("name"))


@query("distinct_at_most", "SELECT p_brand, count(DISTINCT p_size) <= 40 AS few FROM part GROUP BY p_brand")
def distinct_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy("p_brand").agg((F.countDistinct("p_size") <= 40).alias("few"))


#: An image for each brand: a pixel per part, in order of its key, with a colour of 16 levels a channel.
_PIXELS = "SELECT p_brand AS image, p_partkey AS pos, (p_size % 16) * 17 AS r, (p_partkey % 16) * 17 AS g, (CAST(p_retailprice AS BIGINT) % 16) * 17 AS b FROM part"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: (c % 16) * 17
    return _parts(spark, sf_dir).select(F.col("p_brand").alias("image"), F.col("p_partkey").alias("pos"), level(F.col("p_size")).cast("long").alias("r"), level(F.col("p_partkey")).alias("g"), level(F.rint("p_retailprice").cast("long")).alias("b"))


_PALETTE = f"SELECT image, r, g, b, count(*) AS n, min(pos) AS first FROM ({_PIXELS}) GROUP BY image, r, g, b"


def _palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pixels(spark, sf_dir).groupBy("image", "r", "g", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return found.withColumn("entry", (F.row_number().over(Window.partitionBy("image").orderBy("first")) - 1).cast("long"))


@query("first_appearance_palette", f"SELECT image, r, g, b, n, first, row_number() OVER (PARTITION BY image ORDER BY first) - 1 AS entry FROM ({_PALETTE})")
def first_appearance_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _palette(spark, sf_dir)


@query("palette_lookup", f"SELECT image, pos, r, g, b FROM ({_PIXELS})")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels coded by palette entry and looked up again."""
    palette = _palette(spark, sf_dir)
    coded = _pixels(spark, sf_dir).join(palette, ["image", "r", "g", "b"]).select("image", "pos", "entry")
    return coded.join(palette.select("image", "entry", "r", "g", "b"), ["image", "entry"]).select("image", "pos", "r", "g", "b")


@query("weighted_median", f"SELECT image, min(r) AS split FROM (SELECT image, r, 2 * sum(n) OVER (PARTITION BY image ORDER BY r) >= sum(n) OVER (PARTITION BY image) AS over FROM (SELECT image, r, count(*) AS n FROM ({_PIXELS}) GROUP BY ALL)) WHERE over GROUP BY image")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level where twice the running count reaches the whole."""
    counts = _pixels(spark, sf_dir).groupBy("image", "r").agg(F.count("*").alias("n"))
    image = Window.partitionBy("image")
    running = F.sum("n").over(image.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    marked = counts.withColumn("over", 2 * running >= F.sum("n").over(image))
    return marked.where("over").groupBy("image").agg(F.min("r").alias("split"))


@query("weighted_mean_int", f"SELECT image, CAST((sum(r) + count(*) // 2) // count(*) AS BIGINT) AS r, CAST((sum(g) + count(*) // 2) // count(*) AS BIGINT) AS g, CAST((sum(b) + count(*) // 2) // count(*) AS BIGINT) AS b FROM ({_PIXELS}) GROUP BY image")
def weighted_mean_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means weighted by the palette's counts, rounded half up in integers."""
    weight = F.sum("n")

    def mean(c: str) -> Column:
        return pixels.div(F.sum(F.col(c) * F.col("n")) + pixels.div(weight, 2), weight).alias(c)

    return _palette(spark, sf_dir).groupBy("image").agg(mean("r"), mean("g"), mean("b"))


@query("widest_column", f"SELECT image, CASE WHEN rr >= gg AND rr >= bb THEN 'r' WHEN gg >= bb THEN 'g' ELSE 'b' END AS widest, greatest(rr, gg, bb) AS width FROM (SELECT image, max(r) - min(r) AS rr, max(g) - min(g) AS gg, max(b) - min(b) AS bb FROM ({_PIXELS}) GROUP BY image)")
def widest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = _pixels(spark, sf_dir).groupBy("image").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "rgb"])
    width = F.greatest("r", "g", "b")
    return span.select("image", F.when(F.col("r") == width, "r").when(F.col("g") == width, "g").otherwise("b").alias("widest"), width.alias("width"))


_YCC = "SELECT p_partkey, p_partkey % 256 AS y, p_size % 64 - 32 AS c1, (p_partkey * 7) % 64 - 32 AS c2 FROM part"


def _ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 256).alias("y"), (F.col("p_size").cast("long") % 64 - 32).alias("c1"), ((F.col("p_partkey") * 7) % 64 - 32).alias("c2"))


@query("ycocg_inverse", f"SELECT p_partkey, least(greatest(y - c1 - c2, 0), 255) AS r, least(greatest(y + c2, 0), 255) AS g, least(greatest(y + c1 - c2, 0), 255) AS b FROM ({_YCC})")
def ycocg_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = pixels.rgb_of(F.col("y"), F.col("c1"), F.col("c2"))
    return _ycc(spark, sf_dir).select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    "lattice_cost",
    """WITH p AS (SELECT DISTINCT p_partkey % 256 AS r, p_size * 5 AS g, (p_partkey * 3) % 256 AS b FROM part),
        k AS (SELECT r, g, b, r + x AS r2, g + y AS g2, b + z AS b2 FROM p, range(-2, 3) i(x), range(-2, 3) j(y), range(-2, 3) k(z)),
        l AS (SELECT r, g, b, ((r2 + 256) % 256 - r) ** 2 + ((g2 + 256) % 256 - g) ** 2 + ((b2 + 256) % 256 - b) ** 2 AS cost FROM k WHERE (b2 - r2) % 2 = 0 AND (b2 + r2 - 2 * g2) % 4 = 0)
        SELECT r, g, b, min(cost)::BIGINT AS cost FROM l GROUP BY r, g, b""",
)
def lattice_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the forward colour transform's lattice point is, modulo 256; no point of 125 is nearer."""
    p = F.col("p_partkey")
    colours = _parts(spark, sf_dir).select((p % 256).alias("r"), (F.col("p_size") * 5).cast("long").alias("g"), ((p * 3) % 256).alias("b")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = np.stack([np.asarray(c) for c in batch.columns], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codecs.wrapped_cost(codecs.from_lattice(codecs.to_lattice(rgb)), rgb))], names=["r", "g", "b", "cost"])

    return colours.mapInArrow(work, "r long, g long, b long, cost long")


@query("clamp_quantize", "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 0 ELSE CAST(floor(least(greatest(p_retailprice / 1000.0 - 0.5, 0.0), 1.0) * 255 + 0.5) AS BIGINT) END AS level FROM part")
def clamp_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_size") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 1000.0 - 0.5)
    return _parts(spark, sf_dir).select("p_partkey", pixels.quantize8(value).alias("level"))


@query("channel_reorder", f"SELECT image, pos, b AS c0, g AS c1, r AS c2, 255 AS c3 FROM ({_PIXELS})")
def channel_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("image", "pos", F.col("b").alias("c0"), F.col("g").alias("c1"), F.col("r").alias("c2"), F.lit(255).alias("c3"))


@query("tile_grid", "SELECT p_partkey, x0::INTEGER AS x0, y0::INTEGER AS y0, least(16, p_size - x0)::INTEGER AS w, least(16, p_size // 2 + 1 - y0)::INTEGER AS h FROM part, range(0, p_size, 16) a(x0), range(0, p_size // 2 + 1, 16) b(y0)")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _parts(spark, sf_dir).select("p_partkey", F.col("p_size").alias("width"), (pixels.div(F.col("p_size"), 2) + 1).cast("int").alias("height"))
    return ordered.grid(sized, "width", "height", 16).select("p_partkey", "x0", "y0", "w", "h")


_XY = "SELECT p_brand AS image, (p_partkey % 40)::BIGINT AS x, ((p_partkey // 40) % 48)::BIGINT AS y, max(p_size)::BIGINT AS v FROM part GROUP BY ALL"


def _canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return _parts(spark, sf_dir).groupBy(F.col("p_brand").alias("image"), (p % 40).alias("x"), (pixels.div(p, 40) % 48).alias("y")).agg(F.max("p_size").cast("long").alias("v"))


@query("crop_flip", f"SELECT image, x - 4 AS x, y - 38 AS y, v FROM ({_XY}) WHERE x BETWEEN 4 AND 11 AND y BETWEEN 38 AND 45")
def crop_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle at x 4, y 2 from the bottom, 8 by 8, of 40 by 48 images."""
    return resolve.crop(_canvas(spark, sf_dir), 40, 48, (4, 2, 8, 8)).select("image", "x", "y", "v")


@query("paste_overlay", f"WITH c AS ({_XY}) SELECT image, x, y, CASE WHEN x BETWEEN 6 AND 9 AND y BETWEEN 3 AND 8 THEN 2000 + x WHEN x BETWEEN 2 AND 7 AND y BETWEEN 5 AND 12 THEN 1000 + y ELSE v END AS v FROM c")
def paste_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping patches over every image; the later one wins."""
    base = _canvas(spark, sf_dir)

    def patch(order: int, xs: range, ys: range, value: Column) -> DataFrame:
        spots = spark.range(xs.start, xs.stop).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(ys.start).cast("long"), F.lit(ys.stop - 1).cast("long"))).alias("y"))
        return base.select("image").distinct().crossJoin(F.broadcast(spots)).withColumn("v", value).withColumn("ord", F.lit(order))  # a patch's area is fixed

    patches = patch(1, range(2, 8), range(5, 13), 1000 + F.col("y")).unionAll(patch(2, range(6, 10), range(3, 9), 2000 + F.col("x")))
    return resolve.paste(base, patches, "v", "ord")


@query("promote_on_condition", f"SELECT image, CASE WHEN bool_or(r <> g OR g <> b) THEN 'colour' ELSE 'gray' END AS format, count(*) AS n FROM (SELECT image, r, CASE WHEN image LIKE '%1' THEN r ELSE g END AS g, CASE WHEN image LIKE '%1' THEN r ELSE b END AS b FROM ({_PIXELS})) GROUP BY image")
def promote_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images become colour images only if some pixel has chroma."""
    gray = F.col("image").endswith("1")
    edited = _pixels(spark, sf_dir).select("image", "r", F.when(gray, F.col("r")).otherwise(F.col("g")).alias("g"), F.when(gray, F.col("r")).otherwise(F.col("b")).alias("b"))
    chroma = F.bool_or((F.col("r") != F.col("g")) | (F.col("g") != F.col("b")))
    return edited.groupBy("image").agg(F.when(chroma, "colour").otherwise("gray").alias("format"), F.count("*").alias("n"))
