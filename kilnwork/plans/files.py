"""Queries that write catalogs from part, one file a brand, and read them again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.operators import catalogs
from kilnwork.plans.registry import query, table
from kilnwork.sources import catalog, codecs, records

_KEYS = ["dimension2", "dimension1", "scale"]


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Relations of a catalog for each brand: a gray bitmap of p_size by 2 for each part, and a facet for each type."""
    part = table(spark, sf_dir, "part").withColumn("path", F.col("p_brand"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for key, size in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                level = np.arange(2 * size, dtype=np.int64).reshape(2, size, 1) * key % 256
                image = np.concatenate([level, level, level, np.full_like(level, 255)], axis=2).astype(np.uint8)
                payloads.append(codecs.bitmap_encode(image, "rle" if key % 2 else "zlib", codecs.row_stride(size, "GA8"), "GA8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], names=[*batch.schema.names, "payload"])

    painted = part.select("path", "p_partkey", "p_name", "p_type", "p_size").mapInArrow(paint, "path string, p_partkey long, p_name string, p_type string, p_size int, payload binary")
    key = F.map_filter(F.create_map(F.lit("dimension2"), F.shiftright("p_partkey", 16).cast("int"), F.lit("dimension1"), (F.col("p_partkey") % 65536).cast("int"), F.lit("scale"), F.lit(1)), lambda k, v: v != 0)
    fixed = {"rid": F.lit(0), "key_bytes": F.lit(b""), "key": key, "name": F.col("p_name"), "name_bytes": F.col("p_name").cast("binary"), "layout": F.lit(records.IMAGE_LAYOUT), "pixel_format": F.lit("GA8"), "width": F.col("p_size"), "height": F.lit(2), "scale": F.lit(100), "version": F.lit(1), "unknown_a": F.lit(1), "tlvs": F.array().cast("array<struct<ord:int,tag:bigint,data:binary>>"), "payload": F.col("payload"), "kind": F.lit("image"), "compression": F.lit(None).cast("string")}
    schema = catalog._schema(catalog.SCHEMAS["renditions"])
    renditions = painted.select("path", *[fixed.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in schema if f.name != "path"])
    heads = part.select("path").distinct()
    zero = ("coreui_version", "storage_version", "storage_timestamp", "rendition_count", "associated_checksum", "schema_version", "color_space_id", "key_semantics")
    info = {"main_version_string": F.lit("kilnwork"), "version_string": F.col("path"), "uuid": F.md5("path"), "key_format": F.array(*[F.lit(k) for k in _KEYS]), "metadata": F.lit(None).cast("array<string>"), "extra_vars": F.create_map(F.lit("NOTE"), F.col("path").cast("binary"))} | {z: F.lit(0).cast("long") for z in zero}
    schema = catalog._schema(catalog.SCHEMAS["car_info"])
    names = part.groupBy("path", F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("k"))
    empty = lambda name: spark.createDataFrame([], catalog.SCHEMAS[name])
    return {
        "car_info": heads.select("path", *[info[f.name].alias(f.name) for f in schema if f.name != "path"]),
        "facets": names.select("path", "name", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("hotspot"), F.create_map(F.lit("dimension1"), (F.col("k") % 65536).cast("int")).alias("attributes"), F.lit(None).cast("string").alias("problem")),
        "appearances": heads.select("path", F.concat(F.lit("look of "), "path").alias("name"), F.lit(7).alias("id")),
        "localizations": empty("localizations"),
        "bitmap_keys": names.select("path", F.col("k").alias("key"), F.col("name").cast("binary").alias("value")).where("key < 4294967296"),
        "renditions": renditions,
    }


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.parse_frame(catalog.build_catalogs(_parts(spark, sf_dir)), name)


@query("catalog_renditions", "SELECT p_brand AS path, p_name AS name, p_partkey % 65536 AS dimension1, p_size::BIGINT AS width, CASE WHEN p_partkey % 2 = 1 THEN 'rle' ELSE 'zlib' END AS compression, 'image' AS kind FROM part")
def catalog_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renditions after a round trip through files."""
    return _read(spark, sf_dir, "renditions").select("path", "name", F.coalesce(F.try_element_at("key", F.lit("dimension1")), F.lit(0)).cast("long").alias("dimension1"), "width", "compression", "kind")


@query("catalog_headers", "SELECT p_brand AS path, count(*) AS n, sum(p_size)::BIGINT AS width, max(p_size)::BIGINT AS widest FROM part GROUP BY p_brand")
def catalog_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "rendition_headers").groupBy("path").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.max("width").alias("widest"))


@query("catalog_info", "SELECT p_brand AS path, count(*) AS declared, p_brand AS version_string, md5(p_brand) AS uuid, p_brand AS note FROM part GROUP BY p_brand")
def catalog_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "car_info").select("path", F.col("rendition_count").alias("declared"), "version_string", "uuid", F.try_element_at("extra_vars", F.lit("NOTE")).cast("string").alias("note"))


@query("catalog_names", "SELECT p_brand AS path, p_type AS name, min(p_partkey) % 65536 AS dimension1 FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'look of ' || p_brand, 7 FROM part GROUP BY p_brand UNION ALL SELECT p_brand, p_type, min(p_partkey) FROM part GROUP BY p_brand, p_type")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets, appearances and inline-key entries after a round trip."""
    facets = _read(spark, sf_dir, "facets").select("path", "name", F.try_element_at("attributes", F.lit("dimension1")).cast("long").alias("dimension1"))
    looks = _read(spark, sf_dir, "appearances").select("path", "name", F.col("id").cast("long"))
    return facets.unionAll(looks).unionAll(_read(spark, sf_dir, "bitmap_keys").select("path", F.col("value").cast("string"), "key"))


@query("catalog_census", "SELECT p_brand AS path, CASE WHEN p_partkey % 2 = 1 THEN 'rle' ELSE 'zlib' END AS compression, count(*) AS n FROM part GROUP BY ALL")
def catalog_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.census({"renditions": _read(spark, sf_dir, "renditions"), "car_info": _read(spark, sf_dir, "car_info")})["compression"]


@query("bitmap_decode", "SELECT p_brand AS path, p_size::BIGINT AS width, sum(list_sum(list_transform(range(0, 2 * p_size), lambda i: (i * p_partkey) % 256)))::BIGINT AS total FROM part GROUP BY ALL")
def bitmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of all gray levels, decoded from run-length and zlib payloads."""
    pixels = catalogs.bitmaps(_read(spark, sf_dir, "renditions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_py(), np.uint8)[::4].sum(dtype=np.int64)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["path", "width", "total"])

    return pixels.select("path", "width", "rgba").mapInArrow(add, "path string, width bigint, total bigint").groupBy("path", "width").agg(F.sum("total").alias("total"))
