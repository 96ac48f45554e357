"""Queries that run the catalog operators on catalogs of every kind of rendition, one file a brand.

Each part is a rendition whose kind follows from its key; the files are written,
parsed again, and only then asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kilnwork.functions import names
from kilnwork.functions.workspace import new_folder, write_files
from kilnwork.operators import catalogs, workdir
from kilnwork.plans.registry import query, table
from kilnwork.sources import catalog, codecs, images, records

_KEY_FORMAT = ["dimension2", "dimension1", "scale", "element", "identifier"]
ATLAS = 24
#: Identifiers of parts end here; the last two of the format are the atlas's and a missing target's.
MOST_PARTS = 65533
#: The kinds of parts, by key modulo 8.
KINDS = ("image", "image", "link", "data", "color", "gradient", "multisize", "raw_payload")
_KIND = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"


def _solid(width: int, height: int, colour: tuple[int, int, int, int]) -> np.ndarray:
    return np.broadcast_to(np.array(colour, np.uint8), (height, width, 4))


def _image(rgba: np.ndarray, name: str, compression: str, pixel: str, *, chunked: bool = False) -> tuple[records.Rendition, str]:
    height, width = rgba.shape[:2]
    stride = codecs.row_stride(width, pixel)
    tlvs = [(records.SLICES, records.pack_slices([(0, 0, width, height)])), (records.METRICS, records.pack_metrics([1, 2, 3, 4, width, height])), (records.COMPOSITION, records.pack_composition(1, 0.5)), (records.ROW_STRIDE, stride.to_bytes(4, "little"))]
    payload = codecs.bitmap_encode(rgba, compression, stride, pixel, chunked=chunked)
    return records.Rendition(width=width, height=height, scale=100, pixel_format=records.pixel_format_code(pixel), layout=records.IMAGE_LAYOUT, name=name.encode(), tlvs=tlvs, payload=payload), compression


def _rendition(k: int, s: int) -> tuple[records.Rendition, str | None]:
    """A part's rendition, and its compression if it is a bitmap."""
    name, kind = f"p{k}", k % 8
    if kind == 0:
        return _image(_solid(s, 2, (k % 256, s, 7, 255)), name, "zlib", "ARGB")
    if kind == 1:
        return _image(_solid(s, 3, (k % 256,) * 3 + (255,)), name, "lzfse", "GA8", chunked=bool(s % 2))
    plain = records.Rendition(width=2, height=3, name=name.encode(), layout=1000 + kind, tlvs=[(0x3ED, b"x"), (99, bytes([s])), (99, b"later")])
    if kind == 2:
        plain.layout = records.LINK_LAYOUT
        target = {"element": 9, "identifier": 65535 if s % 5 else 65534}  # the second has no rendition
        plain.tlvs.append((records.LINK_TAG, records.Link(k % 10, s % 8, 2, 3, 12, target).pack()))
    elif kind == 3:
        text = (f"<svg id='{k}'/>" if s % 2 else f"%PDF-{k}").encode()
        plain.layout, plain.pixel_format = records.VECTOR_LAYOUT, records.pixel_format_code("SVG" if s % 2 else "PDF")
        plain.payload = codecs.raw_encode(codecs.deflate(text, "lzfse"), True) if s % 2 else codecs.raw_encode(text)
    elif kind == 4:
        plain.payload = records.Colour(s % 3, [k / 8, s / 4, 0.5, 1.0], f"system{s % 4}" if s % 2 else None).pack()
    elif kind == 5:
        plain.payload = records.Gradient(s % 2, 0, (0.0, 0.5, 1.0, 0.25), [(0.0, f"n{k - 1}"), (0.5, f"n{k + 7}"), (1.0, "nobody")]).pack()
    elif kind == 6:
        plain.payload, plain.layout = records.pack_multisize([(s, s, 1), (2 * s, 2 * s, 2)]), records.MULTISIZE_LAYOUT
    else:
        plain.payload = (b"\xff\xd8\xff" if s % 2 else b"RTXT") + bytes([s])
    return plain, None


def _row(path: str, key: dict[str, int], r: records.Rendition, compression: str | None) -> tuple:
    tlvs = [{"ord": i, "tag": t, "data": d} for i, (t, d) in enumerate(r.tlvs)]
    name = r.name.decode()
    head = (path, 0, b"", list(key.items()), name, r.name, r.layout, r.flags, records.pixel_format_name(r.pixel_format), r.color_space_id, r.width, r.height, r.scale, r.modified)
    return *head, r.version, r.unknown_a, r.unknown_b, tlvs, r.payload, records.content_kind(r), compression


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Relations of a catalog for each brand, as they are before they become files.

    Identifiers are a part's place in its file by key, so no two parts of a file share one; the other numbers in a
    rendition's key are its part's lowest 32 bits.
    """
    place = F.row_number().over(Window.partitionBy("path").orderBy("p_partkey"))  # one file is one task's
    part = table(spark, sf_dir, "part").withColumn("path", F.col("p_brand")).withColumn("place", place)
    part = part.withColumn("identifier", F.when(F.col("place") > MOST_PARTS, F.raise_error(F.lit(f"more than {MOST_PARTS} parts of a brand")).cast("int")).otherwise(F.col("place")))
    heads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path")).distinct()
    schema = to_arrow_schema(catalog._schema(catalog.SCHEMAS["renditions"]))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, k, s, identifier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = {n: v for n, v in (("dimension2", k >> 16 & 65535), ("dimension1", k & 65535), ("scale", 1), ("identifier", identifier)) if v}
                rows.append(_row(path, key, *_rendition(k, s)))
            yield catalog._batch(rows, schema) if rows else pa.RecordBatch.from_pylist([], schema)

    def atlas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(ATLAS)
        image = np.zeros((ATLAS, ATLAS, 4), np.uint8)
        image[..., 0], image[..., 1], image[..., 3] = at[None, :] * 8, at[:, None] * 8, 255
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield catalog._batch([_row(path, {"element": 9, "identifier": 65535}, *_image(image, "atlas", "zlib", "ARGB"))], schema)

    made = part.select("path", "p_partkey", "p_size", "identifier").mapInArrow(paint, catalog.SCHEMAS["renditions"])
    made = made.unionAll(heads.mapInArrow(atlas, catalog.SCHEMAS["renditions"]))
    zero = ("coreui_version", "storage_version", "storage_timestamp", "rendition_count", "associated_checksum", "schema_version", "color_space_id", "key_semantics")
    metadata = F.array(F.lit("thin"), F.col("path"), F.lit("macos"), F.lit("tool"))
    info = {"main_version_string": F.lit("kilnwork"), "version_string": F.col("path"), "uuid": F.md5("path"), "key_format": F.array(*[F.lit(x) for x in _KEY_FORMAT]), "metadata": metadata, "extra_vars": F.create_map(F.lit("NOTE"), F.col("path").cast("binary"))}
    info |= {z: F.lit(0).cast("long") for z in zero}
    facet = F.create_map(F.lit("element"), F.lit(1), F.lit("identifier"), F.col("identifier"))
    empty = lambda name: spark.createDataFrame([], catalog.SCHEMAS[name])
    return {
        "car_info": heads.select("path", *[info[f.name].alias(f.name) for f in catalog._schema(catalog.SCHEMAS["car_info"]) if f.name != "path"]),
        "facets": part.select("path", F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.struct(F.col("p_size").alias("x"), F.lit(2).alias("y")).alias("hotspot"), facet.alias("attributes"), F.lit(None).cast("string").alias("problem")),
        "appearances": heads.select("path", F.lit("any").alias("name"), F.lit(0).alias("id")),
        "localizations": empty("localizations"),
        "bitmap_keys": empty("bitmap_keys"),
        "renditions": made,
    }


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The relations of the written files."""
    return catalog.parse_tables(catalog.build_catalogs(relations(spark, sf_dir)))


def _number(name: str) -> F.Column:
    return F.regexp_extract(name, "([0-9]+)$", 1).cast("long")


# Kinds and records.


@query("kind_census", f"SELECT p_brand AS path, {_KIND} AS kind, count(*) AS n FROM part WHERE p_partkey % 8 > 1 GROUP BY ALL UNION ALL SELECT p_brand, 'image', count(*) FILTER (WHERE p_partkey % 8 < 2) + 1 FROM part GROUP BY p_brand")
def kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of content, told from layout, records and payload."""
    return catalogs.census(_tables(spark, sf_dir))["kind"]


@query("layout_census", "SELECT p_brand AS path, CASE p_partkey % 8 WHEN 0 THEN 12 WHEN 1 THEN 12 WHEN 2 THEN 1003 WHEN 3 THEN 9 WHEN 6 THEN 1010 ELSE 1000 + p_partkey % 8 END AS layout, count(*) AS n FROM part WHERE p_partkey % 8 > 1 GROUP BY ALL UNION ALL SELECT p_brand, 12, count(*) FILTER (WHERE p_partkey % 8 < 2) + 1 FROM part GROUP BY p_brand")
def layout_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return catalogs.census(_tables(spark, sf_dir))["layout"].select("path", F.col("layout").cast("long").alias("layout"), "n")


@query("label_census", f"SELECT path, label, count(*) AS n FROM (SELECT p_brand AS path, CASE WHEN p_partkey % 8 = 0 THEN 'zlib' WHEN p_partkey % 8 = 1 THEN CASE WHEN p_size % 2 = 1 THEN 'lzfse-chunked' ELSE 'lzfse' END ELSE {_KIND} END AS label FROM part UNION ALL SELECT DISTINCT p_brand, 'zlib' FROM part) GROUP BY ALL")
def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps by compression and whether they are chunked, others by kind."""
    return catalogs.census(_tables(spark, sf_dir))["label"]


@query("declared_census", "SELECT p_brand AS path, count(*) + 1 AS declared, count(*) + 1 AS actual, TRUE AS agrees FROM part GROUP BY p_brand")
def declared_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return catalogs.census(_tables(spark, sf_dir))["declared"]


@query("preview_census", "SELECT p_brand AS path, count(*) FILTER (WHERE p_partkey % 8 < 2 OR (p_partkey % 8 = 2 AND p_size % 5 > 0)) + 1 AS ok, count(*) FILTER (WHERE p_partkey % 8 < 3) + 1 AS total FROM part GROUP BY p_brand")
def preview_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews that can be made, of all bitmaps and links."""
    return catalogs.previews(_tables(spark, sf_dir))


@query("metadata_fields", "SELECT p_brand AS path, 'thin' AS thinning, p_brand AS platform_version, 'macos' AS platform, 'tool' AS tool FROM part GROUP BY p_brand")
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6."""
    m = F.col("metadata")
    return _tables(spark, sf_dir)["car_info"].select("path", *[m[k].alias(n) for k, n in enumerate(("thinning", "platform_version", "platform", "tool"))])


@query("known_records", "SELECT p_partkey, p_size::BIGINT AS slice_w, 1 AS top, p_size::BIGINT AS metric_w, 1 AS mode, 0.5 AS opacity, 2 + p_partkey % 8 AS height FROM part WHERE p_partkey % 8 < 2")
def known_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, metrics and composition of bitmaps, decoded from their records."""
    found = catalogs.known_records(_tables(spark, sf_dir)["renditions"].where("kind = 'image' and name <> 'atlas'"))
    return found.select(_number("name").alias("p_partkey"), F.col("slices")[0]["w"].alias("slice_w"), F.col("metrics")["top"].cast("int").alias("top"), F.col("metrics")["w"].alias("metric_w"), F.col("blend_mode").cast("int").alias("mode"), "opacity", F.col("slices")[0]["h"].alias("height"))


@query("first_record", "SELECT p_partkey, lower(hex(p_size)) AS data FROM part WHERE p_partkey % 8 > 1")
def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: the first of several records with one tag."""
    r = _tables(spark, sf_dir)["renditions"].where("kind <> 'image'")
    return r.select(_number("name").alias("p_partkey"), F.regexp_replace(F.lower(F.hex(catalogs.record(F.col("tlvs"), 99))), "^0", "").alias("data"))


@query("colour_records", "SELECT p_partkey, (p_size % 3)::BIGINT AS space, p_partkey / 8 AS c0, p_size / 4 AS c1, CASE WHEN p_size % 2 = 1 THEN 'system' || p_size % 4 END AS system FROM part WHERE p_partkey % 8 = 4")
def colour_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    found = catalogs.colours(_tables(spark, sf_dir)["renditions"])
    return found.select(_number("name").alias("p_partkey"), "space", F.col("components")[0].alias("c0"), F.col("components")[1].alias("c1"), "system")


@query("gradient_stops", "SELECT p.p_partkey, p.p_size % 2 AS kind, u.place, CASE u.place WHEN 0 THEN 'n' || (p.p_partkey - 1) WHEN 1 THEN 'n' || (p.p_partkey + 7) ELSE 'nobody' END AS colour, CASE WHEN u.place = 2 THEN NULL WHEN u.place = 0 THEN a.p_partkey ELSE b.p_partkey END AS found FROM (SELECT * FROM part WHERE p_partkey % 8 = 5) p CROSS JOIN range(3) u(place) LEFT JOIN part a ON a.p_brand = p.p_brand AND a.p_partkey = p.p_partkey - 1 LEFT JOIN part b ON b.p_brand = p.p_brand AND b.p_partkey = p.p_partkey + 7")
def gradient_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient's stops with the colours of their names in the same file, null where there is none."""
    found = catalogs.stop_colours(_tables(spark, sf_dir))
    return found.select(_number("name").alias("p_partkey"), F.col("kind").cast("int").alias("kind"), F.col("place").cast("long").alias("place"), "colour", _number("colour_name").alias("found"))


@query("multisize_entries", "SELECT p_partkey, u.k * p_size AS width, u.k AS idx FROM part CROSS JOIN (VALUES (1), (2)) u(k) WHERE p_partkey % 8 = 6")
def multisize_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    found = catalogs.multisizes(_tables(spark, sf_dir)["renditions"])
    return found.select(_number("name").alias("p_partkey"), F.col("width").cast("int").alias("width"), F.col("idx").cast("int").alias("idx"))


@query("link_targets", "SELECT p_partkey, p_partkey % 10 AS x, (p_size % 8)::BIGINT AS y, CASE WHEN p_size % 5 > 0 THEN 24 END AS atlas_height, p_size % 5 > 0 AS found FROM part WHERE p_partkey % 8 = 2")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and their atlases."""
    t = _tables(spark, sf_dir)
    found = catalogs.resolve_links(t).join(t["renditions"].select("path", "rid", "name"), ["path", "rid"])
    return found.select(_number("name").alias("p_partkey"), "x", "y", F.col("atlas_height").cast("int").alias("atlas_height"), F.col("atlas_rid").isNotNull().alias("found"))


@query("link_pixels", "SELECT p_partkey, (p_partkey % 10) * 8 AS r, (24 - p_size % 8 - 3) * 8 AS g FROM part WHERE p_partkey % 8 = 2 AND p_size % 5 > 0")
def link_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pixel of each link's rectangle, which counts from the bottom."""
    t = _tables(spark, sf_dir)
    shown = catalogs.linked_images(t).join(t["renditions"].select("path", "rid", "name"), ["path", "rid"])
    byte = lambda k: F.conv(F.hex(F.substring("rgba", k, 1)), 16, 10).cast("long")
    return shown.select(_number("name").alias("p_partkey"), byte(1).alias("r"), byte(2).cast("int").alias("g"))


@query("data_contents", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'svg' ELSE 'pdf' END AS kind, p_size % 2 = 1 AS was_packed, CASE WHEN p_size % 2 = 1 THEN '<svg id=''' || p_partkey || '''/>' ELSE '%PDF-' || p_partkey END AS content FROM part WHERE p_partkey % 8 = 3")
def data_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data renditions unwrapped and unpacked, and what their bytes are."""
    found = catalogs.data_of(_tables(spark, sf_dir)["renditions"])
    return found.select(_number("name").alias("p_partkey"), "kind", "was_packed", F.col("bytes").cast("string").alias("content"))


@query("payload_sniff", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'jpg' END AS kind FROM part WHERE p_partkey % 8 = 7")
def payload_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the image container in an opaque payload, by its first bytes."""
    r = _tables(spark, sf_dir)["renditions"].where("kind = 'raw_payload'")
    return r.select(_number("name").alias("p_partkey"), names.sniff_container(F.col("payload")).alias("kind"))


@query("image_containers", "SELECT doc_id, substr(coalesce(text, ''), 1, 1) = '#' AS is_image FROM documents")
def image_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether bytes are an image container; texts that begin with # get a JPEG's first bytes."""
    text = F.coalesce("text", F.lit(""))
    data = F.when(text.startswith("#"), F.concat(F.lit(b"\xff\xd8\xff\xe0"), text.cast("binary"))).otherwise(text.cast("binary"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", names.is_image_container(data).alias("is_image"))


@query("bitmap_means", "SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN p_size * 2 ELSE p_size * 3 END::BIGINT AS cells, (p_partkey % 256)::BIGINT AS red FROM part WHERE p_partkey % 8 < 2")
def bitmap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour and gray bitmaps, plain, chunked and packed, decoded."""
    t = _tables(spark, sf_dir)
    shown = catalogs.bitmaps(t["renditions"]).join(t["renditions"].select("path", "rid", "name"), ["path", "rid"]).where("name <> 'atlas'")

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(x, np.uint8).reshape(-1, 4) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in every], pa.int64()), pa.array([int(x[:, 0].mean()) for x in every], pa.int64())], names=["p_partkey", "cells", "red"])

    return shown.select(_number("name").alias("p_partkey"), "rgba").mapInArrow(mean, "p_partkey long, cells long, red long")


# Operations.


@query("asset_sizes", "SELECT 'n' || p_partkey AS name, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 2 END::BIGINT AS width, CASE p_partkey % 8 WHEN 0 THEN 2 ELSE 3 END::BIGINT AS height FROM part WHERE p_partkey % 8 <> 6")
def asset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes in which a facet's renditions can be replaced; links count by their rectangle."""
    found = catalogs.replacement_sizes(_tables(spark, sf_dir))
    return found.where("name like 'n%'").select("name", "width", "height")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries: a 5 by 2 PNG, a 2 by 3 PNG and a text, for every part of size 5."""
    part = table(spark, sf_dir, "part").where("p_size = 5")
    sent = [(0, codecs.png_write(_solid(5, 2, (1, 2, 3, 255)))), (1, codecs.png_write(_solid(2, 3, (4, 5, 6, 255)))), (2, b"text")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(data).alias("bytes")) for k, data in sent]))
    rows = part.select(F.col("p_brand").alias("path"), "p_partkey", F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), each.alias("e"))
    return rows.select("path", (F.col("p_partkey") * 3 + F.col("e.k")).alias("ordinal"), "name", "e.bytes")


_OUTCOME = """CASE WHEN u.k = 2 THEN CASE WHEN m = 3 THEN 'replaced' ELSE 'not data' END
    WHEN m = 0 THEN CASE WHEN u.k = 0 THEN 'replaced' ELSE 'size mismatch' END
    WHEN m = 1 THEN 'size mismatch' WHEN m = 2 THEN 'shared atlas' ELSE 'not a bitmap' END"""


@query("merge_outcomes", f"WITH e AS (SELECT p_brand AS path, p_partkey * 3 + u.k AS ordinal, 'n' || p_partkey AS name, {_OUTCOME} AS outcome FROM (SELECT *, p_partkey % 8 AS m FROM part WHERE p_size = 5) CROSS JOIN range(3) u(k)) SELECT path, ordinal, name, outcome, 1 AS n FROM e UNION ALL SELECT NULL, ordinal, name, 'unmatched', 0 FROM e WHERE outcome <> 'replaced'")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry did to the rendition of its name, and those that landed nowhere."""
    _, report = catalogs.merge(_tables(spark, sf_dir), _offers(spark, sf_dir))
    return report


@query("merge_links", "SELECT p_brand AS path, count(*) FILTER (WHERE p_size % 5 > 0) AS n FROM part WHERE p_partkey % 8 = 2 GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size % 5 > 0) > 0")
def merge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNGs for linked names are painted into the atlas; how many of a file's links show them."""
    t = _tables(spark, sf_dir)
    linked = table(spark, sf_dir, "part").where("p_partkey % 8 = 2")
    patch = codecs.png_write(_solid(2, 3, (250, 251, 252, 255)))
    offers = linked.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.lit(patch).alias("bytes"))
    done, _ = catalogs.merge(t, offers)
    shown = catalogs.linked_images(done).where(F.col("rgba") == F.lit(_solid(2, 3, (250, 251, 252, 255)).tobytes()))
    return shown.groupBy("path").agg(F.count("*").alias("n"))


@query("merge_data", "SELECT p_partkey, p_size % 2 = 1 AS was_packed, CASE WHEN p_size = 5 THEN 'text' WHEN p_size % 2 = 1 THEN '<svg id=''' || p_partkey || '''/>' ELSE '%PDF-' || p_partkey END AS content FROM part WHERE p_partkey % 8 = 3")
def merge_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced data keeps its compression."""
    done, _ = catalogs.merge(_tables(spark, sf_dir), _offers(spark, sf_dir))
    found = catalogs.data_of(done["renditions"])
    return found.select(_number("name").alias("p_partkey"), "was_packed", F.col("bytes").cast("string").alias("content"))


@query("merge_added", "SELECT p_brand AS path, 'new' AS name, 'svg' AS kind, 'p' || max(p_partkey) AS ending, 0 AS top FROM part GROUP BY p_brand")
def merge_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of a new name is added, later entries of the name replace it."""
    t = relations(spark, sf_dir)
    # Without the atlas, identifiers are left.
    t["renditions"] = t["renditions"].where("name <> 'atlas'")
    t = catalog.parse_tables(catalog.build_catalogs(t))
    part = table(spark, sf_dir, "part")
    offers = part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"), F.lit("new").alias("name"), F.concat(F.lit("<svg/>p"), F.col("p_partkey").cast("string")).cast("binary").alias("bytes"))
    done, report = catalogs.merge(t, offers, add_missing=True)
    data = catalogs.data_of(done["renditions"]).where("name = 'new.svg'")
    facet = done["facets"].where("name = 'new'").select("path", F.col("attributes")["identifier"].alias("identifier"))
    top = t["facets"].groupBy("path").agg(F.max(F.col("attributes")["identifier"]).alias("most"))
    found = data.join(facet, "path").join(top, "path")
    return found.select("path", F.lit("new").alias("name"), "kind", F.regexp_extract(F.col("bytes").cast("string"), "(p[0-9]+)$", 1).alias("ending"), (F.col("identifier") - F.col("most") - 1).alias("top"))


@query("clone_of_first", "WITH f AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand) SELECT 'copy' AS name, 'p' || k AS own FROM f WHERE p_brand = (SELECT min(p_brand) FROM part)")
def clone_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part's asset cloned within its file, under a free identifier."""
    t = _tables(spark, sf_dir)
    path = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("b")).first()["b"]
    first = table(spark, sf_dir, "part").where(F.col("p_brand") == path).agg(F.min("p_partkey").alias("k")).first()["k"]
    done = catalogs.clone_asset(t, path, f"n{first}", "copy")
    made = catalogs.named_renditions(done).where("name = 'copy'").join(done["renditions"].select("path", "rid", F.col("name").alias("own")), ["path", "rid"])
    return made.select("name", "own")


@query("pack_images", "WITH f AS (SELECT p_size % 20 AS a, p_partkey % 3 + 1 AS scale, min(p_partkey) AS k FROM part WHERE p_partkey < 200 GROUP BY ALL), d AS (SELECT a, dense_rank() OVER (ORDER BY 'icon' || lpad(a::VARCHAR, 2, '0')) AS id FROM (SELECT DISTINCT a FROM f)) SELECT 'icon' || lpad(a::VARCHAR, 2, '0') AS asset, scale, id, k % 256 AS red FROM f JOIN d USING (a)")
def pack_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from PNG files; of files with the same asset and scale the first by name stays."""
    part = table(spark, sf_dir, "part").where("p_partkey < 200")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codecs.png_write(_solid(2, 2, (k % 256, 0, 1, 255))) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["file", "bytes"])

    scale = F.col("p_partkey") % 3 + 1
    stem = F.concat(F.lit("icon"), F.lpad((F.col("p_size") % 20).cast("string"), 2, "0"))
    file = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/"), stem, F.when(scale == 1, "").otherwise(F.concat(F.lit("@"), scale.cast("string"), F.lit("x"))), F.lit(".png"))
    packed = catalogs.pack(part.select(file.alias("file"), "p_partkey").mapInArrow(draw, "file string, bytes binary"))
    t = catalog.parse_tables(catalog.build_catalogs(packed))
    red = F.conv(F.hex(F.substring("rgba", 1, 1)), 16, 10).cast("long")
    shown = catalogs.bitmaps(t["renditions"]).select("path", "rid", red.alias("red"))
    r = t["renditions"].select("path", "rid", F.col("key")["identifier"].cast("long").alias("id"), F.col("key")["scale"].cast("long").alias("scale"))
    facet = t["facets"].select("path", F.col("name").alias("asset"), F.col("attributes")["identifier"].cast("long").alias("id"))
    return r.join(shown, ["path", "rid"]).join(facet, ["path", "id"]).select("asset", "scale", "id", "red")


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """A folder with working folders of all brands."""
    folder = new_folder(spark, "working")
    workdir.write(_tables(spark, sf_dir), folder)
    return folder


@query("working_files", "SELECT p_brand AS path, role, ext, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_partkey % 8 < 2 THEN 'renditions' WHEN p_partkey % 8 = 2 THEN 'renditions' WHEN p_partkey % 8 = 3 THEN 'data' ELSE 'rawpayload' END AS role, CASE WHEN p_partkey % 8 < 3 THEN 'png' WHEN p_partkey % 8 = 3 THEN CASE WHEN p_size % 2 = 1 THEN 'svg' ELSE 'pdf' END WHEN p_partkey % 8 = 7 AND p_size % 2 = 1 THEN 'jpg' ELSE 'bin' END AS ext FROM part WHERE p_partkey % 8 <> 2 OR p_size % 5 > 0 UNION ALL SELECT DISTINCT p_brand, 'renditions', 'png' FROM part) GROUP BY ALL")
def working_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7-K9: the files of written working folders, by folder and sniffed extension."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_saved(spark, sf_dir)).select("path")
    part = lambda k: F.regexp_extract("path", r"/([^/]*)/([^/]*)/[^/]*\.([a-z]*)$", k)
    return found.where("path not like '%/manifest.json'").groupBy(part(1).alias("path"), part(2).alias("role"), part(3).alias("ext")).agg(F.count("*").alias("n"))


@query("working_edits", f"SELECT p_brand AS path, {_KIND} AS kind, CASE WHEN p_partkey % 8 = 0 AND p_size = 5 THEN 200 WHEN p_partkey % 8 = 0 THEN p_partkey % 256 END AS red, count(*) AS n FROM part WHERE p_partkey % 8 <> 1 GROUP BY ALL")
def working_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNGs of size 5 are painted over in the working folders, which are then read back."""
    folder = _saved(spark, sf_dir)
    found = workdir.listed(spark, folder).where("file like '%.png'")
    stem = F.regexp_extract("file", r"-p([0-9]+)\.png$", 1).try_cast("long")
    five = table(spark, sf_dir, "part").where("p_size = 5 and p_partkey % 8 = 0").select("p_partkey")
    mine = found.select("file", stem.alias("p_partkey")).join(five, "p_partkey")
    edit = codecs.png_write(_solid(5, 2, (200, 0, 0, 255)))
    write_files(mine.select("file", F.lit(edit).alias("bytes")), folder)
    t = workdir.read(spark, folder)
    red = F.conv(F.hex(F.substring("rgba", 1, 1)), 16, 10).cast("int")
    shown = catalogs.bitmaps(t["renditions"]).select("path", "rid", red.alias("red"))
    r = t["renditions"].where("name <> 'atlas' and pixel_format <> 'GA8'").select(F.regexp_extract("path", "([^/]*)$", 1).alias("brand"), "path", "rid", "kind")
    return r.join(shown, ["path", "rid"], "left").groupBy(F.col("brand").alias("path"), "kind", "red").agg(F.count("*").alias("n"))


@query("scanned_folder", "SELECT CASE WHEN p_size % 3 = 0 THEN 'set' || p_size END AS asset, CASE WHEN p_size % 3 = 0 THEN 2 END AS scale, CASE WHEN p_size % 3 = 0 THEN 'phone' END AS idiom, count(*) AS n FROM (SELECT DISTINCT p_size FROM part) GROUP BY ALL UNION ALL SELECT 'missing', NULL, NULL, count(*) FROM (SELECT DISTINCT p_size FROM part WHERE p_size % 3 = 0)")
def scanned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose PNG files, and bundles with slots of which one has no file."""
    folder = new_folder(spark, "images")
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    png, s = F.lit(codecs.png_write(_solid(1, 1, (0, 0, 0, 255)))), F.col("p_size").cast("string")
    slots = '{"images": [{"filename": "a.png", "scale": "2x", "idiom": "phone"}, {"idiom": "pad"}, {"filename": "gone.png", "scale": "1x"}]}'
    base = F.concat(F.lit("set"), s, F.lit(".imageset/"))
    bundled = sizes.where("p_size % 3 = 0")
    files = sizes.where("p_size % 3 <> 0").select(F.concat(F.lit("loose/i"), s, F.lit(".png")).alias("file"), png.alias("bytes"))
    files = files.unionAll(bundled.select(F.concat(base, F.lit("a.png")), png)).unionAll(bundled.select(F.concat(base, F.lit("Contents.json")), F.lit(slots.encode())))
    write_files(files, folder)
    rows, missing = images.scan_images(spark, folder)
    lost = missing.agg(F.lit("missing").alias("asset"), F.lit(None).cast("int").alias("scale"), F.lit(None).cast("string").alias("idiom"), F.count("*").alias("n"))
    return rows.groupBy("asset", "scale", "idiom").agg(F.count("*").alias("n")).unionAll(lost)


# Codecs.


def _painted(spark: SparkSession, sf_dir: str, work, noisy: str = "true") -> DataFrame:
    """(p_partkey, ok, n) of a function of key and size, for every part (of the noisy images, for a few)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(k, s) for k, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64())], names=["p_partkey", "ok", "n"])

    # A row is a few bytes and milliseconds of work, so rows are dealt to all cores however few files or blocks they come from.
    dealt = table(spark, sf_dir, "part", "p_partkey", "p_size").where(noisy).repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    return dealt.mapInArrow(run, "p_partkey long, ok boolean, n long")


def _ramp(k: int, s: int, colours: int) -> np.ndarray:
    """An image of s by 4 cells with up to so many colours."""
    cell = np.arange(4 * s).reshape(4, s) * (k % 7 + 1) % colours
    return np.stack([cell * 3 % 256, cell * 5 % 256, cell * 7 % 256, np.full_like(cell, 255)], axis=2).astype(np.uint8)


@query("palette_codec", "SELECT p_partkey, TRUE AS ok, 4 * p_size AS n FROM part")
def palette_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette bitmaps survive exactly, in LZFSE streams."""

    def work(k: int, s: int) -> tuple[bool, int]:
        image = _ramp(k, s, 100)
        payload = codecs.palette_encode(image)
        back = codecs.bitmap_decode(payload, s, 4, codecs.row_stride(s, "ARGB"), "ARGB")
        return bool((back == image).all()) and b"bvx" in payload, back.size // 4

    return _painted(spark, sf_dir, work)


@query("default_codec", "SELECT p_partkey, TRUE AS ok, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS n FROM part")
def default_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default bitmaps survive exactly in gray and within one level in colour."""

    def work(k: int, s: int) -> tuple[bool, int]:
        gray = k % 2 == 0
        image = _ramp(k, s, 256)
        if gray:
            image = image[..., [0, 0, 0, 3]]
        pixel = "GA8" if gray else "ARGB"
        back = codecs.bitmap_decode(codecs.default_encode(image, pixel), s, 4, codecs.row_stride(s, pixel), pixel)
        return int(np.abs(back.astype(int) - image).max()) <= (0 if gray else 1), 0 if gray else 1

    return _painted(spark, sf_dir, work)


@query("edited_codec", "SELECT p_partkey, TRUE AS ok, CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN 11 WHEN 2 THEN 1 ELSE 4 END AS n FROM part")
def edited_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which codec an edit gets: planar for planar (gray and colour), run-length for gray, else LZFSE."""

    def work(k: int, s: int) -> tuple[bool, int]:
        stored, pixel = (("deepmap2", "ARGB"), ("deepmap2", "GA8"), ("rle", "GA8"), ("jpeg-lzfse", "ARGB"))[k % 4]
        image = _ramp(k, s, 100)
        image = image if pixel == "ARGB" else image[..., [0, 0, 0, 3]]
        name, payload = codecs.reencode(image, stored, codecs.row_stride(s, pixel), pixel)
        back = codecs.bitmap_decode(payload, s, 4, codecs.row_stride(s, pixel), pixel)
        return bool((back == image).all()), records.compression_code(name)

    return _painted(spark, sf_dir, work)


@query("quantized_codec", "SELECT p_partkey, TRUE AS ok, 256 AS n FROM part WHERE p_brand = 'Brand#11' AND p_size <= 10")
def quantized_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than 256 colours are cut to 256, none far off, and encoding again changes nothing."""

    def work(k: int, s: int) -> tuple[bool, int]:
        image = np.random.default_rng(k).integers(0, 256, (32, 32, 4), dtype=np.uint8)
        image[..., 3] = 255
        payload = codecs.palette_encode(image, quantized=True)
        back = codecs.bitmap_decode(payload, 32, 32, codecs.row_stride(32, "ARGB"), "ARGB")
        again = codecs.bitmap_decode(codecs.palette_encode(back, quantized=True), 32, 32, codecs.row_stride(32, "ARGB"), "ARGB")
        near = float(np.abs(back.astype(int) - image).mean()) < 12
        few = len(np.unique(back.reshape(-1, 4), axis=0)) <= 256
        return near and few and bool((again == back).all()), 256

    return _painted(spark, sf_dir, work, "p_brand = 'Brand#11' and p_size <= 10")


@query("wide_codec", "SELECT p_partkey, TRUE AS ok, 3 * p_size AS n FROM part")
def wide_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-float rows, packed in LZFSE, are within one level; 16-bit gray keeps its high bytes."""

    def work(k: int, s: int) -> tuple[bool, int]:
        image = _ramp(k, s, 256)[:3]
        stride = codecs.row_stride(s, "RGBW")
        back = codecs.bitmap_decode(codecs.bitmap_encode(image, "lzfse", stride, "RGBW"), s, 3, stride, "RGBW")
        wide = (np.arange(s) * 257 % 65536).astype("<u2")
        row = np.stack([wide, np.full(s, 65535, "<u2")], axis=1).tobytes().ljust(codecs.row_stride(s, "GA16"), b"\0")
        gray = codecs.rows_to_rgba(row, s, 1, codecs.row_stride(s, "GA16"), "GA16")
        return int(np.abs(back.astype(int) - image).max()) <= 1 and bool((gray[0, :, 0] == wide >> 8).all()), back.size // 4

    return _painted(spark, sf_dir, work)


@query("png_codec", "SELECT p_partkey, TRUE AS ok, 4 * p_size AS n FROM part")
def png_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files written and read again."""

    def work(k: int, s: int) -> tuple[bool, int]:
        image = _ramp(k, s, 200)
        back = codecs.png_read(codecs.png_write(image))
        return bool((back == image).all()), back.size // 4

    return _painted(spark, sf_dir, work)
