"""Operations on catalogs held as relations: census, bitmaps, links, merge, clone, pack.

All take and return the relations of kilnwork.sources.catalog.  Decoding and
encoding are Arrow functions over the rows that need them; everything else is
joins and aggregates, so many catalogs are handled at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kilnwork.functions import names
from kilnwork.functions.workspace import stored
from kilnwork.sources import codecs, records
from kilnwork.sources.catalog import SCHEMAS

Tables = dict[str, DataFrame]

#: The order of a new catalog's key attributes, and the idioms by number (fixed values).
KEY_FORMAT = ("appearance", "localization", "scale", "idiom", "subtype", "dimension2", "dimension1", "sizeClassHorizontal", "sizeClassVertical", "identifier", "element", "part")
IDIOMS = {"universal": 0, "phone": 1, "iphone": 1, "pad": 2, "ipad": 2}
ELEMENT, PART = 85, 181
#: The versions in a new catalog's header, and the name of its one appearance (fixed values).
HEADER_NUMBERS, APPEARANCE = (974, 17), "UIAppearanceAny"


def census(tables: Tables) -> dict[str, DataFrame]:
    """Counts by layout, by compression of bitmaps, by kind, by label, and declared against actual renditions.

    A label is a bitmap's compression with whether it is chunked, or any other
    rendition's kind.
    """
    r = tables["renditions"]
    # The lowest bit of a bitmap's flags, its fifth byte.
    chunked = F.conv(F.hex(F.substring("payload", 5, 1)), 16, 10).cast("int").bitwiseAND(1) == 1
    label = F.when(F.col("compression").isNotNull(), F.concat(F.col("compression"), F.when(chunked, "-chunked").otherwise(""))).otherwise(F.col("kind"))
    actual = r.groupBy("path").agg(F.count("*").alias("actual"))
    declared = tables["car_info"].select("path", F.col("rendition_count").alias("declared")).join(actual, "path", "left")
    return {
        "layout": r.groupBy("path", "layout").agg(F.count("*").alias("n")),
        "compression": r.where("compression is not null").groupBy("path", "compression").agg(F.count("*").alias("n")),
        "kind": r.groupBy("path", "kind").agg(F.count("*").alias("n")),
        "label": r.groupBy("path", label.alias("label")).agg(F.count("*").alias("n")),
        "declared": declared.select("path", "declared", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"), (F.col("declared") == F.coalesce("actual", F.lit(0))).alias("agrees")),
    }


def info(tables: Tables) -> DataFrame:
    """Catalog headers with their censuses as maps."""
    out = tables["car_info"]
    for name, counts in census(tables).items():
        if name != "declared":
            out = out.join(counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col(name).cast("string"), "n"))).alias(f"by_{name}")), "path", "left")
    return out


def previews(tables: Tables) -> DataFrame:
    """(path, ok, total): how many of a file's bitmaps and links can be shown."""
    shown = bitmaps(tables["renditions"]).select("path").unionAll(linked_images(tables).select("path")).groupBy("path").agg(F.count("*").alias("ok"))
    total = tables["renditions"].where("compression is not null or kind = 'link'").groupBy("path").agg(F.count("*").alias("total"))
    return total.join(shown, "path", "left").select("path", F.coalesce("ok", F.lit(0).cast("long")).alias("ok"), "total")


def bitmaps(renditions: DataFrame) -> DataFrame:
    """(path, rid, width, height, rgba) of the bitmaps that decode; others are left out.

    rgba: straight bytes, row by row from the top.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, rid, width, height, pixel, tlvs, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = records.Rendition(width=width, height=height, pixel_format=records.pixel_format_code(pixel) or 0, tlvs=[(t["tag"], t["data"]) for t in tlvs or []])
                image = codecs.bitmap_decode(payload, width, height, r.stride(), pixel) if r.stride_consistent() else None
                if image is not None:
                    rows.append((path, rid, width, height, image.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "rid", "width", "height", "rgba"])

    images = renditions.where("kind = 'image'").select("path", "rid", "width", "height", "pixel_format", "tlvs", "payload")
    return images.mapInArrow(work, "path string, rid int, width bigint, height bigint, rgba binary")


def links(renditions: DataFrame) -> DataFrame:
    """(path, rid, x, y, width, height, content_layout, target) of link records; target is the sparse key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, rid, tlvs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = next((t["data"] for t in tlvs or [] if t["tag"] == records.LINK_TAG), None)
                link = records.Link.parse(raw) if raw is not None else None
                if link is not None:
                    rows.append((path, rid, link.x, link.y, link.width, link.height, link.layout, list(link.key.items())))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["path", "rid", "x", "y", "width", "height", "content_layout", "target"])

    found = renditions.where("kind = 'link'").select("path", "rid", "tlvs")
    return found.mapInArrow(work, "path string, rid int, x bigint, y bigint, width bigint, height bigint, content_layout int, target map<string,int>")


def record(tlvs: Column, tag: int) -> Column:
    """The data of the first record with a tag, null without one."""
    return F.get(F.filter(tlvs, lambda t: t["tag"] == tag), 0)["data"]


def _parsed(renditions: DataFrame, kind: str, columns: list[str], schema: str, work) -> DataFrame:
    """(path, rid, name, ...): rows that a function of name, records and payload gives for renditions of a kind."""
    names_of = [x.split()[0] for x in schema.split(", ")]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, rid, name, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(path, rid, name, *row) for row in work(*rest)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(arrow)], names=names_of)

    return renditions.where(kind).select("path", "rid", "name", *columns).mapInArrow(run, schema)


def known_records(renditions: DataFrame) -> DataFrame:
    """(path, rid, name, slices, metrics, blend_mode, opacity): the records with a known meaning, null where absent."""

    def work(slices: bytes | None, metrics: bytes | None, composition: bytes | None) -> list[tuple]:
        rects = records.slices_of(slices) if slices else None
        insets = records.metrics_of(metrics) if metrics else None
        mode, opacity = (records.composition_of(composition) if composition else None) or (None, None)
        cut = None if rects is None else [dict(zip("xywh", r, strict=True)) for r in rects]
        box = None if insets is None else dict(zip(("top", "left", "bottom", "right", "w", "h"), insets, strict=True))
        return [(cut, box, mode, opacity)]

    tagged = renditions.select("path", "rid", "name", *[record(F.col("tlvs"), t).alias(n) for n, t in (("slices", records.SLICES), ("metrics", records.METRICS), ("composition", records.COMPOSITION))])
    schema = "path string, rid int, name string, slices array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>, metrics struct<top:bigint,left:bigint,bottom:bigint,right:bigint,w:bigint,h:bigint>, blend_mode bigint, opacity double"
    return _parsed(tagged, "true", ["slices", "metrics", "composition"], schema, work)


def colours(renditions: DataFrame) -> DataFrame:
    """(path, rid, name, space, components, system) of colour renditions."""

    def work(payload: bytes) -> list[tuple]:
        c = records.Colour.parse(payload)
        return [] if c is None else [(c.space, c.components, c.system)]

    return _parsed(renditions, "kind = 'color'", ["payload"], "path string, rid int, name string, space bigint, components array<double>, system string", work)


def gradients(renditions: DataFrame) -> DataFrame:
    """(path, rid, name, kind, place, location, colour): the stops of gradient renditions."""

    def work(payload: bytes) -> list[tuple]:
        g = records.Gradient.parse(payload)
        return [] if g is None else [(g.kind, k, location, colour) for k, (location, colour) in enumerate(g.stops)]

    return _parsed(renditions, "kind = 'gradient'", ["payload"], "path string, rid int, name string, kind bigint, place int, location double, colour string", work)


def stop_colours(tables: Tables) -> DataFrame:
    """Gradient stops with the colour renditions that their names resolve to; nulls where there is none."""
    named = named_renditions(tables).withColumnRenamed("name", "colour").join(colours(tables["renditions"]).select("path", "rid", F.col("name").alias("colour_name"), "components"), ["path", "rid"])
    return gradients(tables["renditions"]).join(named.select("path", "colour", "colour_name", "components"), ["path", "colour"], "left")


def multisizes(renditions: DataFrame) -> DataFrame:
    """(path, rid, name, width, height, idx): the entries of multisize renditions."""
    return _parsed(renditions, "kind = 'multisize'", ["payload"], "path string, rid int, name string, width bigint, height bigint, idx bigint", lambda payload: records.multisize_of(payload) or [])


def data_of(renditions: DataFrame) -> DataFrame:
    """(path, rid, name, bytes, kind, was_packed): contents of data renditions out of envelope and compression."""

    def work(payload: bytes) -> list[tuple]:
        found = codecs.raw_decode(payload)
        return [] if found is None else [(found[0], records.sniff(found[0]), bool(payload[4] & 1))]

    return _parsed(renditions, "kind = 'data'", ["payload"], "path string, rid int, name string, bytes binary, kind string, was_packed boolean", work)


def _sorted_key(key: Column) -> Column:
    """A sparse key as an array that can be joined on; zeros are absent."""
    return F.array_sort(F.filter(F.map_entries(key), lambda e: e["value"] != 0))


def resolve_links(tables: Tables) -> DataFrame:
    """Links with their atlas's rid and height; both null where the target is missing.

    ``linked``, where given, holds the renditions whose links are wanted.
    """
    r = tables["renditions"]
    atlas = r.select("path", _sorted_key(F.col("key")).alias("full"), F.col("rid").alias("atlas_rid"), F.col("height").alias("atlas_height"))
    return links(tables.get("linked", r)).withColumn("full", _sorted_key(F.col("target"))).join(atlas, ["path", "full"], "left").drop("full")


def linked_images(tables: Tables) -> DataFrame:
    """(path, rid, width, height, rgba): each link's rectangle of its atlas; y counts from the bottom.

    Atlases are decoded once each, before the join.
    """
    found = resolve_links(tables).where("atlas_rid is not null")
    wanted = found.select("path", F.col("atlas_rid").alias("rid")).distinct()
    pixels = bitmaps(tables["renditions"].join(wanted, ["path", "rid"], "left_semi")).select("path", F.col("rid").alias("atlas_rid"), F.col("width").alias("atlas_width"), "rgba")
    joined = found.join(pixels, ["path", "atlas_rid"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, rid, x, y, w, h, width, height, rgba in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x + w <= width and y + h <= height:
                    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
                    top = height - y - h
                    rows.append((path, rid, w, h, image[top : top + h, x : x + w].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "rid", "width", "height", "rgba"])

    return joined.select("path", "rid", "x", "y", "width", "height", "atlas_width", "atlas_height", "rgba").mapInArrow(work, "path string, rid int, width bigint, height bigint, rgba binary")


def paste_links(tables: Tables, edits: DataFrame) -> DataFrame:
    """renditions with edited link rectangles (path, rid, rgba) painted into their atlases.

    Edits of one atlas are applied in order of rid, so later ones win; one whose
    target is missing or whose size differs is an error.
    """
    found = resolve_links(tables).join(edits.select("path", "rid", F.col("rgba").alias("patch")), ["path", "rid"])
    checked = found.withColumn("atlas_rid", F.when(F.col("atlas_rid").isNull(), F.raise_error(F.lit("an edited link has no target")).cast("int")).when(F.octet_length("patch") != F.col("width") * F.col("height") * 4, F.raise_error(F.lit("an edited link changed its size")).cast("int")).otherwise(F.col("atlas_rid")))
    patches = checked.groupBy("path", F.col("atlas_rid").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("rid", "x", "y", "width", "height", "patch"))).alias("patches"))
    images = bitmaps(tables["renditions"].join(patches.select("path", "rid"), ["path", "rid"], "left_semi"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, height, rgba, patches in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).copy()
                for p in patches:
                    top = height - p["y"] - p["height"]
                    image[top : top + p["height"], p["x"] : p["x"] + p["width"]] = np.frombuffer(p["patch"], np.uint8).reshape(p["height"], p["width"], 4)
                out.append(image.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["path", "rid", "rgba"])

    painted = images.join(patches, ["path", "rid"]).select("path", "rid", "width", "height", "rgba", "patches").mapInArrow(work, "path string, rid int, rgba binary")
    return install(tables["renditions"], painted)


def install(renditions: DataFrame, edits: DataFrame) -> DataFrame:
    """renditions with the bitmaps in edits (path, rid, rgba) encoded anew; others keep their bytes.

    An edit that equals what is stored changes nothing.  A gray bitmap that gets
    chroma becomes a colour bitmap and loses its stride record.
    """
    columns = renditions.columns
    joined = renditions.join(edits.select("path", "rid", F.col("rgba").alias("edit")), ["path", "rid"], "left").select(*columns, "edit")
    same = joined.where("edit is null").select(*columns)
    schema = renditions.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                width, height, pixel = table["width"][k], table["height"][k], table["pixel_format"][k]
                image = np.frombuffer(table["edit"][k], np.uint8).reshape(height, width, 4)
                tlvs = table["tlvs"][k] or []
                r = records.Rendition(width=width, height=height, pixel_format=records.pixel_format_code(pixel) or 0, tlvs=[(t["tag"], t["data"]) for t in tlvs])
                if hashlib.sha256(image.tobytes()).digest() == _stored_hash(table["payload"][k], r, pixel):
                    continue
                if pixel == "GA8" and codecs.infer_pixel_format(image) == "ARGB":
                    pixel = "ARGB"
                    tlvs = [t if t["tag"] != records.ROW_STRIDE else t | {"data": codecs.row_stride(width, "ARGB").to_bytes(4, "little")} for t in tlvs]
                found = codecs.reencode(image, table["compression"][k], codecs.row_stride(width, pixel), pixel)
                if found is None:
                    raise ValueError(f"no codec for an edit of {table['name'][k]}")
                table["pixel_format"][k], table["tlvs"][k] = pixel, tlvs
                table["compression"][k], table["payload"][k] = found
            arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in table[n]], batch.schema.field(n).type) for n in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return same.unionAll(joined.where("edit is not null").mapInArrow(work, schema))


def _stored_hash(payload: bytes, r: records.Rendition, pixel: str) -> bytes:
    image = codecs.bitmap_decode(payload, r.width, r.height, r.stride(), pixel)
    return b"" if image is None else hashlib.sha256(image.tobytes()).digest()


def named_renditions(tables: Tables) -> DataFrame:
    """(path, name, rid) of every facet: renditions with its identifier, or those with its name if there are none.

    The fallback takes a rendition's own name, without .png, .svg or .pdf.
    """
    facets = tables["facets"].where("attributes is not null").select("path", "name", F.try_element_at("attributes", F.lit("identifier")).alias("identifier"))
    r = tables["renditions"].select("path", "rid", F.try_element_at("key", F.lit("identifier")).alias("identifier"), F.regexp_replace("name", r"\.(png|svg|pdf)$", "").alias("own"))
    primary = facets.join(r, ["path", "identifier"]).select("path", "name", "rid")
    own = r.select("path", F.col("own").alias("name"), "rid")
    rest = own.join(primary.select("path", "name").distinct(), ["path", "name"], "left_anti")
    return primary.unionAll(rest)


def replacement_sizes(tables: Tables) -> DataFrame:
    """(path, name, width, height, first): distinct sizes of each name; links count by their rectangle."""
    r = tables["renditions"].where("kind <> 'multisize'").select("path", "rid", "width", "height")
    rect = links(tables["renditions"]).select("path", "rid", F.col("width").alias("w"), F.col("height").alias("h"))
    sized = r.join(rect, ["path", "rid"], "left").select("path", "rid", F.coalesce("w", "width").alias("width"), F.coalesce("h", "height").alias("height"))
    return named_renditions(tables).join(sized, ["path", "rid"]).where("width > 0 and height > 0").groupBy("path", "name", "width", "height").agg(F.min("rid").alias("first"))


#: What a replacement does to a rendition of its name.
INSTALLED, SIZE_MISMATCH, SHARED_ATLAS, NOT_EDITABLE, NOT_A_BITMAP, NOT_DATA = "replaced", "size mismatch", "shared atlas", "not editable", "not a bitmap", "not data"
_PNG = b"\x89PNG\r\n\x1a\n"


def _measured(replacements: DataFrame) -> DataFrame:
    """Replacements with pixels instead of PNG bytes, their sizes, and what other bytes are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(3).to_pylist():
                image = codecs.png_read(data)
                if image is None and data[:8] == _PNG:
                    raise ValueError("a replacement is no readable PNG")
                shape = (None, None) if image is None else (image.shape[1], image.shape[0])
                rows.append((data if image is None else image.tobytes(), *shape, records.sniff(data)))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["path", "ordinal", "name", "bytes", "w", "h", "sniffed"])

    path = F.col("path") if "path" in replacements.columns else F.lit(None)
    rows = replacements.select(path.cast("string").alias("path"), F.col("ordinal").cast("long").alias("ordinal"), "name", "bytes")
    return stored(rows.mapInArrow(work, "path string, ordinal long, name string, bytes binary, w long, h long, sniffed string"), "replacements")


def merge(tables: Tables, replacements: DataFrame, add_missing: bool = False) -> tuple[Tables, DataFrame]:
    """Replaces contents by name; returns the relations and the report.

    replacements: (ordinal, name, bytes), and path for entries that mean one file
    only.  PNG bytes go to bitmaps of their exact size, and through links into the
    atlas at the link's rectangle; other bytes go to data renditions, whose
    compression is kept.  Later entries overwrite earlier ones.

    Report rows: (path, ordinal, name, outcome, n): how often an entry was
    "replaced", or why a rendition of its name did not take it: "size mismatch",
    "shared atlas" (a link without a readable atlas), "not editable" (a bitmap that
    can't be decoded), "not a bitmap", "not data"; "added"; and "unmatched", with a
    null path, for entries that landed in no file.

    With add_missing, SVG and PDF under new names become vector renditions with
    identifiers after the largest; they go to the entry's path, or to the one file
    that there is.  Later entries of such a name replace what the first one added.
    """
    # Files may number their entries alike, so the file that an entry is meant for tells it too.
    offered = _measured(replacements).withColumn("entry", F.struct("ordinal", F.col("path").alias("only")))
    judged = stored(_judged(tables, offered), "judged")
    told = judged.groupBy("path", "ordinal", "name", "entry", "outcome").agg(F.count("*").alias("n"))
    last = judged.where(F.col("outcome") == INSTALLED).groupBy("path", "rid", "kind").agg(F.max("entry").alias("entry"))
    done = _applied(tables, stored(last.join(offered.select("entry", "bytes"), "entry"), "landed"))
    out, report = dict(tables) | {"renditions": done}, told
    if add_missing:
        out, gained = _added(out, offered, told)
        report = report.unionByName(gained)
    took = report.where(F.col("outcome").isin(INSTALLED, "added")).select("entry").distinct()
    lost = offered.join(took, "entry", "left_anti").select(F.lit(None).cast("string").alias("path"), "ordinal", "name", F.lit("unmatched").alias("outcome"), F.lit(0).cast("long").alias("n"))
    return out, report.drop("entry").unionByName(lost)


def merge_or_fail(tables: Tables, replacements: DataFrame, add_missing: bool = False) -> Tables:
    """As merge, but an error if there were replacements and none of them replaced anything."""
    out, report = merge(tables, replacements, add_missing)
    counts = report.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == INSTALLED).alias("landed")).first()
    if counts["n"] and not counts["landed"]:
        names = [r["name"] for r in report.where("outcome = 'unmatched'").select("name").distinct().orderBy("name").limit(20).collect()]
        raise ValueError(f"none of the replacements matched a rendition: {', '.join(names)}")
    return out


def _judged(tables: Tables, offered: DataFrame) -> DataFrame:
    """(path, rid, name, ordinal, entry, kind, outcome): what each entry does to each rendition of its name."""
    r = tables["renditions"]
    named = named_renditions(tables).join(offered.withColumnRenamed("path", "only"), "name").where("only is null or only = path").drop("only")
    tried = stored(named.select("path", "rid", "name", "ordinal", "entry", "w", "h"), "tried")
    wanted = tried.select("path", "rid").distinct()
    mine = r.join(wanted, ["path", "rid"], "left_semi")
    found = resolve_links(dict(tables) | {"renditions": r, "linked": mine})
    rects = found.select("path", "rid", F.col("width").alias("rect_w"), F.col("height").alias("rect_h"), "atlas_rid")
    # Bitmaps that decode: those named, and the atlases of named links.
    needed = wanted.unionAll(found.where("atlas_rid is not null").select("path", F.col("atlas_rid").alias("rid"))).distinct()
    readable = bitmaps(r.join(needed, ["path", "rid"], "left_semi")).select("path", "rid").withColumn("readable", F.lit(True))
    atlases = readable.select("path", F.col("rid").alias("atlas_rid"), F.col("readable").alias("atlas_readable"))
    state = mine.select("path", "rid", "kind", "width", "height", "compression").join(rects, ["path", "rid"], "left").join(readable, ["path", "rid"], "left").join(atlases, ["path", "atlas_rid"], "left")
    is_png, fits = F.col("w").isNotNull(), lambda w, h: (F.col("w") == F.col(w)) & (F.col("h") == F.col(h))
    bitmap = F.when(F.col("readable").isNull(), NOT_EDITABLE).when(fits("width", "height"), INSTALLED).otherwise(SIZE_MISMATCH)
    link = F.when(F.col("atlas_readable").isNull(), SHARED_ATLAS).when(fits("rect_w", "rect_h"), INSTALLED).otherwise(SIZE_MISMATCH)
    png = F.when(F.col("compression").isNotNull(), bitmap).when(F.col("kind") == "link", link).otherwise(NOT_A_BITMAP)
    outcome = F.when(is_png, png).when(F.col("kind") == "data", INSTALLED).otherwise(NOT_DATA)
    return tried.join(state, ["path", "rid"]).select("path", "rid", "name", "ordinal", "entry", "kind", outcome.alias("outcome"))


def _applied(tables: Tables, last: DataFrame) -> DataFrame:
    """renditions with the new contents (path, rid, kind, bytes): bitmaps first, then links into their atlases, then data."""
    done, kinds = tables["renditions"], {r["kind"] for r in last.select("kind").distinct().collect()}  # a few names
    if kinds - {"link", "data"}:
        done = install(done, last.where("kind not in ('link', 'data')").select("path", "rid", F.col("bytes").alias("rgba")))
    if "link" in kinds:
        done = paste_links(dict(tables) | {"renditions": done}, last.where("kind = 'link'").select("path", "rid", F.col("bytes").alias("rgba")))
    if "data" in kinds:
        done = _with_data(done, last.where("kind = 'data'").select("path", "rid", "bytes"))
    return done


def _with_data(renditions: DataFrame, fresh: DataFrame) -> DataFrame:
    """renditions with new contents (path, rid, bytes); those that were compressed are compressed again."""
    columns = renditions.columns

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_wrapped(data, bool(old) and len(old) > 12 and bool(old[4] & 1)) for data, old in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["path", "rid", "wrapped"])

    old = renditions.select("path", "rid", F.substring("payload", 1, 13).alias("head"))
    wrapped = fresh.join(old, ["path", "rid"]).select("path", "rid", "bytes", "head").mapInArrow(wrap, "path string, rid int, wrapped binary")
    return renditions.join(wrapped, ["path", "rid"], "left").withColumn("payload", F.coalesce("wrapped", "payload")).select(*columns)


def _wrapped(data: bytes, compressed: bool) -> bytes:
    return codecs.raw_encode(codecs.deflate(data, "lzfse") if compressed else data, compressed)


def _added(tables: Tables, offered: DataFrame, told: DataFrame) -> tuple[Tables, DataFrame]:
    """The relations with vectors under new names, and the report rows of their entries."""
    if not offered.where("path is null and sniffed in ('svg', 'pdf')").isEmpty():
        paths = [r["path"] for r in tables["car_info"].select("path").limit(2).collect()]
        if len(paths) != 1:
            raise ValueError("with several files, entries to be added need a path")
        offered = offered.withColumn("path", F.coalesce("path", F.lit(paths[0])))
    known = tables["facets"].select("path", "name").unionAll(named_renditions(tables).select("path", "name")).distinct()
    able = tables["car_info"].where(F.array_contains("key_format", "element") & F.array_contains("key_format", "identifier")).select("path", "key_format")
    fresh = offered.where("w is null").join(known, ["path", "name"], "left_anti").join(able, "path")
    first = fresh.where("sniffed in ('svg', 'pdf')").groupBy("path", "name").agg(F.min("ordinal").alias("first"))
    mine = fresh.join(first, ["path", "name"]).where("ordinal >= first")
    kept = mine.groupBy("path", "name", "key_format").agg(F.min_by("sniffed", "ordinal").alias("sniffed"), F.max_by("bytes", "ordinal").alias("bytes"))
    outcome = F.when(F.col("ordinal") == F.col("first"), "added").otherwise(INSTALLED)
    gained = mine.select("path", "ordinal", "name", "entry", outcome.alias("outcome"), F.lit(1).cast("long").alias("n"))
    return _with_vectors(tables, kept), gained


def _with_vectors(tables: Tables, added: DataFrame) -> Tables:
    """Facets and vector renditions for new names; identifiers follow the largest of each file, in name order.

    An SVG is compressed, a PDF isn't.
    """
    used = tables["renditions"].select("path", F.try_element_at("key", F.lit("identifier")).alias("k")).unionAll(tables["facets"].select("path", F.try_element_at("attributes", F.lit("identifier"))))
    top = used.groupBy("path").agg(F.coalesce(F.max("k"), F.lit(0)).alias("top"))
    rids = tables["renditions"].groupBy("path").agg(F.max("rid").alias("top_rid"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_wrapped(data, kind == "svg") for kind, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], names=["path", "name", "key_format", "sniffed", "payload"])

    added = added.select("path", "name", "key_format", "sniffed", "bytes").mapInArrow(wrap, "path string, name string, key_format array<string>, sniffed string, payload binary")
    n = F.row_number().over(Window.partitionBy("path").orderBy("name"))  # at most 65535 in a file
    rows = added.withColumn("n", n).join(top, "path", "left").join(rids, "path", "left")
    number = F.coalesce("top", F.lit(0)) + F.col("n")
    rows = rows.withColumn("identifier", F.when(number > 65535, F.raise_error(F.lit("no identifier is left")).cast("int")).otherwise(number))
    key = F.create_map(F.lit("element"), F.col("identifier"), F.lit("identifier"), F.col("identifier"))
    with_scale = F.when(F.array_contains("key_format", "scale"), F.map_concat(key, F.create_map(F.lit("scale"), F.lit(1)))).otherwise(key)
    facets = rows.select("path", "name", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("hotspot"), key.alias("attributes"), F.lit(None).cast("string").alias("problem"))
    tlv = lambda k, tag, data: F.struct(F.lit(k).alias("ord"), F.lit(tag).cast("long").alias("tag"), F.lit(data).alias("data"))
    tlvs = F.array(tlv(0, records.COMPOSITION, records.pack_composition(0, 1.0)), tlv(1, records.BITMAP_INFO, b"\x01\0\0\0"))
    svg = F.col("sniffed") == "svg"
    file = F.concat("name", F.when(svg, ".svg").otherwise(".pdf"))
    zero = F.lit(0).cast("long")
    fixed = {
        "rid": F.coalesce("top_rid", F.lit(-1)) + F.col("n"), "key_bytes": F.lit(b""), "key": with_scale, "name": file, "name_bytes": file.cast("binary"), "layout": F.lit(records.VECTOR_LAYOUT), "flags": F.lit(4),
        "pixel_format": F.when(svg, "SVG").otherwise("PDF"), "version": F.lit(1), "unknown_a": F.lit(1), "tlvs": tlvs, "payload": F.col("payload"), "kind": F.lit("data"), "compression": F.lit(None).cast("string"),
    }
    types = dict(tables["renditions"].dtypes)
    fresh = rows.select("path", *[fixed.get(c, zero).cast(types[c]).alias(c) for c in tables["renditions"].columns if c != "path"])
    return dict(tables) | {"facets": tables["facets"].unionByName(facets), "renditions": tables["renditions"].unionByName(fresh)}


def clone_asset(tables: Tables, path: str, source: str, target: str, image: bytes | None = None) -> Tables:
    """A facet and its renditions again under a new name and the smallest free identifier.

    image: PNG bytes for the clones of exactly its size.  Refuses a missing source,
    an existing target, a source without identifier or renditions, and an image
    that fits none.  Links of a clone keep pointing to the shared atlas.
    """
    facets, renditions = tables["facets"].where(F.col("path") == path), tables["renditions"].where(F.col("path") == path)
    found = {r["name"]: r for r in facets.where(F.col("name").isin(source, target)).collect()}
    if source not in found:
        raise ValueError(f"no asset {source}")
    if target in found:
        raise ValueError(f"{target} exists")
    old = (found[source]["attributes"] or {}).get("identifier")
    if not old:
        raise ValueError(f"{source} has no identifier")
    from kilnwork.operators.keyed import smallest_free_id

    identifier = F.try_element_at("key", F.lit("identifier"))
    used = renditions.select(identifier.alias("k")).unionAll(facets.select(F.try_element_at("attributes", F.lit("identifier"))))
    new = smallest_free_id(used.where("k is not null"), "k").first()["free_id"]
    if new > 65535:
        raise ValueError("no identifier is left")
    mine = renditions.where(identifier == old)
    if mine.isEmpty():
        raise ValueError(f"{source} has no renditions")
    top = renditions.agg(F.max("rid").alias("m")).first()["m"]
    changed = lambda c: F.transform_values(c, lambda k, v: F.when(k == "identifier", F.lit(int(new)).cast("int")).otherwise(v))
    name = F.replace(F.col("name"), F.lit(source), F.lit(target))
    clones = mine.withColumn("key", changed(F.col("key"))).withColumn("rid", F.col("rid") + int(top) + 1).withColumn("name", name).withColumn("name_bytes", name.cast("binary"))
    if image is not None:
        pixels = codecs.png_read(image)
        fits = clones.where((F.col("kind") == "image") & (F.col("width") == pixels.shape[1]) & (F.col("height") == pixels.shape[0]))
        if fits.isEmpty():
            sizes = mine.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))), ", ").alias("s")).first()["s"]
            raise ValueError(f"the image fits none of {sizes}")
        clones = install(clones, fits.select("path", "rid", F.lit(pixels.tobytes()).alias("rgba")))
    facet = facets.where(F.col("name") == source).withColumn("name", F.lit(target)).withColumn("attributes", changed(F.col("attributes")))
    return dict(tables) | {"facets": tables["facets"].unionByName(facet), "renditions": tables["renditions"].unionByName(clones)}


def pack(images: DataFrame, path: str = "packed.car", version: str = "kilnwork", platform: str = "ios", platform_version: str = "15.0") -> Tables:
    """A catalog from (file, bytes) rows of PNG files, as relations.

    A file's name gives asset and scale (name@2x.png); with columns asset, scale or
    idiom those are taken.  Of files with the same asset, idiom and scale the
    first by name stays.  Assets are numbered from 1 in name order.
    """
    spark = images.sparkSession
    base, scale = names.scale_suffix(F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.[Pp][Nn][Gg]$", ""))
    given = lambda c, other: F.coalesce(F.col(c), other) if c in images.columns else other
    idiom = F.lit(0)
    if "idiom" in images.columns:
        for name, number in IDIOMS.items():
            idiom = F.when(F.col("idiom") == name, number).otherwise(idiom)
    rows = images.select("file", "bytes", given("asset", base).alias("asset"), given("scale", scale).cast("int").alias("scale"), idiom.cast("int").alias("idiom"))
    from kilnwork.operators.keyed import dense_ids, first_wins, global_index

    kept = first_wins(rows, ["asset", "idiom", "scale"], [F.col("file")])
    ids = dense_ids(kept, "asset")
    # Numbers are dealt to keys alone; images stay where they are until they meet them.
    order = global_index(kept.select("asset", "idiom", "scale"), [F.col("asset"), F.col("idiom"), F.col("scale")], "rid").withColumn("rid", F.col("rid").cast("int"))
    numbered = kept.join(ids, "asset").join(order, ["asset", "idiom", "scale"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asset, idiom, scale, number, rid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = codecs.png_read(data)
                if image is None:
                    raise ValueError(f"{asset} is no PNG")
                height, width = image.shape[:2]
                pixel = codecs.infer_pixel_format(image)
                stride = codecs.row_stride(width, pixel)
                name = f"{asset}{'' if scale == 1 else f'@{scale}x'}.png"
                key = [(k, v) for k, v in (("scale", scale), ("idiom", idiom), ("identifier", number), ("element", ELEMENT), ("part", PART)) if v]
                tlvs = [{"ord": k, "tag": t, "data": d} for k, (t, d) in enumerate(((records.SLICES, records.pack_slices([(0, 0, width, height)])), (records.METRICS, records.pack_metrics([0, 0, 0, 0, width, height])), (records.COMPOSITION, records.pack_composition(0, 1.0)), (records.BITMAP_INFO, b"\x01\0\0\0"), (records.ROW_STRIDE, stride.to_bytes(4, "little"))))]
                row = [path, rid, b"", key, name, name.encode(), records.IMAGE_LAYOUT, 0, pixel, 1, width, height, 100 * scale, 0, 1, 1, 0, tlvs, codecs.bitmap_encode(image, "zlib", stride, pixel), "image", "zlib"]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMAS["renditions"]))
    renditions = numbered.select("asset", "idiom", "scale", "id", "rid", "bytes").mapInArrow(work, SCHEMAS["renditions"])
    attributes = F.create_map(F.lit("element"), F.lit(ELEMENT), F.lit("part"), F.lit(PART), F.lit("identifier"), F.col("id").cast("int"))
    facets = ids.select(F.lit(path).alias("path"), F.col("asset").alias("name"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("hotspot"), attributes.alias("attributes"), F.lit(None).cast("string").alias("problem"))
    listed = [r["asset"] for r in ids.orderBy("id").select("asset").collect()]  # at most 65535 names
    uuid = hashlib.sha256("\n".join(listed).encode()).hexdigest()[:32]
    header = [(path, *HEADER_NUMBERS, 0, 0, version, version, uuid, 0, 2, 1, 2, list(KEY_FORMAT), ["", platform_version, platform, "kilnwork"], {})]
    return {
        "car_info": spark.createDataFrame(header, SCHEMAS["car_info"]),
        "facets": facets,
        "appearances": spark.createDataFrame([(path, APPEARANCE, 0)], SCHEMAS["appearances"]),
        "localizations": spark.createDataFrame([], SCHEMAS["localizations"]),
        "bitmap_keys": spark.createDataFrame([], SCHEMAS["bitmap_keys"]),
        "renditions": renditions,
    }


def manifest(tables: Tables) -> DataFrame:
    """(path, manifest): a catalog as one JSON document; bytes are base64, map keys sorted."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c)))
    r = tables["renditions"].select("path", F.struct("rid", entries("key").alias("key"), "name", "layout", "flags", "pixel_format", "color_space_id", "width", "height", "scale", "modified", "kind", "compression", "tlvs", "payload").alias("row"))
    f = tables["facets"].select("path", F.struct("name", "hotspot", entries("attributes").alias("attributes")).alias("row"))
    out = tables["car_info"].select("path", F.struct(*[c for c in tables["car_info"].columns if c != "path"]).alias("header"))
    for name, rows in (("facets", f), ("renditions", r)):
        out = out.join(rows.groupBy("path").agg(F.collect_list("row").alias(name)), "path", "left")
    return out.select("path", F.to_json(F.struct("header", "facets", "renditions")).alias("manifest"))


def decode_unique(spark: SparkSession, path: str) -> DataFrame:
    """All bitmaps of the catalogs under a path, links included."""
    from kilnwork.sources.catalog import tables as read

    found = read(spark, path)
    return bitmaps(found["renditions"]).unionAll(linked_images(found))
