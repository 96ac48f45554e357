"""Catalog files as DataFrames, and back.

Files are read with Spark's binaryFile source, so any file system that Spark
reaches will do, and each file is parsed by one task, once for all relations that
``tables`` gives.  Every relation has the file's ``path`` first.  Narrow relations
give no more than they hold: ``rendition_headers`` never parses tagged records or
payloads, though the file's bytes come to the task that reads them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from kilnwork.functions.workspace import stored, write_files
from kilnwork.sources import codecs, records
from kilnwork.sources.blockstore import Store, StoreError, Writer

_TLVS = "array<struct<ord:int,tag:bigint,data:binary>>"
_RENDITION_HEAD = "rid int, key_bytes binary, key map<string,int>, name string, name_bytes binary, layout int, flags bigint, pixel_format string, color_space_id bigint, width bigint, height bigint, scale bigint, modified bigint"
SCHEMAS = {
    "car_info": "path string, coreui_version bigint, storage_version bigint, storage_timestamp bigint, rendition_count bigint, main_version_string string, version_string string, uuid string, associated_checksum bigint, schema_version bigint, color_space_id bigint, key_semantics bigint, key_format array<string>, metadata array<string>, extra_vars map<string,binary>",
    "facets": "path string, name string, hotspot struct<x:int,y:int>, attributes map<string,int>, problem string",
    "appearances": "path string, name string, id int",
    "localizations": "path string, name string, id int",
    "bitmap_keys": "path string, key bigint, value binary",
    "rendition_headers": f"path string, {_RENDITION_HEAD}",
    "renditions": f"path string, {_RENDITION_HEAD}, version bigint, unknown_a bigint, unknown_b bigint, tlvs {_TLVS}, payload binary, kind string, compression string",
    "blocks": "path string, block_id int, bytes binary",
    "vars": "path string, name string, block_id int",
}
_PARTS = ("car_info", "facets", "appearances", "localizations", "bitmap_keys", "renditions")
#: Names that the relations cover; all others are kept as extra_vars.
_COVERED = ("CARHEADER", "EXTENDED_METADATA", "KEYFORMAT", "APPEARANCEKEYS", "LOCALIZATIONKEYS", "FACETKEYS", "BITMAPKEYS", "RENDITIONS")


def _key_format(store: Store) -> list[str]:
    raw = store.named("KEYFORMAT")
    if raw is None:
        raise StoreError("no key format")
    return records.parse_key_format(raw)


def _info(store: Store) -> Iterator[tuple]:
    h = records.CatalogHeader.parse(store.named("CARHEADER") or b"")
    extra = {n: store.block(b) for n, b in store.names.items() if n not in _COVERED}
    yield h.coreui_version, h.storage_version, h.storage_timestamp, h.rendition_count, h.main_version_string, h.version_string, h.uuid, h.associated_checksum, h.schema_version, h.color_space_id, h.key_semantics, _key_format(store), records.parse_metadata(store.named("EXTENDED_METADATA")), list(extra.items())


def _facets(store: Store) -> Iterator[tuple]:
    """Facets that can't be read keep their name and say why."""
    for key, value in store.tree("FACETKEYS"):
        try:
            x, y, attributes = records.parse_facet(value)
            yield key.decode("utf-8", "replace"), {"x": x, "y": y}, list(attributes.items()), None
        except (records.RecordError, struct.error) as e:
            yield key.decode("utf-8", "replace"), None, None, str(e)


def _dictionary(name: str) -> Callable[[Store], Iterator[tuple]]:
    def rows(store: Store) -> Iterator[tuple]:
        for key, value in store.tree(name):
            yield key.decode("utf-8", "replace"), records.short_id(value)

    return rows


def _head(rid: int, key: bytes, key_format: list[str], r: records.Rendition) -> tuple:
    return rid, key, list(records.key_of(key, key_format).items()), r.name.decode("utf-8", "replace"), r.name, r.layout, r.flags, records.pixel_format_name(r.pixel_format), r.color_space_id, r.width, r.height, r.scale, r.modified


def _headers(store: Store) -> Iterator[tuple]:
    key_format = _key_format(store)
    for rid, (key, value) in enumerate(store.tree("RENDITIONS")):
        yield _head(rid, key, key_format, records.Rendition.parse_header(value))


def _renditions(store: Store) -> Iterator[tuple]:
    key_format = _key_format(store)
    for rid, (key, value) in enumerate(store.tree("RENDITIONS")):
        r = records.Rendition.parse(value)
        tlvs = [{"ord": k, "tag": t, "data": d} for k, (t, d) in enumerate(r.tlvs)]
        yield *_head(rid, key, key_format, r), r.version, r.unknown_a, r.unknown_b, tlvs, r.payload, records.content_kind(r), codecs.compression_of(r.payload)


_ROWS: dict[str, Callable[[Store], Iterator[tuple]]] = {
    "car_info": _info,
    "facets": _facets,
    "appearances": _dictionary("APPEARANCEKEYS"),
    "localizations": _dictionary("LOCALIZATIONKEYS"),
    "bitmap_keys": lambda store: store.inline_tree("BITMAPKEYS"),
    "rendition_headers": _headers,
    "renditions": _renditions,
    "blocks": lambda store: enumerate(store.blocks),
    "vars": lambda store: iter(store.names.items()),
}


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def parse_catalog(data: bytes, table: str) -> list[tuple]:
    """The rows of one relation of one file's bytes, without the path."""
    return list(_ROWS[table](Store(data)))


def read_catalog(spark: SparkSession, path: str | list[str], table: str = "renditions", rows_per_batch: int = 256) -> DataFrame:
    """One relation of all catalogs under a path (folders are searched)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return parse_frame(files, table, rows_per_batch)


def parse_frame(files: DataFrame, table: str, rows_per_batch: int = 256) -> DataFrame:
    """As read_catalog, of a frame (path, content)."""
    arrow = to_arrow_schema(_schema(SCHEMAS[table]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for row in _ROWS[table](Store(content.as_py())):
                    rows.append((path.as_py(), *row))
                    if len(rows) >= rows_per_batch:
                        yield _batch(rows, arrow)
                        rows = []
                if rows:
                    yield _batch(rows, arrow)

    return files.select("path", "content").mapInArrow(work, SCHEMAS[table])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All relations that writing needs; each file is read and parsed once."""
    return parse_tables(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def parse_tables(files: DataFrame, rows_per_batch: int = 256) -> dict[str, DataFrame]:
    """As tables, of a frame (path, content).

    One pass writes the rows of all relations to one stored table, a struct for each
    relation; a relation's reader gets its own columns only.
    """
    schemas = {name: _schema(SCHEMAS[name]) for name in _PARTS}
    schema = "relation string, " + ", ".join(f"{name} {s.simpleString()}" for name, s in schemas.items())
    arrow = {name: to_arrow_schema(s) for name, s in schemas.items()}
    kinds = {name: pa.struct(list(s)) for name, s in arrow.items()}

    def tagged(name: str, rows: list[tuple]) -> pa.RecordBatch:
        mine = pa.StructArray.from_arrays(_batch(rows, arrow[name]).columns, fields=list(arrow[name]))
        columns = [mine if other == name else pa.nulls(len(rows), kinds[other]) for other in _PARTS]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *columns], names=["relation", *_PARTS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                store = Store(content.as_py())
                for name in _PARTS:
                    rows: list[tuple] = []
                    for row in _ROWS[name](store):
                        rows.append((path.as_py(), *row))
                        if len(rows) >= rows_per_batch:
                            yield tagged(name, rows)
                            rows = []
                    if rows:
                        yield tagged(name, rows)

    kept = stored(files.select("path", "content").mapInArrow(work, schema), "relations")
    return {name: unsent(kept.where(F.col("relation") == name).select(f"{name}.*")) for name in _PARTS}


def unsent(rows: DataFrame) -> DataFrame:
    """rows that joins never send whole through the driver: their files say too little of their size, as they pack well."""
    return rows.hint("merge")


def _map(value: object) -> dict:
    return dict(value or [])


def assemble(info: dict, facets: list[dict], appearances: list[dict], localizations: list[dict], bitmap_keys: list[dict], renditions: list[dict]) -> bytes:
    """One catalog's bytes; trees are sorted by their keys' bytes, and equal rendition keys are an error."""
    writer, key_format = Writer(), list(info["key_format"])
    header = {k: info[k] for k in records.CatalogHeader.__dataclass_fields__ if k != "rendition_count"}
    writer.put("CARHEADER", records.CatalogHeader(rendition_count=len(renditions), **header).pack())
    if info.get("metadata") is not None:
        writer.put("EXTENDED_METADATA", records.pack_metadata(list(info["metadata"])))
    writer.put("KEYFORMAT", records.pack_key_format(key_format))
    for name, rows in (("APPEARANCEKEYS", appearances), ("LOCALIZATIONKEYS", localizations)):
        if rows:
            writer.tree(name, sorted((r["name"].encode(), r["id"].to_bytes(2, "little")) for r in rows))
    writer.tree("FACETKEYS", sorted((r["name"].encode(), records.pack_facet((r["hotspot"] or {}).get("x", 0), (r["hotspot"] or {}).get("y", 0), _map(r["attributes"]))) for r in facets if r["attributes"] is not None))
    writer.tree("BITMAPKEYS", sorted((r["key"], r["value"]) for r in bitmap_keys), inline=True, node_bytes=1024)
    entries = []
    for r in renditions:
        value = records.Rendition(r["version"], r["flags"], r["width"], r["height"], r["scale"], records.pixel_format_code(r["pixel_format"]) or 0, r["color_space_id"], r["modified"], r["layout"], r["name_bytes"], r["unknown_a"], r["unknown_b"], [(t["tag"], t["data"]) for t in sorted(r["tlvs"] or [], key=lambda t: t["ord"])], r["payload"] or b"")
        entries.append((records.key_bytes(_map(r["key"]), key_format), value.pack()))
    entries.sort(key=lambda e: e[0])
    if any(a[0] == b[0] for a, b in zip(entries, entries[1:], strict=False)):
        raise ValueError("two renditions with one key")
    writer.tree("RENDITIONS", entries)
    for name, raw in sorted(_map(info.get("extra_vars")).items()):
        writer.put(name, raw)
    return writer.finish()


def build_catalogs(parts: dict[str, DataFrame]) -> DataFrame:
    """(path, content) of the catalogs that the relations hold; one task assembles each file.

    The rows of all relations meet in one shuffle and stream into the task that
    writes their file, which holds one file at a time.  Rows of files without a
    header are left out.
    """
    kinds = {name: _schema(SCHEMAS[name]) for name in _PARTS}
    gathered = None
    for k, name in enumerate(_PARTS):
        mine = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds[name]])
        columns = [(mine if other == name else F.lit(None)).cast(kinds[other]).alias(other) for other in _PARTS]
        rows = parts[name].select("path", F.lit(k).alias("part"), *columns)
        gathered = rows if gathered is None else gathered.unionAll(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}
        path = None

        def file() -> Iterator[pa.RecordBatch]:
            if held.get("car_info"):
                data = assemble(held["car_info"][0], *(held.get(n, []) for n in _PARTS[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary())], names=["path", "content"])

        for batch in batches:
            for k, (of, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if of != path:
                    yield from file()
                    held, path = {}, of
                held.setdefault(_PARTS[part], []).append(batch.column(2 + part)[k].as_py())
        yield from file()

    return gathered.repartition("path").sortWithinPartitions("path", "part").mapInArrow(work, "path string, content binary")


def save(files: DataFrame, folder: str) -> None:
    """Writes each (path, content) as a file named like the path's last part, from the tasks that hold them."""
    write_files(files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("content").alias("bytes")), folder)
