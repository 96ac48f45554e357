"""Catalogs as working folders: one JSON manifest and editable files for each, and back.

The manifest holds every relation, original payloads included (base64), and the
SHA-256 of each file as it was written.  Coming back, files that are missing or
unchanged leave their rendition's bytes alone; only changed ones are encoded.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.functions.names import sanitize
from kilnwork.functions.workspace import by_arrow, changed_files, literal, stored, write_files, written_by_tasks
from kilnwork.operators import catalogs
from kilnwork.sources import catalog, codecs, records

Tables = dict[str, DataFrame]
_FILES = "rid int, file string, role string, sha256 string"
#: Folders of a catalog's own files.
_FOLDERS = ("renditions", "data", "rawpayload")
_LISTS = ("facets", "appearances", "localizations", "bitmap_keys", "renditions")


def files_of(tables: Tables, raw: bool = False, previews: bool = True) -> DataFrame:
    """(path, rid, file, role, bytes) of what can be edited.

    Roles: image and link (PNG), data (sniffed extension) and payload (opaque).
    raw writes every payload as it is, links apart; without previews no PNG is made.
    """
    r = tables["renditions"]
    stem = F.concat(F.when(F.col("rid") < 1000, F.lpad(F.col("rid").cast("string"), 3, "0")).otherwise(F.col("rid").cast("string")), F.lit("-"), sanitize(F.col("name")))
    names = r.select("path", "rid", stem.alias("stem"), "kind")

    def png(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codecs.png_write(np.frombuffer(rgba, np.uint8).reshape(h, w, 4)) for w, h, rgba in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["path", "rid", "bytes"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, rid, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = codecs.raw_decode(payload) if kind == "data" and not raw else None
                data = payload if found is None else found[0]
                role = "payload" if found is None else "data"
                rows.append((path, rid, role, records.sniff(data) or "bin", data))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()))], names=["path", "rid", "role", "ext", "bytes"])

    empty = r.where(F.lit(False))
    images = catalogs.bitmaps(r if previews and not raw else empty).mapInArrow(png, "path string, rid int, bytes binary")
    links = catalogs.linked_images(tables if previews else dict(tables) | {"renditions": empty}).mapInArrow(png, "path string, rid int, bytes binary")
    opaque = r.where("kind in ('data', 'raw_payload', 'color', 'gradient', 'multisize')" + (" or kind = 'image'" if raw else "")).where("octet_length(payload) > 0")
    others = opaque.select("path", "rid", "kind", "payload").mapInArrow(plain, "path string, rid int, role string, ext string, bytes binary")
    shown = images.withColumn("role", F.lit("image")).unionByName(links.withColumn("role", F.lit("link"))).withColumn("ext", F.lit("png"))
    folder = F.when(F.col("role") == "data", "data/").when(F.col("role") == "payload", "rawpayload/").otherwise("renditions/")
    every = shown.unionByName(others).join(names, ["path", "rid"])
    bare = F.regexp_replace("stem", r"\.(png|svg|pdf|bin)$", "")
    return every.select("path", "rid", F.concat(folder, bare, F.lit("."), "ext").alias("file"), "role", "bytes")


def _files(tables: Tables, raw: bool, previews: bool) -> DataFrame:
    if raw and not previews:
        raise ValueError("raw writes no previews anyway; choose one of the two")
    return files_of(tables, raw, previews)


def _sums(files: DataFrame) -> DataFrame:
    return files.select("path", "rid", "file", "role", F.sha2("bytes", 256).alias("sha256"))


def decompile(tables: Tables, raw: bool = False, previews: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, manifest) and (path, file, bytes).  raw and no previews exclude each other."""
    files = _files(tables, raw, previews)
    out = tables["car_info"].select("path", F.struct(*[c for c in tables["car_info"].columns if c != "path"]).alias("car_info"))
    sums = _sums(files)
    listed = sums.select("path", F.struct(*[c for c in sums.columns if c != "path"]).alias("row"))
    parts = [(name, tables[name].select("path", F.struct(*[c for c in tables[name].columns if c != "path"]).alias("row"))) for name in _LISTS]
    for name, rows in [*parts, ("files", listed)]:
        out = out.join(catalog.unsent(rows.groupBy("path").agg(F.collect_list("row").alias(name))), "path", "left")
    return out.select("path", F.to_json(F.struct("car_info", *_LISTS, "files")).alias("manifest")), files.select("path", "file", "bytes")


def write(tables: Tables, folder: str, raw: bool = False, previews: bool = True) -> None:
    """A sub-folder for each catalog, named like its file."""
    below = F.concat(F.regexp_extract("path", "([^/]*)$", 1), F.lit("/"), "file").alias("file")
    if not written_by_tasks(folder):
        manifests, files = decompile(tables, raw, previews)
        rows = manifests.select("path", F.lit("manifest.json").alias("file"), F.col("manifest").cast("binary").alias("bytes")).unionAll(files)
        write_files(rows.select(below, "bytes"), folder)
        return
    files = _files(tables, raw, previews)
    write_files(files.select(below, "bytes"), folder)
    _write_manifests(tables, files, folder)


def _write_manifests(tables: Tables, files: DataFrame, folder: str) -> None:
    """The manifests that decompile gives, each written row by row by the task that gets its rows in order."""
    parts = {name: tables[name] for name in ("car_info", *_LISTS)} | {"files": _sums(files)}
    names, rows = list(parts), None
    for k, part in enumerate(parts.values()):
        mine = part.select("path", F.lit(k).alias("part"), F.to_json(F.struct(*[c for c in part.columns if c != "path"])).alias("row"))
        rows = mine if rows is None else rows.unionAll(mine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        path = last = out = None
        target = part_file = ""
        n = 0

        def finish() -> None:
            nonlocal out, n
            if out is not None:
                out.write(b"]}" if last else b"}")
                out.close()
                system.move(part_file, target)
                out, n = None, n + 1

        for batch in batches:
            for of, part, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != path:
                    finish()
                    path, last = of, None
                    if part == 0:  # files without a header are left out
                        target = f"{root.rstrip('/')}/{of.rsplit('/', 1)[-1]}/manifest.json"
                        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(part_file := f"{target}.{uuid.uuid4().hex}.part")
                if out is None or part == last == 0:
                    continue
                if part != last:
                    before = "{" if last is None else "]," if last else ","
                    out.write(f'{before}"{names[part]}":{"[" if part else ""}{row}'.encode())
                    last = part
                else:
                    out.write(f",\n{row}".encode())
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.repartition("path").sortWithinPartitions("path", "part").mapInArrow(work, "n long").agg(F.sum("n")).first()


def _inner(name: str) -> str:
    return catalog.SCHEMAS[name].removeprefix("path string, ")


def _manifests_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the manifests in a folder and below; folders of a catalog's own files are not listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [path(folder)]
    while todo:
        at = todo.pop()
        manifest = path(at, "manifest.json")
        own = set()
        if system.exists(manifest):
            found.append(system.makeQualified(manifest).toString())
            own = set(_FOLDERS)
        rows = system.listStatusIterator(at)
        while rows.hasNext():
            row = rows.next()
            if row.isDirectory() and row.getPath().getName() not in own:
                todo.append(row.getPath())
    return sorted(found)


def _split(text: str) -> Iterator[tuple[str, str]]:
    """(name, JSON) of a manifest's header and of each row of its lists, one at a time."""
    decode, blank = json.JSONDecoder().raw_decode, re.compile("[ \\t\\r\\n]*").match

    def skip(at: int, sign: str = "") -> int:
        at = blank(text, at).end()
        if not sign:
            return at
        if text[at : at + 1] not in tuple(sign):
            raise ValueError(f"a manifest has no {' or '.join(sign)} at {at}")
        return blank(text, at + 1).end()

    at, end = skip(0, "{"), ""
    while text[at : at + 1] != "}" and end != "}":
        name, at = decode(text, at)
        at = skip(at, ":")
        many = text[at : at + 1] == "["
        at = skip(at, "[") if many else at
        while not (many and text[at : at + 1] == "]"):
            value, close = decode(text, at)
            if value is not None:
                yield name, text[at:close]
            at = skip(close)
            if not many or text[at : at + 1] == "]":
                break
            at = skip(at, ",")
        at = skip(at, "]") if many else at
        end = text[at : at + 1]
        at = skip(at, ",}")


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, row): header and rows of the manifests in a working folder, as JSON."""
    paths, plain = _manifests_below(spark, folder), _plain(spark, folder)
    if reached := by_arrow(plain) is not None:
        found = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    elif paths:
        found = spark.read.format("binaryFile").load([literal(p) for p in paths]).select("path", "content")
    else:
        found = spark.createDataFrame([], "path string, content binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = by_arrow(plain) if reached else (None, "")
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                if system is None:
                    data = batch.column(1)[k].as_py()
                else:
                    with system.open_input_stream(root + path[len(plain.rstrip("/")) :]) as f:
                        data = f.read()
                rows = _split(data.decode())
                while some := list(itertools.islice(rows, 256)):
                    of = pa.array([path.removesuffix("/manifest.json")] * len(some))
                    yield pa.RecordBatch.from_arrays([of, *(pa.array(c) for c in zip(*some, strict=True))], names=["path", "name", "row"])

    return stored(found.mapInArrow(work, "path string, name string, row string"), "manifests")


def _relation(manifests: DataFrame, name: str, schema: str) -> DataFrame:
    row = F.from_json("row", catalog._schema(schema)).alias("row")
    return catalog.unsent(manifests.where(F.col("name") == name).select("path", row).select("path", "row.*"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rid, role, sha256, file) of the files that the manifests of a working folder name; file is below the folder."""
    return _listed(_manifests(spark, folder), _plain(spark, folder))


def _listed(manifests: DataFrame, plain: str) -> DataFrame:
    below = F.concat(F.substring("path", len(plain.rstrip("/")) + 2, 1 << 30), F.lit("/"), "file")
    return _relation(manifests, "files", _FILES).select("path", "rid", "role", "sha256", F.regexp_replace(below, "^/", "").alias("file"))


def _plain(spark: SparkSession, folder: str) -> str:
    """A folder as Spark names it in the paths of its files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def read(spark: SparkSession, folder: str) -> Tables:
    """The relations of the catalogs in a working folder, with its edits applied.

    Only manifests are listed; the files that they name are opened by tasks.
    """
    manifests, plain = _manifests(spark, folder), _plain(spark, folder)
    tables = {name: _relation(manifests, name, _inner(name)) for name in ("car_info", *_LISTS)}
    edited = stored(changed_files(_listed(manifests, plain), plain), "edited")
    edited = catalog.unsent(edited.select("path", "rid", "role", "content"))

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [codecs.png_read(x) for x in batch.column(2).to_pylist()]
            if any(i is None for i in images):
                raise ValueError("an edited image is no PNG")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes() for i in images], pa.binary())], names=["path", "rid", "rgba"])

    def decoded(role: str) -> DataFrame:
        return edited.where(F.col("role") == role).select("path", "rid", "content").mapInArrow(pixels, "path string, rid int, rgba binary")

    columns = tables["renditions"].columns
    done = catalogs.install(tables["renditions"], decoded("image"))
    done = catalogs._with_data(done, edited.where("role = 'data'").select("path", "rid", F.col("content").alias("bytes")))
    fresh = edited.where("role = 'payload'").select("path", "rid", F.col("content").alias("fresh"))
    done = done.join(fresh, ["path", "rid"], "left").withColumn("payload", F.coalesce("fresh", "payload")).select(*columns)
    tables["renditions"] = done
    tables["renditions"] = catalogs.paste_links(tables, decoded("link"))
    return tables
