"""Command line: info, decompile, compile, pack and clone-asset, over any folders that Spark reaches."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from kilnwork.operators import catalogs, workdir
from kilnwork.sources import catalog, images


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kilnwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: tuple[str, str]) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text, description=text)
        for place, meaning in places:
            made.add_argument(place, help=meaning)
        return made

    made = command("info", "Show headers and censuses of catalogs.", ("path", "a catalog, or a folder of them"))
    made.add_argument("--renditions", action="store_true", help="list every rendition too")
    made = command("decompile", "Write a working folder for each catalog.", ("path", "a catalog, or a folder of them"), ("out", "folder to write to"))
    how = made.add_mutually_exclusive_group()
    how.add_argument("--raw", action="store_true", help="keep every payload as it is")
    how.add_argument("--no-previews", action="store_true", help="make no images; faster, but nothing to paint over")
    command("compile", "Write the catalogs of working folders.", ("folder", "a folder of working folders"), ("out", "folder to write to"))
    made = command("pack", "Write a catalog from PNG files and image sets.", ("input", "a PNG file, or a folder"), ("out", "folder to write to"))
    made.add_argument("--name", default="Assets.car", help="the catalog's name")
    made.add_argument("--platform", default="ios")
    made.add_argument("--platform-version", default="15.0")
    made = command("clone-asset", "Duplicate an asset under a new name.", ("path", "one catalog"), ("out", "folder to write to"))
    made.add_argument("--from", dest="source", required=True, help="the asset")
    made.add_argument("--to", dest="target", required=True, help="its new name")
    made.add_argument("--image", help="a PNG file for the clone's bitmaps of its size")
    return parser


def _content(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise ValueError(f"no file {path}")
    return bytes(row["content"])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = _arguments().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("kilnwork").getOrCreate()
    if given.command == "info":
        found = catalog.tables(spark, given.path)
        catalogs.info(found).drop("extra_vars").show(1000, truncate=False, vertical=True)
        catalogs.previews(found).show(1000, truncate=False)
        if given.renditions:
            rows = found["renditions"].select("path", "rid", "name", "kind", "compression", "pixel_format", "width", "height", "scale", "key").orderBy("path", "rid")
            for row in rows.toLocalIterator():
                print(*row, sep="\t")
    elif given.command == "decompile":
        workdir.write(catalog.tables(spark, given.path), given.out, raw=given.raw, previews=not given.no_previews)
    elif given.command == "compile":
        catalog.save(catalog.build_catalogs(workdir.read(spark, given.folder)), given.out)
    elif given.command == "pack":
        rows, missing = images.scan_images(spark, given.input)
        for row in missing.orderBy("file").limit(100).collect():
            print("missing:", row["file"])
        if rows.isEmpty():
            raise ValueError(f"no PNG files in {given.input}")
        packed = catalogs.pack(rows, given.name, platform=given.platform, platform_version=given.platform_version)
        catalog.save(catalog.build_catalogs(packed), given.out)
    else:
        found = catalog.tables(spark, given.path)
        paths = [r["path"] for r in found["car_info"].select("path").limit(2).collect()]
        if len(paths) != 1:
            raise ValueError("an asset is cloned within one catalog")
        image = _content(spark, given.image) if given.image else None
        done = catalogs.clone_asset(found, paths[0], given.source, given.target, image)
        catalog.save(catalog.build_catalogs(done), given.out)
        print(f"{given.target}: {catalogs.named_renditions(done).where(F.col('name') == given.target).count()} renditions")


if __name__ == "__main__":
    main()
