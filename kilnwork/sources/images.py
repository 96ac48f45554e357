"""Folders of images: loose PNG files and bundles with a JSON descriptor.

A bundle is a folder named like ``logo.imageset`` with a ``Contents.json`` that
lists slots: file name, scale ("2x") and idiom.  Its asset is the folder's name.
A loose file's asset and scale come from its own name (logo@2x.png).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUNDLE, DESCRIPTOR = ".imageset", "Contents.json"
_SLOTS = "images array<struct<filename:string,scale:string,idiom:string>>"


def scale_of(text: Column) -> Column:
    """2 of "2x"; 1 if there is nothing to read."""
    return F.coalesce(F.regexp_extract(text, "^([0-9]+)x$", 1).try_cast("int"), F.lit(1))


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, bytes, asset, scale, idiom) of a folder or a single file, and the slots whose file is missing.

    Slots without a file name are skipped; null asset, scale and idiom leave them to the file's name.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = read.load(path).select("path", "content")
    pngs = files.where(F.lower("path").endswith(".png")).select(F.col("path").alias("file"), F.col("content").alias("bytes"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    described = files.where(F.col("path").endswith(f"{BUNDLE}/{DESCRIPTOR}"))
    slots = described.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode(F.from_json(F.col("content").cast("string"), _SLOTS)["images"]).alias("slot"))
    named = slots.where("slot.filename is not null").select("folder", F.concat("folder", F.lit("/"), "slot.filename").alias("file"), scale_of(F.col("slot.scale")).alias("scale"), F.coalesce("slot.idiom", F.lit("universal")).alias("idiom"))
    joined = named.join(pngs.select("file", "bytes"), "file", "left")
    bundled = joined.where("bytes is not null").select("file", "bytes", F.regexp_extract("folder", r"([^/]*)\.imageset$", 1).alias("asset"), "scale", "idiom")
    loose = pngs.where(~F.col("folder").endswith(BUNDLE)).select("file", "bytes", F.lit(None).cast("string").alias("asset"), F.lit(None).cast("int").alias("scale"), F.lit(None).cast("string").alias("idiom"))
    return loose.unionByName(bundled), joined.where("bytes is null").select("file")
