"""Working tables in the folder that all executors share (spark.checkpoint.dir), and files written by tasks."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kilnwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it; cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file through the file system of its path, without a checksum file beside it, so that it may be edited."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(at, False)
    system.setWriteChecksum(False)
    try:
        out = system.create(at, True)
        out.write(bytearray(data))
        out.close()
    finally:
        system.setWriteChecksum(True)


def written_by_tasks(folder: str) -> bool:
    """Whether Arrow, and so a task, writes to a folder's store."""
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def by_arrow(folder: str) -> tuple[fs.FileSystem, str] | None:
    """Arrow's file system and the folder in it, of a folder as Spark names it; None for stores that Arrow doesn't reach."""
    if folder.startswith("file:/"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", folder).rstrip("/")
    try:
        system, root = fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return None
    return None if "%" in folder else (system, root.rstrip("/"))  # an escape to Arrow only


def literal(path: str) -> str:
    """A path for Spark's readers, which take some of its characters for a pattern otherwise."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def changed_files(files: DataFrame, folder: str) -> DataFrame:
    """files (file, sha256, ...) whose bytes have another hash, with those as content; missing files are left out.

    file is a path below a folder, whose name is a qualified path of Spark's.  Tasks open the files that they are told, so the
    driver lists none; stores that Arrow can't read are listed by Spark instead.
    """
    if by_arrow(folder) is None:
        found = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(literal(folder))
        named = files.withColumn("__at", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))
        joined = named.join(found.select(F.col("path").alias("__at"), "content"), "__at").where(F.sha2("content", 256) != F.col("sha256"))
        return joined.select(*files.columns, "content")

    at = [files.columns.index(c) for c in ("file", "sha256")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = by_arrow(folder)
        for batch in batches:
            for k, (name, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in at), strict=True)):
                try:
                    with system.open_input_stream(f"{root}/{name}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                if hashlib.sha256(data).hexdigest() != known:
                    yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each (file, bytes) below a folder, from the task that holds it; returns how many.

    A file appears whole, by a move, so a task that runs again does no harm.  Stores
    that Arrow can't write to get their files one at a time through the driver.
    """
    rows = files.select("file", "bytes")
    if not written_by_tasks(folder):
        n = 0
        for row in rows.toLocalIterator():
            put_file(files.sparkSession, f"{folder}/{row['file']}", bytes(row["bytes"]))
            n += 1
        return n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{root.rstrip('/')}/{name.as_py()}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(part := f"{target}.{uuid.uuid4().hex}.part") as out:
                    out.write(data.as_buffer())
                system.move(part, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(work, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
