"""Working folders: unedited ones give the same bytes again, edits take effect; folders of images."""

from __future__ import annotations

import json

from pyspark.sql import DataFrameReader

from kilnwork.functions import workspace
from kilnwork.operators import catalogs, workdir
from kilnwork.sources import catalog, codecs, images
from tests.test_catalog import packed, pixels, solid, write  # noqa: F401


def test_round_trip_and_edit(spark, packed, tmp_path):  # noqa: F811
    found = catalog.tables(spark, packed)
    folder = f"file://{tmp_path}/work"
    workdir.write(found, folder)
    work = tmp_path / "work" / "tiny.car"
    assert sorted(p.name for p in (work / "renditions").iterdir() if p.suffix == ".png") == ["000-logo.png", "001-other.png", "002-logo_2x.png"]
    manifest = json.loads((work / "manifest.json").read_text())
    assert len(manifest["renditions"]) == 3 and len(manifest["files"]) == 3
    before = bytes(spark.read.format("binaryFile").load(packed).first()["content"])
    again = write(spark, workdir.read(spark, folder), tmp_path / "same")
    assert bytes(spark.read.format("binaryFile").load(again).first()["content"]) == before
    (work / "renditions" / "001-other.png").write_bytes(codecs.png_write(solid(8, 8, (3, 3, 3, 255))))
    (work / "renditions" / "000-logo.png").unlink()  # a missing file counts as unedited
    _, got = pixels(spark, write(spark, workdir.read(spark, folder), tmp_path / "edited"))
    assert tuple(got["other.png"][0, 0]) == (3, 3, 3, 255) and tuple(got["logo.png"][0, 0]) == (200, 10, 20, 255)


def test_raw_and_skipped_previews(spark, packed):  # noqa: F811
    found = catalog.tables(spark, packed)
    assert workdir.files_of(found, previews=False).count() == 0
    raw = workdir.files_of(found, raw=True).collect()
    assert {r.role for r in raw} == {"payload"} and len(raw) == 3


def test_image_folders(spark, tmp_path):
    (tmp_path / "icon.imageset").mkdir()
    png = codecs.png_write(solid(4, 4, (1, 1, 1, 255)))
    for name in ("plain.png", "plain@2x.png", "icon.imageset/i2.png"):
        (tmp_path / name).write_bytes(png)
    (tmp_path / "icon.imageset" / "Contents.json").write_text(json.dumps({"images": [{"filename": "i2.png", "scale": "2x", "idiom": "ipad"}, {"scale": "1x"}, {"filename": "gone.png", "scale": "3x"}]}))
    files, missing = images.scan_images(spark, f"file://{tmp_path}")
    assert [r.file.rsplit("/", 1)[-1] for r in missing.collect()] == ["gone.png"]
    tables = catalogs.pack(files)
    keys = {r["name"]: dict(r["key"]) for r in tables["renditions"].collect()}
    assert {n: (k["identifier"], k["scale"], k.get("idiom", 0)) for n, k in keys.items()} == {"icon@2x.png": (1, 2, 2), "plain.png": (2, 1, 0), "plain@2x.png": (2, 2, 0)}
    single, _ = images.scan_images(spark, f"file://{tmp_path}/plain.png")
    assert single.count() == 1


def test_files_are_not_listed_to_be_read(spark, packed, tmp_path, monkeypatch):  # noqa: F811
    folder, load = f"file://{tmp_path}/deep [1]/in", DataFrameReader.load
    workdir.write(catalog.tables(spark, packed), f"file://{tmp_path}/work")
    (tmp_path / "deep [1]" / "in").mkdir(parents=True)
    (tmp_path / "work" / "tiny.car").rename(tmp_path / "deep [1]" / "in" / "tiny.car")
    work = tmp_path / "deep [1]" / "in" / "tiny.car"
    (work / "renditions" / "001-other.png").write_bytes(codecs.png_write(solid(8, 8, (3, 3, 3, 255))))
    read = []
    monkeypatch.setattr(DataFrameReader, "load", lambda *a, **k: read.append(a) or load(*a, **k))
    for place in (folder, f"{folder}/tiny.car", f"file://{tmp_path}"):
        found = workdir.read(spark, place)
        shown = {tuple(r["rgba"][:4]) for r in catalogs.bitmaps(found["renditions"]).collect()}
        assert (3, 3, 3, 255) in shown and (200, 10, 20, 255) in shown
    assert not read  # Spark's driver lists all files of a folder that it loads
    found = workdir.listed(spark, f"file://{tmp_path}").collect()
    assert {r.file for r in found} >= {"deep [1]/in/tiny.car/renditions/001-other.png"}


def test_stores_that_only_spark_reaches(spark, packed, tmp_path, monkeypatch):  # noqa: F811
    folder = f"file://{tmp_path}/work"
    workdir.write(catalog.tables(spark, packed), folder)
    (tmp_path / "work" / "tiny.car" / "renditions" / "001-other.png").write_bytes(codecs.png_write(solid(8, 8, (3, 3, 3, 255))))
    for module in (workdir, workspace):
        monkeypatch.setattr(module, "by_arrow", lambda folder: None)
    shown = {tuple(r["rgba"][:4]) for r in catalogs.bitmaps(workdir.read(spark, folder)["renditions"]).collect()}
    assert (3, 3, 3, 255) in shown and (200, 10, 20, 255) in shown


def test_manifests_in_any_layout():
    manifest = {"car_info": {"a": "x]},"}, "facets": [{"n": 1}, {"n": [2, "]"]}], "appearances": [], "other": None, "files": [{"f": "{"}]}
    want = [("car_info", {"a": "x]},"}), ("facets", {"n": 1}), ("facets", {"n": [2, "]"]}), ("files", {"f": "{"})]
    for text in (json.dumps(manifest), json.dumps(manifest, indent=2), "{}"):
        assert [(n, json.loads(t)) for n, t in workdir._split(text)] == (want if len(text) > 2 else [])
