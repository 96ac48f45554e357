"""Catalog files: container, records, codecs, and the operations on their relations."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from kilnwork.operators import catalogs
from kilnwork.sources import catalog, codecs, records
from kilnwork.sources.blockstore import Store, StoreError, Writer


def solid(width: int, height: int, colour: tuple[int, int, int, int]) -> np.ndarray:
    return np.broadcast_to(np.array(colour, np.uint8), (height, width, 4)).copy()


# Container.


@pytest.mark.parametrize("count", [0, 1, 14, 15, 1000])
def test_trees(count):
    writer = Writer()
    pairs = [(f"{k:06d}".encode(), str(k).encode()) for k in range(count)]
    writer.tree("T", pairs, node_bytes=128)
    writer.tree("I", [(7 * k, b"v%d" % k) for k in range(count)], inline=True, node_bytes=128)
    store = Store(writer.finish())
    assert list(store.tree("T")) == pairs and list(store.inline_tree("I")) == [(7 * k, b"v%d" % k) for k in range(count)]
    assert list(store.tree("missing")) == []


def test_separators_are_last_keys():
    writer = Writer()
    writer.tree("T", [(f"{k:06d}".encode(), b"x") for k in range(100)], node_bytes=128)
    store = Store(writer.finish())
    root = store.block(struct.unpack_from(">I", store.named("T"), 8)[0])
    leaf, count = struct.unpack_from(">HH", root)
    keys = [store.block(struct.unpack_from(">II", root, 12 + 8 * k)[1]) for k in range(count)]
    assert not leaf and len(root) == 128 and keys[0] == b"000013" and keys[-1] == b"000099"


def test_bad_stores():
    writer = Writer()
    writer.put("A", b"abc")
    data = bytearray(writer.finish())
    at = struct.unpack_from(">I", data, 16)[0]
    unused = bytearray(data)
    unused[at + 12 : at + 20] = b"\xff" * 8
    assert Store(bytes(unused)).named("A") == b""
    for broken in (b"", b"BOMStore", bytes(data[:-10]), b"x" * 600):
        with pytest.raises(StoreError):
            Store(broken)


# Records.


def test_records_round_trip():
    h = records.CatalogHeader(974, 17, 3, 2, "m", "v", "0123456789abcdef" * 2, 1, 2, 1, 2)
    assert len(h.pack()) == 436 and records.CatalogHeader.parse(h.pack()) == h
    names = ["appearance", "identifier", "attr77"]
    assert records.parse_key_format(records.pack_key_format(names)) == names
    key = {"identifier": 256, "attr77": 1}
    raw = records.key_bytes(key, names)
    assert raw == b"\0\0\0\1\1\0" and records.key_of(raw, names) == key
    assert records.parse_facet(records.pack_facet(1, 2, key)) == (1, 2, key)
    assert records.parse_metadata(records.pack_metadata(["a", "b", "c", "d"])) == ["a", "b", "c", "d"]
    r = records.Rendition(1, 4, 8, 9, 200, records.pixel_format_code("GA8"), 1, 5, 12, b"n\xff", 1, 7, [(0x3EF, b"\x20\0\0\0"), (99, b""), (99, b"z")], b"payload")
    assert records.Rendition.parse(r.pack()) == r and records.Rendition.parse(r.pack()).stride_consistent()
    link = records.Link(4, 2, 8, 8, 12, {"element": 9, "identifier": 3})
    assert records.Link.parse(link.pack()) == link
    assert records.multisize_of(records.pack_multisize([(20, 20, 1), (40, 40, 2)])) == [(20, 20, 1), (40, 40, 2)]
    colour = records.Colour(1, [0.1, 1 / 3, 0.40799999237060547, 1.0], "linkColor", b"tail")
    assert records.Colour.parse(colour.pack()) == colour
    gradient = records.Gradient(1, 0, (0.0, 0.5, 1.0, 0.25), [(0.0, "a"), (0.5, "b"), (1.0, "c")], b"\1\2\3\4")
    assert records.Gradient.parse(gradient.pack()) == gradient
    assert [records.sniff(x) for x in (b"  <svg/>", b"\xff\xd8\xff\xe0", b"%PDF-1", b"\0\0\0\x18ftypheic", b"\0" * 20)] == ["svg", "jpg", "pdf", "heic", None]
    assert records.pixel_format_name(0x12345678) == "0x12345678" and records.pixel_format_code("0x12345678") == 0x12345678
    assert records.compression_name(42) == "42" and records.compression_code("42") == 42


# Codecs.


def test_premultiply_on_the_whole_grid():
    c, a = np.meshgrid(np.arange(256), np.arange(256))
    grid = np.stack([c, c, c, a], axis=-1).astype(np.uint8)
    pre = codecs.premultiply(grid)
    assert (pre[..., 0] == (c * a + 127) // 255).all()
    again = codecs.premultiply(codecs.unpremultiply(pre))
    assert (again == pre).all()


def test_residuals_and_colours():
    d = np.arange(-600, 600)
    assert (codecs.unfold(codecs.fold(d)) == d).all() and codecs.fold(np.array([-1, 0, 1])).tolist() == [3, 0, 2]
    cube = np.array([[r, g, b] for r in range(0, 256, 5) for g in range(0, 256, 5) for b in range(0, 256, 5)])
    back = codecs.from_lattice(codecs.to_lattice(cube))
    assert np.abs(back - cube).max() <= 1 and back.min() >= 0 and back.max() <= 255
    gray = np.repeat(np.arange(256)[:, None], 3, axis=1)
    assert (codecs.from_lattice(codecs.to_lattice(gray)) == gray).all()
    rng = np.random.default_rng(0)
    values = rng.integers(-300, 300, (9, 7, 3))
    residual, selectors = codecs.predict(values)
    assert (codecs.unpredict(residual, selectors) == values).all() and codecs.MEAN not in selectors and selectors[0] in (codecs.NONE, codecs.LEFT)
    assert codecs.unpredict(np.array([[[-2], [0]], [[0], [0]]]), np.array([codecs.NONE, codecs.MEAN])).ravel().tolist() == [-2, 0, -2, -1]  # floor


def test_run_lengths():
    assert codecs.rle_row(np.array([[1], [1], [1], [2], [3], [4], [4]], np.uint8)) == b"\3\0\0\x80\1" + b"\2\0\0\0\2\3" + b"\2\0\0\x80\4"
    clear = codecs.rle_encode(np.zeros((6, 5, 2), np.uint8))
    assert len(set(struct.unpack_from("<6I", clear, 12))) == 1 and codecs.rle_decode(clear, 2) == b"\0" * 60
    assert codecs.rle_decode(clear[:-1], 2) is None and codecs.rle_decode(struct.pack("<4I", 3, 2, 1, 16) + struct.pack("<I", 0x80000003) + b"\0", 1) is None


@pytest.mark.parametrize("pixel", ["ARGB", "GA8"])
def test_bitmaps(pixel):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (17, 24, 4), dtype=np.uint8)
    image[..., 3] = np.where(rng.random((17, 24)) < 0.2, 0, 255)
    image[image[..., 3] == 0] = 0
    if pixel == "GA8":
        image[..., 1] = image[..., 2] = image[..., 0]
    stride = codecs.row_stride(24, pixel)
    for name, chunked in (("uncompressed", False), ("zlib", False), ("zlib", True), ("rle", False)):
        payload = codecs.bitmap_encode(image, name, stride, pixel, chunked=chunked)
        assert (codecs.bitmap_decode(payload, 24, 17, stride, pixel) == image).all()
        assert codecs.compression_of(payload) == name
    planar = codecs.bitmap_decode(codecs.default_encode(image, pixel), 24, 17, stride, pixel)
    assert np.abs(codecs.premultiply(planar).astype(int) - codecs.premultiply(image)).max() <= (pixel == "ARGB")
    assert codecs.bitmap_decode(codecs.BITMAP + struct.pack("<3I", 2, 4, 3) + b"bvx", 24, 17, stride, pixel) is None  # no codec here
    assert codecs.infer_pixel_format(image) == pixel


def test_palettes():
    rng = np.random.default_rng(2)
    few = (rng.integers(0, 4, (16, 16, 4)) * 85).astype(np.uint8)
    assert (codecs.bitmap_decode(codecs.palette_encode(few), 16, 16, 64, "ARGB") == few).all()
    ramp = np.stack(np.meshgrid(np.arange(64) * 4, np.arange(64) * 4), axis=-1)
    many = np.concatenate([ramp, np.full((64, 64, 1), 60), np.full((64, 64, 1), 255)], axis=-1).astype(np.uint8)
    assert codecs.palette_encode(many) is None
    once = codecs.bitmap_decode(codecs.palette_encode(many, quantized=True), 64, 64, 256, "ARGB")
    assert np.abs(once.astype(int) - many).mean() < 12
    assert (codecs.bitmap_decode(codecs.palette_encode(once, quantized=True), 64, 64, 256, "ARGB") == once).all()


def test_wide_pixels():
    values = np.array([[0, 1, 2, 1], [0.5, 1 / 3, np.inf, 1], [np.nan, 0, 0, 1]], "<f2")
    rgba = codecs.rows_to_rgba(values.tobytes().ljust(32, b"\0"), 3, 1, 32, "RGBW")
    assert rgba[0].tolist() == [[0, 255, 255, 255], [128, 85, 255, 255], [0, 0, 0, 255]]
    gray = codecs.rows_to_rgba(struct.pack("<4H", 0x1200, 0xFFFF, 0, 0x80FF).ljust(32, b"\0"), 2, 1, 32, "GA16")
    assert gray[0].tolist() == [[0x12, 0x12, 0x12, 255], [0, 0, 0, 0x80]]


def test_png():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    assert (codecs.png_read(codecs.png_write(image)) == image).all() and codecs.png_read(b"no") is None


def test_interlaced_png():
    rng = np.random.default_rng(4)
    for width, height in ((1, 1), (5, 3), (13, 9), (16, 16)):
        image = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
        raw = b""
        for x0, y0, dx, dy in codecs._PASSES:
            part = image[y0::dy, x0::dx]
            if part.size:
                raw += b"".join(b"\0" + row.tobytes() for row in part)
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        assert (codecs.png_read(png) == image).all()


def test_raw_data_flag_is_never_set_over_other_bytes():
    assert codecs.raw_decode(codecs.raw_encode(b"", True)) == (b"", False) and codecs.raw_encode(b"abc", True)[4] == 0


# Operations.


def write(spark, parts, folder):
    catalog.save(catalog.build_catalogs(parts), f"file://{folder}")
    return f"file://{folder}"


def pixels(spark, folder):
    found = catalog.tables(spark, folder)
    images = {r.rid: np.frombuffer(bytes(r.rgba), np.uint8).reshape(r.height, r.width, 4) for r in catalogs.bitmaps(found["renditions"]).collect()}
    return found, {r["name"]: images[r["rid"]] for r in found["renditions"].collect() if r["rid"] in images}


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    files = [("a/logo.png", solid(24, 24, (200, 10, 20, 255))), ("a/logo@2x.png", solid(48, 48, (1, 2, 3, 255))), ("b/logo.png", solid(9, 9, (9, 9, 9, 255))), ("a/other.png", solid(8, 8, (77, 77, 77, 255)))]
    images = spark.createDataFrame([(f, codecs.png_write(i)) for f, i in files], "file string, bytes binary")
    return write(spark, catalogs.pack(images, "tiny.car"), tmp_path_factory.mktemp("packed"))


def test_pack_and_read(spark, packed):
    found, images = pixels(spark, packed)
    assert {n: (i.shape, tuple(i[0, 0])) for n, i in images.items()} == {"logo.png": ((24, 24, 4), (200, 10, 20, 255)), "logo@2x.png": ((48, 48, 4), (1, 2, 3, 255)), "other.png": ((8, 8, 4), (77, 77, 77, 255))}
    assert {r.name: r.attributes["identifier"] for r in found["facets"].collect()} == {"logo": 1, "other": 2}
    rows = {r["name"]: r for r in found["renditions"].collect()}
    assert rows["other.png"]["pixel_format"] == "GA8" and rows["logo.png"]["pixel_format"] == "ARGB" and rows["logo@2x.png"]["key"]["scale"] == 2
    counts = catalogs.census(found)
    assert counts["declared"].first()["agrees"] and counts["kind"].collect()[0]["n"] == 3 and len(counts["compression"].collect()) == 1
    assert catalogs.info(found).first()["by_kind"] == {"image": 3} and '"facets"' in catalogs.manifest(found).first()["manifest"]
    heads = catalog.read_catalog(spark, packed, "rendition_headers")
    assert "payload" not in heads.columns and heads.count() == 3


def test_write_is_a_fixpoint(spark, packed, tmp_path):
    before = spark.read.format("binaryFile").load(packed).first()["content"]
    again = write(spark, catalog.tables(spark, packed), tmp_path)
    assert bytes(spark.read.format("binaryFile").load(again).first()["content"]) == bytes(before)


def test_unknown_names_and_records_survive(spark, tmp_path):
    r = records.Rendition(name=b"odd", layout=1007, pixel_format=0xABCDEF01, tlvs=[(0x3FD, b"q"), (0x3E9, b"short")], payload=b"RTXT....", unknown_a=5, unknown_b=6)
    info = dict.fromkeys(records.CatalogHeader.__dataclass_fields__, 0) | {"main_version_string": "m", "version_string": "v", "uuid": "ab" * 16, "key_format": ["identifier"], "metadata": None, "extra_vars": {"MORE": b"kept"}}
    row = {"key": {"identifier": 300}, "version": 1, "flags": 0, "width": 0, "height": 0, "scale": 0, "pixel_format": "0xabcdef01", "color_space_id": 0, "modified": 0, "layout": 1007, "name_bytes": b"odd", "unknown_a": 5, "unknown_b": 6, "tlvs": [{"ord": k, "tag": t, "data": d} for k, (t, d) in enumerate(r.tlvs)], "payload": r.payload}
    (tmp_path / "odd.car").write_bytes(catalog.assemble(info, [], [], [], [{"key": 5, "value": b"b"}], [row]))
    found = catalog.tables(spark, f"file://{tmp_path}")
    got = found["renditions"].first()
    assert got["kind"] == "raw_payload" and got["pixel_format"] == "0xabcdef01" and [(t["tag"], bytes(t["data"])) for t in got["tlvs"]] == r.tlvs
    head = found["car_info"].first()
    assert {k: bytes(v) for k, v in head["extra_vars"].items()} == {"MORE": b"kept"} and head["metadata"] is None
    out = write(spark, found, tmp_path / "out")
    assert bytes(spark.read.format("binaryFile").load(out).first()["content"]) == (tmp_path / "odd.car").read_bytes()
    with pytest.raises(ValueError, match="one key"):
        catalog.assemble(info, [], [], [], [], [row, row])


def test_merge(spark, packed, tmp_path):
    found = catalog.tables(spark, packed)
    new, later = solid(24, 24, (5, 6, 7, 255)), solid(24, 24, (50, 60, 70, 255))
    entries = [(0, "logo", codecs.png_write(new)), (1, "logo", codecs.png_write(later)), (2, "logo", codecs.png_write(solid(5, 5, (0, 0, 0, 255)))), (3, "nobody", b"bytes"), (4, "icon", b"<svg/>"), (5, "paper", b"%PDF-1.4"), (6, "other", b"<svg/>"), (7, "icon", b"<svg id='2'/>"), (8, "other", codecs.png_write(solid(8, 8, (250, 0, 0, 255))))]
    done, report = catalogs.merge(found, spark.createDataFrame(entries, "ordinal long, name string, bytes binary"), add_missing=True)
    rows = {r.ordinal: (r.outcome, r.n) for r in report.collect() if r.outcome in ("replaced", "added", "unmatched")}
    assert rows == {0: ("replaced", 1), 1: ("replaced", 1), 2: ("unmatched", 0), 3: ("unmatched", 0), 4: ("added", 1), 5: ("added", 1), 6: ("unmatched", 0), 7: ("replaced", 1), 8: ("replaced", 1)}
    why = {(r.ordinal, r.outcome): r.n for r in report.collect()}
    assert why[0, "size mismatch"] == 1 and why[2, "size mismatch"] == 2 and why[6, "not data"] == 1 and (3, "size mismatch") not in why
    again, images = pixels(spark, write(spark, done, tmp_path))
    assert tuple(images["logo.png"][3, 3]) == (50, 60, 70, 255) and tuple(images["logo@2x.png"][0, 0]) == (1, 2, 3, 255) and tuple(images["other.png"][0, 0]) == (250, 0, 0, 255)
    assert {r["name"]: r["pixel_format"] for r in again["renditions"].collect()}["other.png"] == "ARGB"  # promoted
    assert {r.name: r.attributes["identifier"] for r in again["facets"].collect()} == {"logo": 1, "other": 2, "icon": 3, "paper": 4}
    icon = next(r for r in again["renditions"].collect() if r["name"] == "icon.svg")
    assert codecs.raw_decode(bytes(icon["payload"])) == (b"<svg id='2'/>", False) and icon["layout"] == 9 and icon["key"]["scale"] == 1
    second, report = catalogs.merge(again, spark.createDataFrame([(0, "icon", b"<svg>new</svg>")], "ordinal long, name string, bytes binary"))
    assert report.first()["outcome"] == "replaced" and codecs.raw_decode(bytes(next(r for r in second["renditions"].collect() if r["name"] == "icon.svg")["payload"]))[0] == b"<svg>new</svg>"
    sizes = {(r["name"], r["width"], r["height"]) for r in catalogs.replacement_sizes(found).collect()}
    assert sizes == {("logo", 24, 24), ("logo", 48, 48), ("logo@2x", 48, 48), ("other", 8, 8)}  # a name of its own resolves too


def test_merge_of_files_that_number_entries_alike(spark, packed, tmp_path):
    data = bytes(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(packed).first()["content"])
    for name in ("a.car", "b.car"):
        (tmp_path / name).write_bytes(data)
    found = catalog.tables(spark, f"file://{tmp_path}")
    a, b = sorted(r["path"] for r in found["car_info"].collect())
    fits, other = (codecs.png_write(solid(n, n, (5, 6, 7, 255))) for n in (8, 9))
    _, report = catalogs.merge(found, spark.createDataFrame([(a, 0, "other", fits), (b, 0, "other", other)], "path string, ordinal long, name string, bytes binary"))
    assert sorted((r.path or "", r.ordinal, r.name, r.outcome, r.n) for r in report.collect()) == [("", 0, "other", "unmatched", 0), (a, 0, "other", "replaced", 1), (b, 0, "other", "size mismatch", 1)]


def test_clone(spark, packed, tmp_path):
    found = catalog.tables(spark, packed)
    path = found["car_info"].first()["path"]
    image = solid(48, 48, (8, 8, 9, 255))
    done = catalogs.clone_asset(found, path, "logo", "brand", codecs.png_write(image))
    again, images = pixels(spark, write(spark, done, tmp_path))
    assert tuple(images["brand@2x.png"][0, 0]) == (8, 8, 9, 255) and tuple(images["brand.png"][0, 0]) == (200, 10, 20, 255) and tuple(images["logo@2x.png"][0, 0]) == (1, 2, 3, 255)
    assert {r.name: r.attributes["identifier"] for r in again["facets"].collect()} == {"logo": 1, "other": 2, "brand": 3}
    for source, target, png in (("none", "x", None), ("logo", "other", None), ("logo", "x", codecs.png_write(solid(3, 3, (0, 0, 0, 0))))):
        with pytest.raises(ValueError):
            catalogs.clone_asset(found, path, source, target, png)


def test_links_read_and_paint_bottom_up(spark, tmp_path):
    atlas = np.zeros((48, 16, 4), np.uint8)
    atlas[..., 0], atlas[..., 1], atlas[..., 3] = np.arange(16)[None, :], np.arange(48)[:, None], 255
    stride = codecs.row_stride(16, "ARGB")
    base = {"version": 1, "flags": 0, "scale": 100, "color_space_id": 1, "modified": 0, "unknown_a": 1, "unknown_b": 0}
    link = records.Link(4, 2, 8, 8, 12, {"element": 9, "identifier": 7})
    gone = records.Link(0, 0, 1, 1, 12, {"element": 9, "identifier": 99})
    rows = [
        base | {"key": {"element": 9, "identifier": 7}, "width": 16, "height": 48, "pixel_format": "ARGB", "layout": 1004, "name_bytes": b"atlas", "tlvs": [{"ord": 0, "tag": records.ROW_STRIDE, "data": stride.to_bytes(4, "little")}], "payload": codecs.bitmap_encode(atlas, "zlib", stride, "ARGB")},
        base | {"key": {"element": 1, "identifier": 8}, "width": 8, "height": 8, "pixel_format": "none", "layout": 1003, "name_bytes": b"part", "tlvs": [{"ord": 0, "tag": records.LINK_TAG, "data": link.pack()}], "payload": b""},
        base | {"key": {"element": 1, "identifier": 9}, "width": 1, "height": 1, "pixel_format": "none", "layout": 1003, "name_bytes": b"lost", "tlvs": [{"ord": 0, "tag": records.LINK_TAG, "data": gone.pack()}], "payload": b""},
    ]
    info = dict.fromkeys(records.CatalogHeader.__dataclass_fields__, 0) | {"main_version_string": "", "version_string": "", "uuid": "00" * 16, "key_format": ["element", "identifier"], "metadata": ["", "", "", ""], "extra_vars": {}}
    (tmp_path / "links.car").write_bytes(catalog.assemble(info, [], [], [], [], rows))
    found = catalog.tables(spark, f"file://{tmp_path}")
    offers = [(0, "part", codecs.png_write(solid(8, 8, (9, 8, 7, 255)))), (1, "part", codecs.png_write(solid(7, 8, (0, 0, 0, 255)))), (2, "lost", codecs.png_write(solid(1, 1, (0, 0, 0, 255)))), (3, "part", b"text")]
    done, report = catalogs.merge(found, spark.createDataFrame(offers, "ordinal long, name string, bytes binary"))
    assert {(r.ordinal, r.outcome, r.n) for r in report.collect()} == {(0, "replaced", 1), (1, "size mismatch", 1), (1, "unmatched", 0), (2, "shared atlas", 1), (2, "unmatched", 0), (3, "not data", 1), (3, "unmatched", 0)}
    landed = np.frombuffer(bytes(catalogs.bitmaps(done["renditions"]).first().rgba), np.uint8).reshape(48, 16, 4)
    assert (landed[38:46, 4:12] == (9, 8, 7, 255)).all() and (landed[:38] == atlas[:38]).all()
    with pytest.raises(ValueError, match="lost"):
        catalogs.merge_or_fail(found, spark.createDataFrame(offers[2:3], "ordinal long, name string, bytes binary"))
    assert catalogs.previews(found).select("ok", "total").first() == (2, 3)
    crop = catalogs.linked_images(found).collect()
    assert len(crop) == 1
    image = np.frombuffer(bytes(crop[0].rgba), np.uint8).reshape(8, 8, 4)
    assert tuple(image[0, 0]) == (4, 38, 0, 255)  # row 48 - 2 - 8
    edit = spark.createDataFrame([(crop[0].path, crop[0].rid, solid(8, 8, (255, 0, 255, 255)).tobytes())], "path string, rid int, rgba binary")
    painted = catalogs.bitmaps(catalogs.paste_links(found, edit)).first()
    got = np.frombuffer(bytes(painted.rgba), np.uint8).reshape(48, 16, 4)
    want = atlas.copy()
    want[38:46, 4:12] = (255, 0, 255, 255)
    assert (got == want).all()
    lost = catalogs.resolve_links(found).where("atlas_rid is null").collect()
    assert [r.target for r in lost] == [{"element": 9, "identifier": 99}]
    bad = spark.createDataFrame([(lost[0].path, lost[0].rid, b"\0" * 4)], "path string, rid int, rgba binary")
    with pytest.raises(Exception, match="no target"):
        catalogs.paste_links(found, bad).collect()
