"""The command line, from images to a catalog, a working folder and back."""

from __future__ import annotations

import numpy as np
import pytest

from kilnwork import __main__ as command
from kilnwork.operators import catalogs, workdir
from kilnwork.sources import catalog, codecs


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    image = np.full((4, 4, 4), 255, np.uint8)
    image[..., 0] = 9
    (tmp_path / "in/icon@2x.png").write_bytes(codecs.png_write(image))
    at = lambda name: f"file://{tmp_path}/{name}"
    command.main(["pack", at("in"), at("packed"), "--platform", "macos"], spark)
    command.main(["info", at("packed"), "--renditions"], spark)
    shown = capsys.readouterr().out
    assert "icon@2x.png" in shown and "macos" in shown
    command.main(["decompile", at("packed"), at("work")], spark)
    png = next((tmp_path / "work").rglob("*.png"))
    image[..., 1] = 77
    png.write_bytes(codecs.png_write(image))
    command.main(["compile", at("work"), at("built")], spark)
    command.main(["clone-asset", at("built"), at("cloned"), "--from", "icon", "--to", "brand"], spark)
    found = catalog.tables(spark, at("cloned"))
    assert sorted(r["name"] for r in found["facets"].collect()) == ["brand", "icon"]
    assert all(bytes(r["rgba"])[:2] == b"\x09\x4d" for r in catalogs.bitmaps(found["renditions"]).collect())
    assert found["car_info"].first()["metadata"] == ["", "15.0", "macos", "kilnwork"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no PNG"):
        command.main(["pack", at("empty"), at("none")], spark)
    with pytest.raises(SystemExit):
        command.main(["decompile", at("packed"), at("w"), "--raw", "--no-previews"], spark)
    with pytest.raises(ValueError, match="choose"):
        workdir.decompile(found, raw=True, previews=False)
