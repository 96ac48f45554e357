from __future__ import annotations

from kilnwork.operators import catalogs
from kilnwork.sources import catalog, codecs
from kilnwork.streaming import folder
from tests.test_catalog import solid, write


def test_arriving_catalogs(spark, tmp_path):
    def add(name: str, count: int) -> None:
        images = spark.createDataFrame([(f"i{k}.png", codecs.png_write(solid(4, 4, (k, k, k, 255)))) for k in range(count)], "file string, bytes binary")
        write(spark, catalogs.pack(images, name), tmp_path / "in")

    def run() -> dict:
        stream = folder.running_census(folder.arriving(spark, f"file://{tmp_path}/in"))
        query = stream.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r.kind, r.compression): r.n for r in spark.table("seen").collect()}

    add("one.car", 2)
    assert run() == {("image", "zlib"): 2}
    add("two.car", 3)
    assert run() == {("image", "zlib"): 5}
    assert catalog.read_catalog(spark, f"file://{tmp_path}/in").count() == 5
