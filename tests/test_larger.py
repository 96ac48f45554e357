"""Queries on larger keys than the tables hold, against their SQL."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork import catalogue
from kilnwork.sources import codecs
from tests.conftest import DATA
from tests.oracle import rows, views

SMALL = DATA / "sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory) -> str:
    """The smallest tables, with each part a second time in size 5 under a key that is 65,000 higher."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(SMALL):
        if name != "part.parquet":
            os.symlink(SMALL / name, folder / name)
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.unionAll(part.withColumns({"p_partkey": part["p_partkey"] + 65000, "p_size": F.lit(5)})).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["asset_sizes", "gradient_stops", "merge_data", "merge_outcomes"])
def test_parts_65000_keys_apart(spark, repeated, name):
    got = rows(catalogue.QUERIES[name](spark, repeated).toPandas())
    want = rows(views(repeated).execute(catalogue.ORACLES[name]).df())
    assert got == want
    assert want[1]


@pytest.fixture(scope="module")
def distant(spark, tmp_path_factory) -> str:
    """The smallest tables, with each part a second time in size 5 under a key that is 2^32 higher."""
    folder = tmp_path_factory.mktemp("distant")
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.unionAll(part.withColumns({"p_partkey": part["p_partkey"] + 2**32, "p_size": F.lit(5)})).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["gradient_stops", "merge_data", "merge_outcomes"])
def test_keys_past_32_bits(spark, distant, name):
    got = rows(catalogue.QUERIES[name](spark, distant).toPandas())
    want = rows(views(distant).execute(catalogue.ORACLES[name]).df())
    assert got == want
    assert want[1]


def test_merge_data_of_keys_that_brands_share(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_size", F.lit(5))
    part.unionAll(part.withColumn("p_brand", F.concat("p_brand", F.lit("b")))).write.parquet(f"{tmp_path}/part.parquet")
    got = rows(catalogue.QUERIES["merge_data"](spark, str(tmp_path)).toPandas())
    want = rows(views(str(tmp_path)).execute(catalogue.ORACLES["merge_data"]).df())
    assert got == want
    assert want[1]


@pytest.mark.parametrize("name", ["default_codec", "quantized_codec"])
def test_images_are_dealt_to_all_cores(spark, name):
    assert catalogue.QUERIES[name](spark, str(SMALL)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lattice_is_searched_whole():
    some = np.random.default_rng(3).integers(0, 256, (500, 3))
    some[:8] = [(r, g, b) for r in (0, 255) for g in (0, 255) for b in (0, 255)]
    found = codecs.from_lattice(codecs.to_lattice(some))
    assert found.min() >= 0 and found.max() <= 255 and np.abs(found - some).max() <= 1


def test_boxes_are_weighed_once(monkeypatch):
    calls, plain = [], np.ptp
    monkeypatch.setattr(codecs.np, "ptp", lambda *a, **k: calls.append(1) or plain(*a, **k))
    colours = np.unique(np.random.default_rng(5).integers(0, 256, (1024, 4)), axis=0)
    assert len(codecs.median_cut(colours, np.ones(len(colours), np.int64))) == 256
    assert len(calls) < 1000  # two boxes and a channel for each of 255 cuts
