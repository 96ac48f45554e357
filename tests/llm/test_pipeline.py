"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from kilnwork.llm import queries
from kilnwork.llm.shared import stored
from tests.conftest import DATA
from tests.llm import brute, cases
from tests.llm.test_operators import check_pieces
from tests.oracle import rows, views

SF = str(DATA / "sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        done, _ = stored(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert done.columns == columns and done.schema == docs.schema
        after = {r.doc_id: r.text for r in done.collect()}
        if name == "quality_rules":
            stats = {i: brute.quality(t) for i, t in before.items()}
            failed = {i for i, (n, _, _, _, r) in stats.items() if n < 20 or 100 * r > 30 * n}
            assert not failed & set(after) and len(after) > 0.8 * (len(before) - len(failed))
        elif name == "line_dedup":
            assert after == {i: w[2] for i, w in brute.line_dedup(before).items()}
        elif name == "near_dedup":
            groups = brute.components({i: brute.shingles(t, 5) for i, t in before.items()}, 4, 5)
            assert set(after) == {i for i, root in groups.items() if i == root}
        elif name == "benchmark_decontamination":
            items = {r.item_id: brute.item_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            held = {i for i, t in before.items() for own in [brute.item_shingles(t)] if any(s and 5 * len(s & own) >= 4 * len(s) for s in items.values())}
            assert set(after) == set(before) - held and held
        docs = done
    pieces = queries.packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), 1)
    check_pieces(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    """Nulls, empty and repeated rows, ties and clashing columns through every stage; no stage makes rows or columns up."""
    clashing = ["kept_id", "slot", "id", "row", "tie", "item_id", "bucket", "shard", "target", "trusted", "line_dedup", "copy"]
    docs = cases.documents(spark)
    for name in clashing:
        docs = docs.withColumn(name, F.lit("clash")) if name not in docs.columns else docs
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= left
            left = docs.count()
        if name == "quality_rules":
            stats = [brute.quality(r[1]) for r in cases.rows()]
            assert left <= sum(n >= 20 and 100 * again <= 30 * n for n, _, _, _, again in stats) and left > 0
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.where("doc_id is not null").collect()]
            assert len(ids) == len(set(ids)) and 10 not in ids
    assert docs.count() > 0
    docs = cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_sql(spark):
    con = views(SF)
    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(sql).df()), name
