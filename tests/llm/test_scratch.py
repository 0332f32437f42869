"""Stored tables go with the scope that a result was written in; the pipeline on rows of every odd kind."""

import os

import corpus_pipeline as C
import pytest
from gradelake.llm.queries import QUERIES
from gradelake.sources import shared

from tests.llm.test_edge_cases import docs

SF = "/root/testdata/sf0.001"


def stored_now(spark):
    root = f"{shared.shared_dir(spark)}/gradelake-{spark.sparkContext.applicationId}".removeprefix("file://")
    return {d for d in os.listdir(root) if os.listdir(f"{root}/{d}")} if os.path.isdir(root) else set()


@pytest.mark.parametrize("name", ["op5_url_filter", "op9_embedding_near_dedup", "op11_spelling_variants", "op13_nnls_packing"])
def test_nothing_stays_after_a_scope(spark, tmp_path, name):
    before = stored_now(spark)
    with shared.scope(spark):
        QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
        assert stored_now(spark) > before
    assert stored_now(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_run_equals_its_stages_and_takes_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1), (5, 1), (4, 0), (None, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    with shared.scope(spark):
        got = sorted(tuple(r) for r in C.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect() if r.doc_id is not None)
        step = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in C.STAGES:
            step = stage(spark, step, folder)
        assert got == sorted(tuple(r) for r in step.select("doc_id", "piece", "start", "length", "ids_crc32").collect() if r.doc_id is not None)
    empty = str(tmp_path / "none")
    docs(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    with shared.scope(spark):
        assert C.run(spark, empty).count() == 0
