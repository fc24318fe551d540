"""The pipeline's stages, each against its operator's meaning on what the stage before kept."""

from __future__ import annotations

import corpus_pipeline as P
from voxframe.llm import neardup

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    start = docs.count()
    for name, stage in P.STAGES:
        out = stage(spark, docs, DIR).cache()
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        docs = out
    before, kept = seen["quality"]
    assert before.join(kept, "doc_id", "left_anti").count() == start - kept.count() > 0
    before, kept = seen["near_duplicates"]
    classes = {r["class_id"] for r in neardup.near_duplicate_classes(before).collect()}
    assert {r["doc_id"] for r in kept.collect()} == classes and kept.count() == len(classes)
    before, kept = seen["personal_data"]
    assert kept.count() == before.count() and kept.filter(r"text rlike '@mail[0-9]+\\.example\\.com'").count() == 0
    before, kept = seen["mixing"]
    assert kept.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    before, kept = seen["packing"]
    assert kept.filter("piece = 0").count() == before.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
