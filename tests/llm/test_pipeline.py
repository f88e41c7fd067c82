"""Stages of the corpus pipeline against plain versions."""

import json
import zlib
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm.test_operators import linked_classes, pack_is_valid
from veilframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs
        if name in ("quality classifier", "toxicity"):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "near-dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            root = linked_classes(texts, 5)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d in texts if root[d] == d)
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "best-fit packing":
            pack_is_valid(before.collect(), docs.collect())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.doc_id for r in kept["quality classifier"].collect() if r.doc_id in labels]
    assert sum(labels[d].quality for d in good) > 0.9 * len(good)


def test_run_has_the_rows_of_the_last_stage(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_dedup_stage_goes_by_rows(spark):
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(1, near, "a"), (2, near + " more", "b"), (2, "a text of its own that nobody else has", "c"), (None, near, "d"), (None, "no id and no copy", "e"), (3, None, "f"), (3, "", "g"), (4, near, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__row", F.lit(1)).withColumn("kept", F.lit(True))
    out = cp.dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.source for r in out.collect()) == ["a", "c", "e", "f", "g"]
    assert cp.dedup_stage(spark, docs.filter("false"), SF).collect() == []


def test_filter_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "x", None, None, 1), (-4, "🙂 " * 40_000, "en", "s", 80_000)], docs.schema)
    rows = docs.limit(40).unionByName(odd).unionByName(odd).withColumn("__score", F.lit("clash"))
    for stage in (cp.quality_stage, cp.toxicity_stage):
        for table in (rows, rows.filter("false")):
            out = stage(spark, table, SF)
            got = [r.doc_id for r in out.collect()]
            assert sorted(out.columns) == sorted(rows.columns) and len(got) <= table.count()
            assert all(got.count(d) in (0, 2) for d in (-1, -2, -4))  # equal rows share a fate
