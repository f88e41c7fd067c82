"""Training corpus from ``documents``: quality, toxicity, near-duplicates, mixture, packed sequences."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import minhash, mixing, packing, quality, queries, toxicity
from veilframe.session import materialize, shared_dir


def _scored(docs: DataFrame, score, keep) -> DataFrame:
    """Rows whose score passes; columns of the input stay as they are, whatever their names."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return score(docs, name).filter(keep(F.col(name))).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. A null text is judged as an empty one, equal texts alike."""
    model = quality.train(queries.labelled(spark, sf_dir, "quality", 4, 2))
    return _scored(docs, lambda d, out: quality.score_quality(d, model, out=out), lambda s: s >= queries.THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. A null text is judged as an empty one, equal texts alike."""
    model = toxicity.train(queries.labelled(spark, sf_dir, "toxic", 3, 1))
    return _scored(docs, lambda d, out: toxicity.score_toxicity(d, model, out=out), lambda s: s < queries.THRESHOLD)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one of smallest doc_id.

    Goes by rows, numbered in a written copy: rows that share an id are documents of their own, a null id comes last,
    of rows with one id the first stays. Null, empty and blank texts are nobody's copy and stay.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = minhash.near_duplicates(numbered, key=row).select(row, F.col("component_id").alias("__class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    stay = classes.join(numbered.select(row, "doc_id"), row).groupBy("__class").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that expected tokens by language meet the wanted shares."""
    mixed = mixing.mix(docs, queries.mix_model(spark, sf_dir), queries.MIX)
    return mixing.apply_rates(mixed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 1024."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("toxicity", toxicity_stage), ("near-dedup", dedup_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]
#: Learned models and packing are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip(os.sep)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
