"""The whole job over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import KEYS, documents
from veilframe.operators.rules import named
from veilframe.plans.obfuscate import Config, Result, obfuscate

CORE = ("email", "ipv4", "phone_us", "credit_card")


def run_core(spark: SparkSession, sf_dir: str, **changes) -> Result:
    settings = {"keys": KEYS, "rules": named(*CORE), "context": False, "code": False, "include_doc_examples": True, **changes}
    return obfuscate(documents(spark, sf_dir), Config(**settings))


def obfuscated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one replaced entity, and their number."""
    result = run_core(spark, sf_dir)
    counts = result.entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"))
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return result.docs.join(counts, "doc_id").join(lang, "doc_id").select("doc_id", "lang", "n_entities", "text_out")
