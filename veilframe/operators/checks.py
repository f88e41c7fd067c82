"""Checks of finished jobs: nothing real left, everything restored, counts and shapes as expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.operators.literals import match_literals

FAKE_V4 = r"(?<!\w)100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3}(?!\w)"
FAKE_V6 = r"(?<!\w)fd00:[0-9a-fA-F:]+"
FAKE_V4_RANGE = r"(?i)(?<!\w)100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.[x\d]+\.[x\d]+|\S*/\d+)"
E164 = r"\+[1-9]\d{6,14}"


def not_visible(texts: DataFrame, reals: DataFrame) -> DataFrame:
    """Real values (tenant, value) that still stand in texts (tenant, doc_id, text): empty when all is well."""
    hits = match_literals(texts, reals.select("tenant", F.col("value").alias("literal")).distinct(), by=("tenant",))
    return hits.select("tenant", "doc_id", "value", "start", "end")


def pattern_seen(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """How many texts show each expected shape."""
    counts = [F.count_if(F.col("text").rlike(p)).alias(f"c{i}") for i, p in enumerate(patterns)]
    one = texts.agg(*counts)
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("texts")) for i, p in enumerate(patterns)])
    return one.select(F.inline(rows)).withColumn("seen", F.col("texts") > 0)


def missing_values(restored: DataFrame, reals: DataFrame) -> DataFrame:
    """Real values (doc_id, value) that their restored text does not show."""
    return reals.join(restored.select("doc_id", "text"), "doc_id").filter(~F.expr("contains(text, value)")).select("doc_id", "value")


def entity_bounds(docs: DataFrame, entities: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Texts whose number of entities leaves the bounds."""
    counts = docs.select("doc_id").join(entities.groupBy("doc_id").count(), "doc_id", "left").select("doc_id", F.coalesce("count", F.lit(0)).alias("n"))
    return counts.filter((F.col("n") < low) | (F.lit(high is not None) & (F.col("n") > (high or 0))))


def missing_categories(entities: DataFrame, expected: list[str]) -> DataFrame:
    """Expected categories that were not found."""
    found = entities.agg(F.collect_set("category").alias("c"))  # a closed list of categories
    return found.select(F.explode(F.array_except(F.array(*[F.lit(e) for e in expected]), F.col("c"))).alias("category"))


def scan_fake_ranges(texts: DataFrame) -> DataFrame:
    """Traces of the fake address space: (kind, value, n)."""
    kinds = [("v4", FAKE_V4), ("v6", FAKE_V6), ("range", FAKE_V4_RANGE)]

    def tagged(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*[tagged(k, p) for k, p in kinds]))
    likely = texts.filter(F.col("text").contains("100.") | F.col("text").contains("fd00:"))
    return likely.select(F.inline_outer(found)).filter("kind is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def roundtrip_errors(original: DataFrame, restored: DataFrame) -> DataFrame:
    """Texts that did not come back as they were."""
    o, r = original.select("doc_id", F.col("text").alias("a")), restored.select("doc_id", F.col("text").alias("b"))
    return o.join(r, "doc_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id")


def invalid_e164(texts: DataFrame) -> DataFrame:
    """Plus-numbers that are no valid international phone number once separators are removed."""
    numbers = F.regexp_extract_all("text", F.lit(r"\+\d[\d\s().-]{5,}\d"), F.lit(0))
    rows = texts.filter(F.col("text").contains("+")).select("doc_id", F.explode_outer(numbers).alias("phone")).filter("phone is not null")
    return rows.filter(~F.regexp_replace("phone", r"[\s().-]", "").rlike(f"^{E164}$"))
