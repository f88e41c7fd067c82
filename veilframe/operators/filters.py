"""Which entities are replaced: thresholds, exemptions, allow lists, known stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.sql import one_of, sql_text


def min_confidence(entities: DataFrame, threshold: float) -> DataFrame:
    return entities.filter(F.col("confidence") >= threshold)


def exempt_categories(entities: DataFrame, categories: list[str] | DataFrame) -> DataFrame:
    """Drop exempt categories; a table may exempt per tenant: (tenant, category) or (category)."""
    if isinstance(categories, DataFrame):
        return entities.join(categories, [c for c in categories.columns if c in ("tenant", "category")], "left_anti")
    return entities.filter(~F.col("category").isin(*categories)) if categories else entities


def allowed_sql(values: list[str], column: str = "value") -> str:
    """Is a value on the allow list?  Exact entries by set, wildcard entries as one expression."""
    wild = [v for v in values if "*" in v or "?" in v]
    exact = [v for v in values if v not in wild]
    tests = [one_of(column, exact)] if exact else []
    if wild:
        def body(v: str) -> str:
            return "".join({"*": ".*", "?": "."}.get(c, ("\\" + c) if c in ".+^${}()|[]\\" else c) for c in v)
        tests.append(f"{column} rlike {sql_text('(?i)^(?:' + '|'.join(map(body, wild)) + ')$')}")
    return "(" + (" or ".join(tests) or "false") + ")"


def allowlist(entities: DataFrame, values: list[str] | DataFrame) -> DataFrame:
    """Drop allowed values: a list with exact and wildcard entries, or a table of exact values."""
    if isinstance(values, DataFrame):
        return entities.join(values.select("value").distinct(), "value", "left_anti")
    return entities.filter(~F.expr(allowed_sql(values)))


def drop_known_fakes(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values that are already stand-ins are not replaced again."""
    known = mapping.select("tenant", F.col("fake").alias("value")).distinct()
    return entities.join(known, ["tenant", "value"], "left_anti")


def drop_short(entities: DataFrame) -> DataFrame:
    return entities.filter(F.length("value") > 2)


def with_drop_reason(entities: DataFrame, threshold: float = 0.0, exempt: list[str] | None = None,
                     allow: list[str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Column ``drop_reason``: the first filter that an entity fails, null when it is to be replaced."""
    exempted: Column = F.col("category").isin(*exempt) if exempt else F.lit(False)
    known = F.lit(False)
    if mapping is not None:
        fakes = mapping.select("tenant", F.col("fake").alias("value"), F.lit(True).alias("__fake")).distinct()
        entities = entities.join(fakes, ["tenant", "value"], "left")
        known = F.coalesce("__fake", F.lit(False))
    reason = (
        F.when(F.col("confidence") < threshold, "below_threshold").when(exempted, "exempted")
        .when(F.expr(allowed_sql(allow or [])), "allowlisted").when(known, "already_obfuscated")
        .when(F.length("value") <= 2, "too_short"))
    return entities.withColumn("drop_reason", reason).drop("__fake")


def filter_stats(judged: DataFrame) -> DataFrame:
    """Per text: detected, replaced, and dropped by reason (short values are counted nowhere)."""
    reason = F.col("drop_reason")
    return judged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_detected"), F.count_if(reason.isNull()).alias("replaced"),
        F.count_if(reason == "below_threshold").alias("below_threshold"), F.count_if(reason == "allowlisted").alias("allowlisted"),
        F.lit(0).cast("bigint").alias("doc_examples"), F.count_if(reason == "already_obfuscated").alias("already_obfuscated"),
        F.count_if(reason == "exempted").alias("exempted"))
