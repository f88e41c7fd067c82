"""Rewriting texts at known spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from veilframe.functions.text import redact_masked
from veilframe.session import materialize

# One forward pass: the text between two edits is cut once, whatever their number.
SPLICE = (
    "concat(array_join(transform(__e, (x, i) -> concat(substring(text, case when i = 0 then 1 else __e[i - 1].end + 1 end, "
    "x.start - case when i = 0 then 0 else __e[i - 1].end end), x.repl)), ''), substring(text, element_at(__e, -1).end + 1))"
)


def own_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Docs whose ``doc_id`` stands for one row each, and the caller's ids where they did not.

    Ids that repeat (other tenants, equal lines of a file) or are null are replaced by row numbers of a written copy, so
    that no offset, group or join mixes two texts or misses one. The test reads ids only.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs, None
    rows = materialize(docs.withColumn("__own", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return rows.drop("__own"), rows.select("doc_id", "__own")


def own_ids(df: DataFrame, own: DataFrame | None) -> DataFrame:
    """The caller's ids in the place of row numbers."""
    if own is None:
        return df
    return df.join(own, "doc_id").withColumn("doc_id", F.col("__own")).select(*df.columns)


def splice(docs: DataFrame, edits: DataFrame, out: str = "text_out") -> DataFrame:
    """Replace spans (doc_id, start, end, repl) that do not overlap; texts without edits pass through."""
    per_doc = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "repl"))).alias("__e"))
    joined = docs.join(per_doc, "doc_id", "left")
    return joined.withColumn(out, F.when(F.col("__e").isNull(), F.col("text")).otherwise(F.expr(SPLICE))).drop("__e")


def redact_stats(entities: DataFrame) -> DataFrame:
    """Column ``placeholder``: [CATEGORY-n], n counted per text and category in reading order."""
    n = F.row_number().over(W.partitionBy("doc_id", "category").orderBy("start"))
    return entities.withColumn("placeholder", F.concat(F.lit("["), F.upper("category"), F.lit("-"), n.cast("string"), F.lit("]")))


def replacements(entities: DataFrame, mapping: DataFrame, level: str = "full") -> DataFrame:
    """Entities joined with their stand-in (``fake``) and the text to write (``repl``)."""
    joined = entities.join(mapping.select("tenant", F.col("real").alias("value"), "fake"), ["tenant", "value"])
    if level == "masked":
        return joined.withColumn("repl", redact_masked(F.col("value"), F.col("category")))
    if level == "stats":
        return redact_stats(joined).withColumnRenamed("placeholder", "repl")
    return joined.withColumn("repl", F.col("fake"))
