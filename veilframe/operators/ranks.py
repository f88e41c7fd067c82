"""Exact ranks over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.session import materialize


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by (key, order), with the partition number stored: retries see the same layout."""
    return materialize(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__pid", F.spark_partition_id()), "ranged")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, per key in the given order, for keys of any size.

    Each partition sums its own rows and adds the sums of the key's earlier partitions, a table of at most
    partitions x keys-per-boundary rows.
    """
    ranged = _ranged(df.withColumn("__v", value), keys, order)
    sums = ranged.groupBy(*keys, "__pid").agg(F.sum("__v").alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__pid", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    before = W.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("__local", F.coalesce(F.sum("__v").over(before), F.lit(0))).join(offsets, [*keys, "__pid"])
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("bigint")).drop("__pid", "__local", "__before", "__v")
    )


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``row_number`` per key in the given order, for keys of any size."""
    return running_total(df, keys, order, F.lit(1), out).withColumn(out, F.col(out) + 1)
