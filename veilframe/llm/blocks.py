"""Vectors against a query set, block by block: every (query block, shard) pair is one group of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.session import materialize

SHARD, BLOCK = 8192, 4096


def clean_vectors(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id, x): vectors without null or non-finite components (and not zero, if asked), one per id, the smallest."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if nonzero:
        good = good & F.exists(x, lambda v: v != 0)
    return df.filter(good).select(F.col(key).cast("long").alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))


def in_blocks(vectors: DataFrame, query: Column, search, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``search(queries, shard)`` on each pair of a query block and a shard of all vectors, both pandas frames (id, x).

    Shards and blocks are cut by a hash of the id, so their sizes are even. Each vector is sent once per query block,
    each query once per shard.
    """
    table = materialize(vectors, "vectors")
    n, q = table.count(), table.filter(query).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-q // block))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = table.withColumn("s", (h % shards).cast("int")).withColumn("b", numbers(blocks))
    left = table.filter(query).withColumn("b", ((h / F.lit(shards)).cast("long") % blocks).cast("int")).withColumn("s", numbers(shards))
    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards, ranked from 1, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
