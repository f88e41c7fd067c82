"""Streaming jobs around the batch operators: obfuscation, session memory, running counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.operators.context import COMMON_WORDS, LEARN_CAP, LEARN_KEEP, LEARNABLE_DETECTORS
from veilframe.operators.examples import is_doc_example
from veilframe.operators.mapping import MAPPING_COLUMNS
from veilframe.plans.obfuscate import Config, obfuscate

STORE_SCHEMA = "tenant string, real string, fake string, category string, seed bigint, first_seen bigint, batch bigint"
SUBNET_SCHEMA = "tenant string, real_net bigint, prefix_len int, fake_net bigint, batch bigint"


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a table written batch by batch, of batches before a given one.

    A table that is not there yet is empty; any other failure to read it is an error, never an empty store.
    """
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table if before is None else table.filter(F.col("batch") < before)


def streaming_obfuscate(docs: DataFrame, config: Config, folder: str,
                        sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Obfuscate a stream of (tenant, doc_id, text) against a growing store.

    Each micro-batch reads the mappings and subnet blocks of earlier batches, mints what is new and writes
    its own folder ``batch=<id>``.  A repeated batch overwrites only that folder, so retries mint the same.
    One query per tenant set is the single writer that collision checks and subnet blocks need.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            store = stored(spark, f"{folder}/store", STORE_SCHEMA, batch_id).select(*MAPPING_COLUMNS)
            blocks = stored(spark, f"{folder}/subnets", SUBNET_SCHEMA, batch_id).drop("batch")
            result = obfuscate(batch, config, store, blocks)
            new = result.mapping.join(store.select("tenant", "real"), ["tenant", "real"], "left_anti")
            new.withColumn("first_seen", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/store/batch={batch_id}")
            if result.subnets is not None:
                fresh = result.subnets.join(blocks, ["tenant", "real_net", "prefix_len"], "left_anti")
                fresh.select("tenant", "real_net", "prefix_len", "fake_net").write.mode("overwrite").parquet(f"{folder}/subnets/batch={batch_id}")
            sink(result.docs, batch_id)
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(run)


def session_learned(entities: DataFrame, cap: int = LEARN_CAP, keep: int = LEARN_KEEP) -> DataFrame:
    """Streaming: values a session learns, emitted when first learned (session, value, category, first_seq).

    State is one session's memory; above ``cap`` only the newest ``keep`` stay.  Another session starts empty.
    """
    import pandas as pd

    common, learnable = set(COMMON_WORDS), set(LEARNABLE_DETECTORS)
    candidates = entities.filter(~is_doc_example("value", "category") & (F.col("confidence") >= 0.80) & (F.length("value") >= 3))

    def step(key, batches, state: GroupState):
        known = dict.fromkeys(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["seq", "start"], kind="stable")
        out = []
        for value, category, detector, seq in zip(rows["value"], rows["category"], rows["detector"], rows["seq"]):
            if (detector in learnable or category == "hostname") and value.lower() not in common and value not in known:
                known[value] = None
                out.append((key[0], value, category, int(seq)))
        if len(known) > cap:
            known = dict.fromkeys(list(known)[-keep:])
        state.update((list(known),))
        yield pd.DataFrame(out, columns=["session", "value", "category", "first_seq"])

    return candidates.groupBy("session").applyInPandasWithState(
        step, "session string, value string, category string, first_seq bigint", "known array<string>", "append", GroupStateTimeout.NoTimeout)


def running_stats(entities: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entities by event-time window and category; streaming or batch (ts, category)."""
    return entities.withWatermark("ts", late).groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "category").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "n")


def session_stats(entities: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Entities per user session: a pause longer than ``gap`` starts a new one (user, ts)."""
    return entities.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user").agg(F.count(F.lit(1)).alias("n")).select(
        "user", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
