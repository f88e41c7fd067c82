"""Streams over several micro-batches, against what their events say."""

import itertools

from pyspark.sql import functions as F

from veilframe.streaming import blocks as B

DELTA = "stream_id string, ts string, seq bigint, kind string, key int, sub int, text string, is_stop boolean"
RUNS = itertools.count()


def fed(spark, folder, batches, schema, more=lambda df: df):
    """A stream that reads one batch of rows after the other."""
    path = f"{folder}/in{next(RUNS)}"
    for rows in batches:
        df = more(spark.createDataFrame(rows, schema).coalesce(1))
        df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def block_rows(spark, tmp_path, batches):
    rows = [[(s, ts and f"2026-01-01 {ts}", seq, "block", 0, 0, text, text is None) for s, ts, seq, text in batch] for batch in batches]
    stream = fed(spark, tmp_path, rows, DELTA, lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")))
    out = f"{tmp_path}/out{next(RUNS)}"
    made = B.accumulate(stream)
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(made.schema).parquet(out).filter("text <> ''").collect()
    return sorted((r.stream_id, r.text, r.closed) for r in got)


def test_interleaved_streams_lose_nothing(spark, tmp_path):
    got = block_rows(spark, tmp_path, [
        [("b", "00:03:00", 0, "B-one ")],
        [("a", "00:11:00", 0, "A-one ")],
        [("a", "00:12:00", 1, "A-two ")],  # Spark drops by the watermark of the batch before
        [("b", "00:05:00", 1, "B-two"), ("b", "00:05:00", 2, None)],
        [("a", "00:12:30", 2, "A-three"), ("a", "00:12:30", 3, None)]])
    assert got == [("a", "A-one A-two A-three", "stop"), ("b", "B-one B-two", "stop")]


def test_lagging_and_idle_streams(spark, tmp_path):
    got = block_rows(spark, tmp_path, [
        [("a", "10:00:00", 0, "A-one ")],
        [("b", "00:03:00", 0, "B-one "), ("n", None, 0, "N-one")],
        [("a", "10:01:00", 1, "A-two ")],
        [("b", "00:05:00", 1, "B-two"), ("b", "00:05:00", 2, None), ("n", None, 1, None)],
        [("c", "11:00:00", 0, "C-one")],
        [("c", "11:05:00", 1, " C-two"), ("c", "11:05:00", 2, None)],
        [("d", "12:00:00", 0, None)]])
    assert got == [("a", "A-one A-two ", "timeout"), ("b", "B-one B-two", "stop"), ("c", "C-one C-two", "stop"), ("n", "N-one", "stop")]


def test_holdback_over_batches_and_many_stand_ins(spark, tmp_path):
    few = [("", "Al", "Person-1"), ("", "Bo", "Person-12"), ("", "Cy", "-1Q"), ("", "Di", "é🙂Z")]
    names = spark.createDataFrame(few, "tenant string, real string, fake string")
    many = spark.range(100_001).select(F.lit("").alias("tenant"), F.concat(F.lit("real"), "id").alias("real"), F.concat(F.lit("fk"), "id", F.lit(";")).alias("fake"))
    mapping = names.unionByName(many).withColumns({"category": F.lit("x"), "first_seen": F.lit(0)})
    texts = {"s": "hi Person-12 and Person-1Q, fk100000; Person-", "t": "é🙂Z fk7; é🙂 Person-1"}
    want = {"s": "hi Bo and AlQ, real100000 Person-", "t": "Di real7 é🙂 Al"}
    cuts = {s: [(s, i, c, i == len(t) - 1) for i, c in enumerate(t)] for s, t in texts.items()}
    cuts["t"] += [("t", 100, "Person-", False), ("t", 101, None, True), ("t", 102, "1 fk8", False), ("t", 103, ";", True)]
    want["t"] += "Person-1 real8"  # no stand-in goes over a stop
    batches = [cuts["s"][:8] + cuts["t"][:3], cuts["t"][3:9], cuts["s"][8:25], cuts["s"][25:] + cuts["t"][9:]]
    stream = fed(spark, tmp_path, batches, "stream_id string, seq bigint, text string, is_stop boolean")
    folder = f"{tmp_path}/hold"
    writer = B.restore_holdback(stream, lambda: mapping, folder, lambda df, b: df.write.mode("overwrite").parquet(f"{folder}/out/batch={b}"))
    writer.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(f"{folder}/out").collect(), key=lambda r: (r.stream_id, r.seq)):
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == want


def test_holdback_flushes_streams_that_pause(spark, tmp_path):
    mapping = spark.createDataFrame([("", "Al", "Person-1"), ("", "Bo", "Person-12")], "tenant string, real string, fake string").withColumns({"category": F.lit("x"), "first_seen": F.lit(0)})
    at = lambda t: f"2026-01-01 {t}"
    batches = [
        [("a", at("00:00:00"), 0, "hi Person-", False), ("b", at("00:00:00"), 0, "x Person-1", False), ("n", None, 0, "Person-1", False)],
        [("a", at("00:01:00"), 1, "1", False)],
        [("a", at("00:02:00"), 2, "2", False)],  # b has paused for two minutes of three
        [("c", at("00:05:00"), 0, "Person-12 end", False)],  # a and b are flushed
        [("a", at("00:05:30"), 3, " more Person-1", True)]]
    stream = fed(spark, tmp_path, batches, "stream_id string, ts string, seq bigint, text string, is_stop boolean")
    folder, ids = f"{tmp_path}/hold", []
    writer = B.restore_holdback(stream, lambda: mapping, folder, lambda df, b: (df.write.mode("overwrite").parquet(f"{folder}/out/batch={b}"), ids.append(b)), idle="3 minutes")
    writer.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r.stream_id, r.batch, r.seq, r.text) for r in spark.read.parquet(f"{folder}/out").collect())
    got = {s: "".join(t for x, *_, t in rows if x == s) for s in "abcn"}
    rest = {r.stream_id: r.text for r in B.holdback_rest(B.held_text(spark, folder, max(ids)), mapping).collect()}
    assert got["a"] == "hi Bo more Al" and got["b"] == "x Al" and got["c"] + rest["c"] == "Bo end" and got["n"] + rest["n"] == "Al"
    assert [b for s, b, *_ in rows if s == "b"][-1] == 3
    assert set(rest) == {"c", "n"}


def test_chunks_without_an_end_are_flushed_after_a_pause(spark, tmp_path):
    rows = [[("s", 0, "data: 1\n\ndata: ", False, "2026-01-01 00:00:00")], [("s", 1, "2", False, "2026-01-01 00:01:00")], [("t", 0, "data: x", False, "2026-01-01 01:00:00")],
            [("t", 1, "y\n\n", False, "2026-01-01 02:00:00")], [("s", 2, "data: 3\n\n", False, "2026-01-01 02:10:00")], [("t", 2, "z", True, "2026-01-01 02:11:00")]]
    stream = fed(spark, tmp_path, rows, "stream_id string, chunk_no int, chunk string, is_last boolean, ts string", lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")))
    made, out = B.frame_chunks(stream, "10 minutes"), f"{tmp_path}/frames"
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.stream_id, r.seq, r.part) for r in spark.read.schema(made.schema).parquet(out).collect())
    assert [(s, p) for s, _, p in got if s == "s"] == [("s", "data: 1"), ("s", "data: 2"), ("s", "data: 3")] and len({(s, n) for s, n, _ in got}) == len(got)
    assert [p for s, _, p in got if s == "t"] == ["data: xy", "z"]


def test_a_clock_moves_after_one_batch_of_all_files(spark, tmp_path):
    from catalog.streams import with_clock

    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("cast(id as string) stream_id", "timestamp'2026-01-01' ts").repartition(4).write.parquet(path)
    sizes = []
    stream = with_clock(spark, path, "stream_id string, ts timestamp").writeStream.foreachBatch(
        lambda df, b: sizes.append((b, df.count(), df.select("ts").distinct().count())))
    stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [(0, 100, 1), (1, 4, 1), (2, 4, 1)]
