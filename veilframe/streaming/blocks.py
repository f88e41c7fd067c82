"""Chunked event streams: text arrives in pieces, stand-ins may be cut anywhere, restoring waits for whole blocks.

``deltas`` rows are (stream_id, ts, seq, kind, key, sub, text, is_stop): kind ``block`` or ``choice`` for
text, ``call`` for tool-call arguments (key = choice, sub = call), ``other`` for everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.operators.restore import fake_hits, restore
from veilframe.operators.rewrite import splice
from veilframe.session import materialize

BLOCK_COLUMNS = "stream_id string, kind string, key int, sub int, seq bigint, text string, closed string"


def delta_rows(events: DataFrame, ts: Column | None = None) -> DataFrame:
    """Parsed events (stream_id, seq, part, event) to delta rows; a projection, for static and streaming frames."""
    e = "event"

    def row(kind: str, key: Column, sub: Column, text: Column, stop: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("int").alias("key"), sub.cast("int").alias("sub"),
                        text.alias("text"), stop.alias("is_stop"))

    no, zero = F.lit(False), F.lit(0)
    nothing = F.array().cast("array<struct<kind:string,key:int,sub:int,text:string,is_stop:boolean>>")
    index = F.coalesce(F.col(f"{e}.index"), zero)
    text_delta = (F.col(f"{e}.type") == "content_block_delta") & (F.col(f"{e}.delta.type") == "text_delta")
    block = F.when(text_delta, F.array(row("block", index, zero, F.coalesce(F.col(f"{e}.delta.text"), F.lit("")), no))).when(
        F.col(f"{e}.type") == "content_block_stop", F.array(row("block", index, zero, F.lit(None).cast("string"), F.lit(True))))

    def choice(c: Column) -> Column:
        at = F.coalesce(c["index"], zero)
        content = F.when(c["delta"]["content"].isNotNull(), F.array(row("choice", at, zero, c["delta"]["content"], no)))
        calls = F.transform(c["delta"]["tool_calls"], lambda t: row("call", at, F.coalesce(t["index"], zero), t["function"]["arguments"], no))
        calls = F.filter(calls, lambda t: t["text"].isNotNull())
        stop = F.when(F.coalesce(c["finish_reason"], F.lit("")) != "", F.array(
            row("choice", at, zero, F.lit(None).cast("string"), F.lit(True)), row("call", at, zero, F.lit(None).cast("string"), F.lit(True))))
        return F.concat(F.coalesce(content, nothing), F.coalesce(calls, nothing), F.coalesce(stop, nothing))

    choices = F.when(F.col(f"{e}.choices").isNotNull(), F.flatten(F.transform(F.col(f"{e}.choices"), choice)))
    rows = F.coalesce(block, choices, nothing)
    rows = F.when(F.size(rows) == 0, F.array(row("other", F.lit(0), zero, F.col("part"), no))).otherwise(rows)
    return events.select("stream_id", (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"), F.col("seq").cast("bigint").alias("seq"), F.inline(rows))


def close_blocks(deltas: DataFrame) -> DataFrame:
    """Batch twin of ``accumulate``: each block's first delta carries the whole text, the others are empty.

    A block is the deltas of one (stream, kind, key) up to its stop; blocks without a stop are flushed too.
    """
    place = ["stream_id", "kind", "key"]
    w = W.partitionBy(*place).orderBy("seq", F.col("is_stop").cast("int"), "sub")
    rows = deltas.filter("kind <> 'other'").repartition(*place)  # the windows and the grouping below share this exchange
    rows = rows.withColumn("__no", F.coalesce(F.sum(F.col("is_stop").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__stop", F.max("is_stop").over(W.partitionBy(*place, "__no")))
    blocks = rows.filter("not is_stop").groupBy(*place, "__no", "sub").agg(
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("d"), F.max("__stop").alias("__stop"))
    whole = F.array_join(F.transform("d", lambda x: x["text"]), "")
    first_has_all = F.transform("d", lambda x, i: F.struct(x["seq"].alias("seq"), F.when(i == 0, F.col("__whole")).otherwise("").alias("text")))
    return blocks.withColumn("__whole", whole).select(
        *place, "sub", F.when(F.col("__stop"), "stop").otherwise("end").alias("closed"), F.inline_outer(first_has_all)).select(
        "stream_id", "kind", "key", "sub", "seq", "text", "closed")


def _flush(key: tuple, seqs, subs, texts, closed: str):
    import pandas as pd

    whole: dict[int, str] = {}
    for sub, text in zip(subs, texts):
        whole[sub] = whole.get(sub, "") + text
    out = [whole.pop(sub, "") for sub in subs]  # the first delta of each part gets it all
    n = len(out)
    return pd.DataFrame({"stream_id": [key[0]] * n, "kind": [key[1]] * n, "key": [key[2]] * n, "sub": list(subs),
                         "seq": list(seqs), "text": out, "closed": [closed] * n})


def clocked(rows: DataFrame) -> DataFrame:
    """Streaming rows with a watermark that follows the newest ``ts`` and drops nothing.

    Spark drops rows behind the watermark. So rows that only tell the time move it, and those that are kept have none.
    """
    ticks = F.when(F.col("ts").isNull(), F.array(F.col("ts"))).otherwise(F.array(F.lit(None).cast("timestamp"), F.col("ts")))
    return rows.withColumn("__clock", F.explode(ticks)).withWatermark("__clock", "0 seconds").filter("__clock is null")


def accumulate(deltas: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Streaming: hold the deltas of each block until its stop, then emit them with the text on the first.

    No delta is late: streams may lag behind each other by any time. Blocks that never stop are flushed with
    ``closed = 'timeout'`` once the newest event of all streams has moved on by ``idle`` since the micro-batch of
    their last delta; a delta that arrives after that opens a new block, so nothing is lost.
    """
    import pandas as pd

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            seqs, subs, texts, timed = state.get
            if timed:
                state.remove()
                yield _flush(key, seqs, subs, texts, "timeout")
            else:  # the clock now holds the last delta's micro-batch: the pause counts from here
                state.update((seqs, subs, texts, True))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + max(1, idle_ms))
            return
        seqs, subs, texts = (list(x) for x in state.get[:3]) if state.exists else ([], [], [])
        # lists: a block has few rows, and pandas takes longer to join and sort a small frame than to read it
        rows = sorted((row for b in batches for row in b["delta"].tolist()),
                      key=lambda row: (row["seq"], row["is_stop"] is None, bool(row["is_stop"]), row["sub"]))
        for row in rows:
            seq, sub, text = row["seq"], row["sub"], row["text"]
            if row["is_stop"]:
                if seqs:
                    yield _flush(key, seqs, subs, texts, "stop")
                seqs, subs, texts = [], [], []
            else:
                seqs.append(int(seq)), subs.append(int(sub)), texts.append(text)
        if seqs:
            state.update((seqs, subs, texts, False))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        elif state.exists:
            state.remove()

    # each column is turned to pandas for each block on its own, which takes longer than reading its few rows: so one has all
    delta = F.struct("seq", "sub", "text", "is_stop").alias("delta")
    rows = clocked(deltas.filter("kind <> 'other'")).select("stream_id", "kind", "key", delta, "__clock")
    return rows.groupBy("stream_id", "kind", "key").applyInPandasWithState(
        step, BLOCK_COLUMNS, "seqs array<bigint>, subs array<int>, texts array<string>, timed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def restore_blocks(blocks: DataFrame, mapping: DataFrame, tenant: str = "") -> DataFrame:
    """Restore the texts of closed blocks; empty deltas pass through."""
    doc_id = F.struct("stream_id", "kind", "key", "sub", "seq")
    docs = blocks.select(F.lit(tenant).alias("tenant"), doc_id.alias("doc_id"), "text", "closed")
    return restore(docs, mapping).select("doc_id.*", F.col("text_out").alias("text"), "closed")


def restore_stream(deltas: DataFrame, mapping: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None],
                   idle: str = "10 minutes", tenant: str = "") -> DataStreamWriter:
    """Streamed restore: blocks are completed in state and each micro-batch is joined with the current mapping.

    ``mapping`` is called per batch, so stand-ins minted meanwhile are known; ``sink`` gets each restored batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sink(restore_blocks(batch, mapping(), tenant), batch_id)
        finally:
            batch.unpersist()

    return accumulate(deltas, idle).writeStream.foreachBatch(run)


def passthrough(events: DataFrame, mapping: DataFrame, tenant: str = "") -> DataFrame:
    """Whole messages and unknown events of a stream: message texts are restored, the rest is unchanged.

    (stream_id, seq, n, text): the texts of a message event's content blocks, or the event itself.
    """
    texts = F.transform(F.filter("event.message.content", lambda b: b["text"].isNotNull()), lambda b: b["text"])
    known = F.col("event.type").isin("content_block_delta", "content_block_stop") | F.col("event.choices").isNotNull()
    rows = events.filter(~F.coalesce(known, F.lit(False))).select(
        "stream_id", "seq", F.coalesce(F.size(texts) > 0, F.lit(False)).alias("whole"),
        F.posexplode_outer(F.when(F.coalesce(F.size(texts) > 0, F.lit(False)), texts).otherwise(F.array("part"))).alias("n", "text"))
    docs = rows.filter("whole").select(F.lit(tenant).alias("tenant"), F.struct("stream_id", "seq", "n").alias("doc_id"), "text")
    restored = restore(docs, mapping).select("doc_id.*", F.col("text_out").alias("text"))
    return restored.unionByName(rows.filter("not whole").select("stream_id", "seq", "n", "text"))


HELD = "stream_id string, text string, seq bigint, seen timestamp, newest timestamp"


def held_text(spark, folder: str, batch_id: int) -> DataFrame:
    """What micro-batch ``batch_id`` held back. Two slots take turns, so a repeated batch overwrites its own only."""
    return spark.read.schema(HELD).parquet(f"{folder.rstrip('/')}/held/slot={batch_id % 2}")


def restore_holdback(deltas: DataFrame, mapping: Callable[[], DataFrame], folder: str, sink: Callable[[DataFrame, int], None],
                     holdback: int | None = None, tenant: str = "", idle: str = "10 minutes") -> DataStreamWriter:
    """Streamed restore without blocks: text goes out as it comes, but for as much as the longest stand-in, so none is shown in part.

    Deltas are (stream_id, seq, text, is_stop) and, if they have a time, ts; ``sink`` gets (stream_id, seq, text), one row
    per stream and stop of a micro-batch, with the seq of its last delta. What is held back is written to one of two slots
    of ``folder`` in turn, however long the stream runs. The rest of a stream without a stop goes out once the newest ts
    of all streams is ``idle`` past its own last one; ``holdback_rest`` gives what is held when the input has ended.
    Stand-ins are joined with the texts, so their number is not bounded; ``mapping`` is called per batch.
    """
    import pandas as pd

    pause = F.expr(f"interval {int(pd.Timedelta(idle).total_seconds() * 1000)} milliseconds")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, F.struct("stream_id", "part")
        known = mapping()
        keep = max(holdback or 0, known.agg(F.max(F.length("fake"))).first()[0] or 0)
        ts = F.col("ts").cast("timestamp") if "ts" in batch.columns else F.lit(None).cast("timestamp")
        batch = batch.select("stream_id", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_stop", F.lit(False)).alias("is_stop"), ts.alias("ts"))
        by_stream = W.partitionBy("stream_id").orderBy("seq", F.col("is_stop").cast("int"))
        stops = F.coalesce(F.sum(F.col("is_stop").cast("int")).over(by_stream.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "is_stop", "text"))), lambda x: x["text"]), "")
        new = batch.withColumn("part", stops).groupBy("stream_id", "part").agg(
            F.max("seq").alias("seq"), F.max("is_stop").alias("ended"), joined.alias("text"), F.max("ts").alias("seen"))
        newest = batch.agg(F.max("ts")).first()[0]
        if batch_id > 0:
            before = held_text(spark, folder, batch_id - 1)
            newest = max((t for t in (newest, before.agg(F.max("newest")).first()[0]) if t is not None), default=None)
            old = before.filter("stream_id is not null").select("stream_id", F.lit(0).cast("bigint").alias("part"), F.col("text").alias("__held"), F.col("seq").alias("__seq"), F.col("seen").alias("__seen"))
            new = new.join(old, ["stream_id", "part"], "full").select(
                "stream_id", "part", F.coalesce("seq", "__seq").alias("seq"), "ended", F.col("seq").isNull().alias("waits"),
                F.concat(F.coalesce("__held", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), F.greatest("seen", "__seen").alias("seen"))
        else:
            new = new.withColumn("waits", F.lit(False))
        left = F.coalesce(F.col("seen") + pause <= F.lit(newest).cast("timestamp"), F.lit(False))
        new = new.withColumn("ended", F.coalesce("ended", F.lit(False)) | left)
        texts = materialize(new.withColumns({"doc_id": key, "tenant": F.lit(tenant)}), "holdback")
        safe = F.when(F.col("ended"), F.length("text")).otherwise(F.greatest(F.lit(0), F.length("text") - keep))
        texts = texts.withColumn("__safe", safe)
        moving = "ended or not waits"  # the others have no new text
        hits = fake_hits(texts.filter(moving).select("tenant", "doc_id", "text"), known)
        hits = hits.join(texts.select("doc_id", "__safe"), "doc_id").filter(F.col("start") < F.col("__safe")).select("doc_id", "start", "end", "repl")
        hits = materialize(hits, "holdback_hits")  # that begin where all their text is there: later text cannot change them
        last = hits.groupBy("doc_id").agg(F.max("end").alias("__last"))
        cut = texts.join(last, "doc_id", "left").withColumn("__cut", F.when(F.expr(f"not ({moving})"), 0).otherwise(F.greatest("__safe", F.coalesce("__last", F.lit(0)))))
        rest = cut.filter("not ended").select("stream_id", F.expr("substring(text, __cut + 1)").alias("text"), "seq", "seen", F.lit(None).cast("timestamp").alias("newest"))
        clock = spark.range(1).select(F.lit(None).cast("string").alias("stream_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("seq"),
                                      F.lit(None).cast("timestamp").alias("seen"), F.lit(newest).cast("timestamp").alias("newest"))
        rest.filter("text <> ''").unionByName(clock).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/held/slot={batch_id % 2}")
        shown = cut.filter("__cut > 0").select("stream_id", "seq", "doc_id", F.expr("substring(text, 1, __cut)").alias("text"))
        sink(splice(shown, hits).select("stream_id", "seq", F.col("text_out").alias("text")), batch_id)

    return deltas.writeStream.foreachBatch(run)


def holdback_rest(held: DataFrame, mapping: DataFrame, tenant: str = "") -> DataFrame:
    """(stream_id, seq, text): the restored rest of every stream that is still held, for input that has ended."""
    docs = held.filter("stream_id is not null").select(F.lit(tenant).alias("tenant"), F.struct("stream_id", "seq").alias("doc_id"), "text")
    return restore(docs, mapping).select("doc_id.stream_id", "doc_id.seq", F.col("text_out").alias("text"))


def frame_chunks(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Streaming: byte chunks (stream_id, chunk_no, chunk, is_last) to whole events (stream_id, seq, part); the unfinished
    rest of a chunk waits in state for the next one.

    Where chunks have a ``ts``, the rest of a stream without a last chunk goes out once the newest ts of all streams has
    moved on by ``idle`` since its micro-batch; later chunks go on counting, until as long a pause has passed again.
    """
    import pandas as pd

    idle_ms, timed = int(pd.Timedelta(idle).total_seconds() * 1000), "ts" in chunks.columns

    def frame(key, seqs, parts):
        return pd.DataFrame({"stream_id": [key[0]] * len(seqs), "seq": seqs, "part": parts})

    def step(key, batches, state: GroupState):
        rest, n, phase = state.get if state.exists else ("", 0, 0)
        if state.hasTimedOut:
            # 0: the clock holds the last chunk now, the pause counts from here; 1: the pause is over; 2: once more
            if phase == 2:
                state.remove()
            else:
                if phase == 1:
                    yield frame(key, *(([n], [rest]) if rest.strip() else ([], [])))
                    rest, n = "", n + bool(rest.strip())
                state.update((rest, n, phase + 1))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + max(1, idle_ms))
            return
        rows = pd.concat(list(batches)).sort_values("chunk_no", kind="stable")
        seqs, parts, last = [], [], False
        for chunk, is_last in zip(rows["chunk"], rows["is_last"]):
            *whole, rest = (rest + chunk).split("\n\n")
            if is_last:
                whole, rest, last = [*whole, rest], "", True
            for part in whole:
                if part.strip():
                    seqs.append(n), parts.append(part)
                n += 1
        if last:
            if state.exists:
                state.remove()
        else:
            state.update((rest, n, 0))
            if timed:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        yield frame(key, seqs, parts)

    return (clocked(chunks) if timed else chunks).groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, seq bigint, part string", "rest string, n bigint, phase int", "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
