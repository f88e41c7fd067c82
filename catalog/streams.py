"""Event streams: batch twins over split conversations, and the streaming operators run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import KEYS, query, side_by_side
from catalog.rewriting import person_mapping
from veilframe.operators.detect import SCAN_ROWS
from veilframe.plans import corpora as C
from veilframe.session import materialize, shared_dir
from veilframe.sources.readers import parse_sse
from veilframe.streaming import blocks as B, jobs as J

# A model answer per conversation turn that names a person's stand-in, sent in pieces of twelve characters.
TURNS = """select conv_id, turn, concat('Dear Person-', lpad(cast(conv_id % 100 as varchar), 6, '0'), '. ', text, ' Yours, Person-', lpad(cast(turn as varchar), 6, '0')) as text from conversations"""
RESTORED = """select conv_id, turn, concat('Dear The "Customer#', lpad(cast(conv_id % 100 as varchar), 9, '0'), '". ', text, ' Yours, The "Customer#', lpad(cast(turn as varchar), 9, '0'), '"') as text from conversations"""


def turns(spark, sf_dir):
    """Answers, dealt to so many tasks that none gets more the larger the table is; a row group is read by one task."""
    rows = C.corpus(spark, sf_dir, TURNS, ("conversations",))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // SCAN_ROWS)), "conv_id", "turn")


def pieces(spark, sf_dir):
    """(conv_id, turn, n, last, piece)"""
    cut = F.regexp_extract_all("text", F.lit(r"(?s).{1,12}"), F.lit(0))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.size(cut).alias("total"), F.posexplode(cut).alias("n", "piece"))
    return rows.withColumn("last", F.col("n") == F.col("total") - 1)


def line(event: str, data):
    return F.concat(F.lit(f"event: {event}\ndata: "), data, F.lit("\n\n"))


def block_bodies(spark, sf_dir):
    """One event-stream body per conversation: a content block per turn."""
    delta = line("content_block_delta", F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.col("turn").alias("index"),
                 F.struct(F.lit("text_delta").alias("type"), F.col("piece").alias("text")).alias("delta"))))
    stop = F.when(F.col("last"), line("content_block_stop", F.to_json(F.struct(F.lit("content_block_stop").alias("type"), F.col("turn").alias("index"))))).otherwise("")
    rows = pieces(spark, sf_dir).withColumn("e", F.concat(delta, stop))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n", "e"))), lambda x: x["e"]), "")
    return rows.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.concat(F.lit("event: ping\ndata: {\"type\": \"ping\"}\n\n"), body).alias("body"))


def choice_bodies(spark, sf_dir):
    """The choice protocol: text in the delta of choice ``turn % 2``, tool-call arguments beside it."""
    delta = F.struct(F.col("piece").alias("content"), F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("f").alias("name"), F.col("piece").alias("arguments")).alias("function"))).alias("tool_calls"))
    data = F.to_json(F.struct(F.array(F.struct((F.col("turn") % 2).alias("index"), F.when(F.col("last"), "stop").alias("finish_reason"), delta.alias("delta"))).alias("choices")))
    rows = pieces(spark, sf_dir).withColumn("e", F.concat(F.lit("data: "), data, F.lit("\n\n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n", "e"))), lambda x: x["e"]), "")
    return rows.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(body.alias("body"))


PARTS = "(select conv_id, turn, cast(ceil(length(text) / 12.0) as bigint) as parts from ({t}) t)".replace("{t}", TURNS)


@query("sse_events", f"select cast(conv_id as varchar) as stream_id, cast(sum(parts + 1) + 1 as bigint) as events, cast(count(*) as bigint) as stops from {PARTS} p group by conv_id")
def sse_events(spark, sf_dir):
    e = parse_sse(block_bodies(spark, sf_dir))
    return e.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event.type") == "content_block_stop").alias("stops"))


def whole(blocks):
    """Blocks with text, one row each."""
    return blocks.filter("text <> ''").select("stream_id", "key", "sub", "text", "closed")


@query("sse_blocks", f"select cast(conv_id as varchar) as stream_id, turn as key, 0 as sub, text, 'stop' as closed from ({RESTORED}) r")
def sse_blocks(spark, sf_dir):
    deltas = B.delta_rows(parse_sse(block_bodies(spark, sf_dir)))
    return whole(B.restore_blocks(B.close_blocks(deltas), person_mapping(spark, sf_dir)))


@query("sse_choices", f"select cast(conv_id as varchar) as stream_id, turn % 2 as key, 0 as sub, text, 'stop' as closed from ({RESTORED}) r")
def sse_choices(spark, sf_dir):
    deltas = B.delta_rows(parse_sse(choice_bodies(spark, sf_dir)))
    return whole(B.restore_blocks(B.close_blocks(deltas.filter("kind = 'choice'")), person_mapping(spark, sf_dir)))


@query("sse_tool_args", f"select cast(conv_id as varchar) as stream_id, turn % 2 as key, 0 as sub, text, 'stop' as closed from ({RESTORED}) r")
def sse_tool_args(spark, sf_dir):
    deltas = B.delta_rows(parse_sse(choice_bodies(spark, sf_dir)))
    return whole(B.restore_blocks(B.close_blocks(deltas.filter("kind = 'call'")), person_mapping(spark, sf_dir)))


@query("sse_passthrough", f"select cast(conv_id as varchar) as stream_id, 'event: ping' || chr(10) || 'data: {{\"type\": \"ping\"}}' as text, cast(1 as bigint) as n from (select distinct conv_id from conversations) c")
def sse_passthrough(spark, sf_dir):
    out = B.passthrough(parse_sse(block_bodies(spark, sf_dir)), person_mapping(spark, sf_dir))
    return out.groupBy("stream_id", "text").agg(F.count(F.lit(1)).alias("n"))


# --- streaming runs: the input is written as files and read to its end -------------------------------


def as_stream(df, name):
    """A frame written to the shared folder and read back as a stream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(writer, name):
    """Run a stream to the end of its input."""
    spark_dir = shared_dir(_session()).rstrip("/")
    query_ = writer.option("checkpointLocation", f"{spark_dir}/checkpoint-{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query_.awaitTermination()


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def collected(stream, name, schema=None):
    """Rows of an append stream as a table."""
    spark = _session()
    out = f"{shared_dir(spark).rstrip('/')}/out-{name}-{uuid.uuid4().hex}"
    drained(stream.writeStream.format("parquet").option("path", out), name)
    return spark.read.schema(stream.schema).parquet(out)


def delta_stream(spark, sf_dir):
    deltas = B.delta_rows(parse_sse(block_bodies(spark, sf_dir)), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return as_stream(deltas, "deltas")


@query("stream_blocks", f"select cast(conv_id as varchar) as stream_id, turn as key, text, 'stop' as closed from ({RESTORED}) r")
def stream_blocks(spark, sf_dir):
    out = f"{shared_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    mapping = materialize(person_mapping(spark, sf_dir), "mapping")
    writer = B.restore_stream(delta_stream(spark, sf_dir), lambda: mapping,
                              lambda df, batch_id: df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
    drained(writer, "blocks")
    return spark.read.parquet(out).filter("text <> ''").select("stream_id", "key", "text", "closed")


def choice_stream(spark, sf_dir, kind, name):
    """The choice protocol as a stream: blocks of one kind, restored."""
    out = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    mapping = materialize(person_mapping(spark, sf_dir), "mapping")
    deltas = as_stream(B.delta_rows(parse_sse(choice_bodies(spark, sf_dir)), F.lit("2026-01-01 00:00:00").cast("timestamp")), name)
    drained(B.restore_stream(deltas.filter(F.col("kind") == kind), lambda: mapping, lambda df, batch_id: df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")), name)
    return whole(spark.read.parquet(out))


@query("stream_choices", f"select cast(conv_id as varchar) as stream_id, turn % 2 as key, 0 as sub, text, 'stop' as closed from ({RESTORED}) r")
def stream_choices(spark, sf_dir):
    return choice_stream(spark, sf_dir, "choice", "choices")


@query("stream_tool_args", f"select cast(conv_id as varchar) as stream_id, turn % 2 as key, 0 as sub, text, 'stop' as closed from ({RESTORED}) r")
def stream_tool_args(spark, sf_dir):
    return choice_stream(spark, sf_dir, "call", "calls")


@query("stream_timeout", "select cast(conv_id as varchar) as stream_id, count(distinct turn) as blocks from conversations where conv_id % 2 = 0 group by conv_id")
def stream_timeout(spark, sf_dir):
    return timed_out(spark, sf_dir, F.col("stream_id").cast("bigint") % 2 == 0)


@query("stream_timeout_all", "select cast(conv_id as varchar) as stream_id, count(distinct turn) as blocks from conversations group by conv_id")
def stream_timeout_all(spark, sf_dir):
    """All conversations; ``stream_timeout`` and its SQL have the even ones."""
    return timed_out(spark, sf_dir, F.lit(True))


def with_clock(spark, path, schema):
    """The rows of a folder as one micro-batch of a stream, and two more in which only the clock goes on by a day.

    A micro-batch takes as many files as the folder has, so each day has as many, of one row.
    """
    rows = spark.read.schema(schema).parquet(path)
    files = max(1, len(rows.inputFiles()))
    for day in (2, 3):
        tick = rows.limit(1).withColumns({"ts": F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp"), "stream_id": F.lit("clock")})
        tick.withColumn("file", F.explode(F.sequence(F.lit(1), F.lit(files)))).repartition(files).drop("file").write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed_out(spark, sf_dir, wanted):
    """Blocks without a stop are flushed when the watermark passes; a later event moves it on."""
    base = B.delta_rows(parse_sse(block_bodies(spark, sf_dir)), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    open_ = base.filter(~F.col("is_stop") & (F.col("kind") == "block") & wanted)
    path = f"{shared_dir(spark).rstrip('/')}/open-{uuid.uuid4().hex}"
    open_.write.parquet(path)
    stream = with_clock(spark, path, open_.schema)
    out = collected(B.accumulate(stream), "timeout")
    return out.filter("stream_id <> 'clock' and text <> ''").groupBy("stream_id").agg(F.countDistinct("key").alias("blocks"))


@query("stream_holdback", f"select cast(conv_id * 1000 + turn as varchar) as stream_id, text from ({RESTORED}) r")
def stream_holdback(spark, sf_dir):
    p = pieces(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("stream_id"), F.col("n").cast("bigint").alias("seq"),
                                     F.col("piece").alias("text"), F.col("last").alias("is_stop"))
    folder = f"{shared_dir(spark).rstrip('/')}/holdback-{uuid.uuid4().hex}"
    mapping = materialize(person_mapping(spark, sf_dir), "mapping")
    drained(B.restore_holdback(as_stream(p, "pieces"), lambda: mapping, folder, lambda df, b: df.write.mode("overwrite").parquet(f"{folder}/out/batch={b}")), "holdback")
    out = spark.read.schema("stream_id string, seq bigint, text string").parquet(f"{folder}/out")
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


@query("holdback_unstopped", f"select cast(conv_id * 1000 + turn as varchar) as stream_id, text from ({RESTORED}) r")
def holdback_unstopped(spark, sf_dir):
    """Streams that never stop: what is held when the input ends goes out too."""
    p = pieces(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("stream_id"), F.col("n").cast("bigint").alias("seq"),
                                     F.col("piece").alias("text"), F.lit(False).alias("is_stop"))
    folder = f"{shared_dir(spark).rstrip('/')}/unstopped-{uuid.uuid4().hex}"
    mapping = materialize(person_mapping(spark, sf_dir), "mapping")
    batches = []
    drained(B.restore_holdback(as_stream(p, "pieces"), lambda: mapping, folder, lambda df, b: (df.write.mode("overwrite").parquet(f"{folder}/out/batch={b}"), batches.append(b))), "unstopped")
    out = spark.read.schema("stream_id string, seq bigint, text string").parquet(f"{folder}/out").select("stream_id", "seq", "text", F.lit(0).alias("rest"))
    out = out.unionByName(B.holdback_rest(B.held_text(spark, folder, max(batches)), mapping).withColumn("rest", F.lit(1)))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rest", "text"))), lambda x: x["text"]), "").alias("text"))


@query("frames_unstopped", f"select cast(conv_id as varchar) as stream_id, cast(sum(parts + 1) + 1 as bigint) as events from {PARTS} p group by conv_id")
def frames_unstopped(spark, sf_dir):
    """Bodies whose last chunk is not marked and whose last event is cut short: it goes out after a pause."""
    body = F.expr("substring(body, 1, length(body) - 2)")
    cut = F.regexp_extract_all(body, F.lit(r"(?s).{1,500}"), F.lit(0))
    day = lambda n: F.lit(f"2026-01-0{n} 00:00:00").cast("timestamp")
    chunks = block_bodies(spark, sf_dir).select("stream_id", F.posexplode(cut).alias("chunk_no", "chunk")).withColumns({"is_last": F.lit(False), "ts": day(1)})
    path = f"{shared_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    chunks.write.parquet(path)
    stream = with_clock(spark, path, chunks.schema)
    out = collected(B.frame_chunks(stream), "frames").filter("stream_id <> 'clock'")
    return out.groupBy("stream_id").agg(F.countDistinct("seq").alias("events"))


@query("stream_frames", f"select cast(conv_id as varchar) as stream_id, cast(sum(parts + 1) + 1 as bigint) as events from {PARTS} p group by conv_id")
def stream_frames(spark, sf_dir):
    cut = F.regexp_extract_all("body", F.lit(r"(?s).{1,500}"), F.lit(0))
    chunks = block_bodies(spark, sf_dir).select("stream_id", F.size(cut).alias("total"), F.posexplode(cut).alias("chunk_no", "chunk"))
    chunks = chunks.select("stream_id", "chunk_no", "chunk", (F.col("chunk_no") == F.col("total") - 1).alias("is_last"))
    out = collected(B.frame_chunks(as_stream(chunks, "chunks")), "frames")
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"))


EVENTS_TS = "select event_id, event_type as category, cast(user_id as varchar) as user, ts from events"


@query("stream_windows", "select time_bucket(interval '6 hours', ts) as window_start, event_type as category, count(*) as n from events group by 1, 2")
def stream_windows(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("ts"))
    return J.running_stats(rows, "6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "category", "n")


@query("stream_sessions", """with g as (select cast(user_id as varchar) as user_, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_ order by ts rows unbounded preceding) as k from g) select user_, min(ts) as session_start, count(*) as n from s group by user_, k""")
def stream_sessions(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    return J.session_stats(rows, "30 minutes").select(F.col("user").alias("user_"), F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("stream_learned", "select cast(user_id as varchar) as session, 'host-' || event_type || '-' || (event_id % 7) as value, min(event_id) as first_seq from events group by 1, 2")
def stream_learned(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    found = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit(0).alias("start"),
                     F.concat(F.lit("host-"), "event_type", F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("value"),
                     F.lit("hostname").alias("category"), F.lit(0.9).alias("confidence"), F.lit("regex:cisco_hostname").alias("detector"))
    return collected(J.session_learned(as_stream(found, "learned")), "learned").select("session", "value", "first_seq")


@query("stream_obfuscate", "select count(*) as texts, count(*) as with_stand_in, count(*) as mapped, count(*) as stand_ins from customer")
def stream_obfuscate(spark, sf_dir):
    """Customer mails in two micro-batches that share values; every value has one stand-in at the end."""
    from veilframe.operators.rules import named
    from veilframe.plans.obfuscate import Config

    c = C.table(spark, sf_dir, "customer").select(F.lit("").alias("tenant"), F.col("c_custkey").alias("doc_id"), F.concat(
        F.lit("write to user"), F.col("c_custkey").cast("string"), F.lit("@corp.net")).alias("text"))
    folder = f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    c.coalesce(1).write.option("maxRecordsPerFile", 1 + c.count() // 2).parquet(f"{folder}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    config = Config(KEYS, named("email"), context=False, code=False)
    drained(J.streaming_obfuscate(stream, config, folder, lambda df, b: df.write.mode("overwrite").parquet(f"{folder}/out/batch={b}")), "obfuscate")
    texts = spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("text_out") != F.col("text")).alias("with_stand_in"))
    store = spark.read.parquet(f"{folder}/store").agg(F.countDistinct("real").alias("mapped"), F.countDistinct("fake").alias("stand_ins"))
    return side_by_side(texts, store)
