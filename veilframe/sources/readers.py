"""Sources and sinks.  Every reader has a declared schema; bad input becomes a row, not a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.operators.mapping import MAPPING_COLUMNS
from veilframe.operators.rules import BUILTIN, Rule, effective_rules

REQUEST_SCHEMA = (
    "id string, method string, params struct<text: string, partition: string, "
    "operations: array<struct<direction: string, text: string, partition: string>>>, _bad string")
HISTORY_SCHEMA = "session_id string, ts string, text string, _bad string"
STORE_SCHEMA = "mappings array<array<string>>, salt string, tenantId string, exportedAt string"
EVENT_SCHEMA = (
    "type string, index int, delta struct<type: string, text: string, partial_json: string>, "
    "message struct<content: array<struct<type: string, text: string>>>, "
    "choices array<struct<index: int, finish_reason: string, delta: struct<content: string, "
    "tool_calls: array<struct<index: int, function: struct<name: string, arguments: string>>>>>>")


def read_docs(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text", id_col: str | None = "doc_id",
              tenant: str | Column = "", schema: str | None = None) -> DataFrame:
    """Texts of a table or of plain files as (tenant, doc_id, text).

    Without an id column the id is derived from the content, so that a retried task gives the same rows.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(fmt).load(path)
    text = F.col("value" if fmt == "text" else text_col)
    doc_id = F.col(id_col) if id_col and fmt != "text" else F.xxhash64(text)
    tenant = F.lit(tenant) if isinstance(tenant, str) else tenant
    return df.select(tenant.alias("tenant"), doc_id.alias("doc_id"), text.alias("text")).filter("text is not null")


def parse_requests(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON request lines: (id, method, params, error); blank lines vanish, broken ones become parse errors."""
    r = F.from_json(col, REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.filter(F.trim(col) != "").select(r.alias("r"))
    error = (
        F.when(F.col("r._bad").isNotNull(), F.lit("Parse error"))
        .when(F.col("r.id").isNull() | (F.coalesce("r.method", F.lit("")) == ""), F.lit("Missing required field: id and method")))
    return parsed.select("r.id", "r.method", "r.params", error.alias("error"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))


def batch_operations(requests: DataFrame) -> DataFrame:
    """Operations of batch requests as rows (id, idx, tenant, direction, text); a request-level partition is the default."""
    good = requests.filter("error is null and params.operations is not null")
    return good.select("id", F.col("params.partition").alias("__p"), F.posexplode("params.operations").alias("idx", "o")).select(
        "id", "idx", F.coalesce("o.partition", "__p", F.lit("")).alias("tenant"), F.col("o.direction").alias("direction"),
        F.coalesce("o.text", F.lit("")).alias("text"))


def write_store(mapping: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Mapping store, one folder per tenant."""
    mapping.select(*MAPPING_COLUMNS).write.mode(mode).partitionBy("tenant").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("tenant", F.when(F.col("tenant") == "__HIVE_DEFAULT_PARTITION__", "").otherwise(F.coalesce(F.col("tenant").cast("string"), F.lit("")))).select(*MAPPING_COLUMNS)


def export_rows(mapping: DataFrame, salt: str, exported_at: str) -> DataFrame:
    """Serialised form, one JSON object per line and mapping: distributed, whatever the size of the store."""
    return mapping.select(F.to_json(F.struct(
        F.array(F.array("real", "fake", "category")).alias("mappings"), F.lit(salt).alias("salt"),
        F.col("tenant").alias("tenantId"), F.lit(exported_at).alias("exportedAt"))).alias("value"))


def parse_export(lines: DataFrame, col: str = "value") -> DataFrame:
    """Serialised stores back to (tenant, real, fake, category, salt, exported_at); takes whole-store objects too."""
    s = F.from_json(col, STORE_SCHEMA)
    return lines.select(s.alias("s")).select(F.explode_outer("s.mappings").alias("m"), "s.salt", "s.tenantId", "s.exportedAt").filter(
        F.size("m") == 3).select(
        F.coalesce("tenantId", F.lit("")).alias("tenant"), F.col("m")[0].alias("real"), F.col("m")[1].alias("fake"),
        F.col("m")[2].alias("category"), "salt", F.col("exportedAt").alias("exported_at"))


def read_rules(spark: SparkSession, path: str, builtin: list[Rule] | None = None) -> list[Rule]:
    """Rule overlay from a JSON object name -> {enabled, pattern, flags, category, confidence}; a small settings file."""
    schema = "map<string, struct<enabled: boolean, pattern: string, flags: string, category: string, confidence: double>>"
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).first()
    config = {name: {k: v for k, v in change.asDict().items() if v is not None} for name, change in ((row.r or {}) if row else {}).items()}
    return effective_rules(spark, config, None, BUILTIN if builtin is None else builtin)


def write_stats(stats: DataFrame, path: str, updated_at: str) -> None:
    """Snapshot of counters with its time."""
    stats.withColumn("updated_at", F.lit(updated_at)).write.mode("overwrite").json(path)


def write_audit(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Audit lines (column ``line``) as text files."""
    lines.select(F.col("line").alias("value")).write.mode(mode).text(path)


def parse_history(lines: DataFrame, col: str = "value") -> DataFrame:
    """Prompt history lines; invalid JSON is skipped."""
    h = F.from_json(col, HISTORY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim(col) != "").select(h.alias("h")).filter("h._bad is null").select("h.session_id", "h.ts", "h.text")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_history(spark.read.text(path))


def parse_sse(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Event-stream bodies to events in order: (keep..., seq, part, event); event is null for lines without JSON data.

    Works on static and streaming frames alike: framing is a projection.
    """
    parts = F.split(body, "\n\n", -1)
    rows = bodies.select(*keep, F.posexplode_outer(parts).alias("seq", "part")).filter(F.trim("part") != "")
    line = F.try_element_at(F.filter(F.split("part", "\n"), lambda x: x.startswith("data: ")), F.lit(1))
    return rows.select(*keep, "seq", "part", F.from_json(F.substring(line, 7, 2**31 - 1), EVENT_SCHEMA).alias("event"))


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one event stream."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    return parse_sse(files.select(F.col("_metadata.file_path").alias("stream_id"), F.col("value").alias("body")))
