"""Audit trails, counters and session statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.functions.keyed import hmac_hex, salted_hash

GENESIS = "0" * 64
REQUEST_GENESIS = "0" * 16

# Prompts that steer the client and are not work.
CONTROL_PROMPTS = ["", "$", "quit", "exit", "logout"]


def count_map(rows: DataFrame, keys: list[str], name: str, out: str) -> DataFrame:
    """Counts by a column as a map per key, keys in order."""
    return rows.groupBy(*keys, name).count().groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), "count")))).alias(out))


def audit_entries(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per text (doc_id, text, text_out): counts by category and rule, sizes, no real values."""
    by_category = count_map(entities, ["doc_id"], "category", "by_category")
    by_rule = count_map(entities, ["doc_id"], "detector", "by_rule")
    empty = F.create_map().cast("map<string,bigint>")
    joined = docs.join(by_category, "doc_id", "left").join(by_rule, "doc_id", "left")
    total = F.aggregate(F.map_values(F.coalesce("by_category", empty)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return joined.select(
        "doc_id", total.alias("total_entities"), (total > 0).alias("modified"), F.length("text").alias("input_chars"),
        F.length("text_out").alias("output_chars"), (F.length("text_out") - F.length("text")).alias("char_delta"),
        F.coalesce("by_category", empty).alias("by_category"), F.coalesce("by_rule", empty).alias("by_rule"))


def proof_hashes(docs: DataFrame, salt: str = "", length: int = 12) -> DataFrame:
    """Salted, cut hashes of input and output: they prove identity and reveal nothing."""
    return docs.select("doc_id", salted_hash(F.col("text"), salt, length).alias("proof_in"),
                       salted_hash(F.col("text_out"), salt, length).alias("proof_out"))


def fakes_sample(replaced: DataFrame, n: int = 3) -> DataFrame:
    """The first n different stand-ins of each text, in reading order."""
    first = replaced.groupBy("doc_id", "fake").agg(F.min("start").alias("start"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("start"))
    return first.withColumn("__r", rank).filter(F.col("__r") <= n).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "fake"))), lambda x: x["fake"]).alias("fakes_sample"))


def _pairs(m: str) -> Column:
    text = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return F.when(text == "", "none").otherwise(text)


def audit_lines(audit: DataFrame, fmt: str = "human", event: str = "obfuscate") -> DataFrame:
    """Audit rows as lines: JSON or ``key=value`` text."""
    if fmt == "json":
        line = F.to_json(F.struct(
            F.lit(f"audit.{event}").alias("event"), F.col("doc_id").alias("req"), F.col("modified"), F.col("total_entities").alias("totalEntities"),
            F.col("input_chars").alias("inputChars"), F.col("output_chars").alias("outputChars"), F.col("char_delta").alias("charDelta"),
            F.col("by_category").alias("byCategory"), F.col("by_rule").alias("byRule")))
        return audit.select("doc_id", line.alias("line"))
    delta = F.concat(F.when(F.col("char_delta") >= 0, "+").otherwise(""), F.col("char_delta").cast("string"))
    line = F.concat_ws(
        " | ", F.concat(F.lit(f"[audit] {event.upper()} req="), F.col("doc_id").cast("string")),
        F.concat(F.lit("entities="), F.col("total_entities").cast("string")),
        F.concat(F.lit("chars="), F.col("input_chars").cast("string"), F.lit("->"), F.col("output_chars").cast("string"), F.lit(" (delta="), delta, F.lit(")")),
        F.concat(F.lit("modified="), F.when(F.col("modified"), "YES").otherwise("NO")),
        F.concat(F.lit("byCat="), _pairs("by_category")), F.concat(F.lit("byRule="), _pairs("by_rule")))
    return audit.select("doc_id", line.alias("line"))


def category_json(m: str = "categories") -> Column:
    """Map as JSON with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def chain_payload(previous: Column, row: Column | None = None) -> Column:
    def c(name: str) -> Column:
        return F.col(name) if row is None else row[name]
    return F.concat(previous, F.lit(":"), c("ts").cast("string"), F.lit(":"), c("event_type"), F.lit(":"), c("cats"))


SEGMENT = 1_000_000  # sequence numbers per chain segment


def _chained(rows: DataFrame, columns: str, message, genesis: str, digest) -> DataFrame:
    """Fold a hash over the rows of each (session, segment) in order; batches stream through, one hash is the state."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        at, last = None, genesis
        for batch in batches:
            hashes = []
            for row in batch.itertuples(index=False):
                if (row.session, row.segment) != at:
                    at = (row.session, row.segment)
                    last = genesis if row.segment == 0 else digest(f"{genesis}:{row.segment}")
                last = digest(message(last, row))
                hashes.append(last)
            yield batch.assign(chain_hash=hashes)

    ordered = rows.select(*names).repartition("session", "segment").sortWithinPartitions("session", "segment", "seq")
    return ordered.mapInPandas(run, columns + ", chain_hash string")


def _hmac_digest(secret: str):
    key = secret.encode("utf-8")

    def digest(text: str) -> str:
        import hashlib
        import hmac

        return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()

    return digest


def with_segment(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    return rows.withColumn("segment", F.floor(F.col("seq") / segment).cast("bigint"))


def chain(audit: DataFrame, secret: str, segment: int = SEGMENT) -> DataFrame:
    """Tamper-evident chain per session: each hash covers the one before, time, type and categories.

    Entry n needs hash n-1, so a chain cannot be cut for parallel work.  Sessions run side by side, and a
    session of any length is laid out in segments of ``segment`` sequence numbers, each with its own keyed
    start; ``seal`` chains the segments.  Sessions within one segment have the plain chain.
    """
    rows = with_segment(audit.withColumn("cats", category_json()), segment)
    return _chained(rows, "session string, segment bigint, seq bigint, ts bigint, event_type string, cats string",
                    lambda last, r: f"{last}:{r.ts}:{r.event_type}:{r.cats}", GENESIS, _hmac_digest(secret))


def seal(chained: DataFrame, secret: str) -> DataFrame:
    """Chain over the last hash and the size of each segment: a lost or shortened segment shows."""
    ends = chained.groupBy("session", F.col("segment").alias("__s")).agg(
        F.max_by("chain_hash", "seq").alias("last"), F.count(F.lit(1)).alias("n"))
    rows = ends.select("session", F.lit(0).cast("bigint").alias("segment"), F.col("__s").alias("seq"),
                       F.concat_ws(":", "last", F.col("n").cast("string")).alias("data"))
    return _chained(rows, "session string, segment bigint, seq bigint, data string",
                    lambda last, r: f"{last}:{r.data}", GENESIS, _hmac_digest(secret)).drop("segment")


def verify_chain(chained: DataFrame, secret: str) -> DataFrame:
    """Per session: entries checked, valid, and the first broken entry.

    Every row is checked on its own against the hash stored before it, so this is parallel within segments too.
    """
    start = F.when(F.col("segment") == 0, F.lit(GENESIS)).otherwise(hmac_hex(secret, F.concat(F.lit(GENESIS + ":"), F.col("segment").cast("string"))))
    before = F.coalesce(F.lag("chain_hash").over(W.partitionBy("session", "segment").orderBy("seq")), start)
    rows = chained.withColumn("__before", before)
    bad = hmac_hex(secret, chain_payload(F.col("__before"))) != F.col("chain_hash")
    return rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("entries_checked"), (F.count_if(bad) == 0).alias("valid"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"))


def request_chain(requests: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Second, unkeyed chain of 16 hex digits over request data (session, seq, data)."""
    def digest(text: str) -> str:
        import hashlib

        return hashlib.sha256(text.encode()).hexdigest()[:16]

    return _chained(with_segment(requests, segment), "session string, segment bigint, seq bigint, data string",
                    lambda last, r: last + r.data, REQUEST_GENESIS, digest)


def rule_hits(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with its hits, zeros included, and a logarithmic bar."""
    hits = entities.groupBy("detector").agg(F.count(F.lit(1)).alias("hits"))
    n = F.coalesce("hits", F.lit(0)).cast("bigint")
    bar = F.when(n > 0, F.repeat(F.lit("█"), F.least(F.ceil(F.log2(n + 1)).cast("int"), F.lit(16)))).otherwise("")
    return rules.join(hits, "detector", "left").select(
        "name", "category", F.when(F.col("enabled"), "active").otherwise("DISABLED").alias("status"), "confidence", n.alias("hits"), bar.alias("bar")
    ).orderBy(F.desc("hits"), "name")


def category_counts(judged: DataFrame) -> DataFrame:
    """Detected and replaced entities by tenant and category, with subtotals."""
    return judged.rollup("tenant", "category").agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("drop_reason").isNull()).alias("replaced"))


def engine_stats(judged: DataFrame, mapping: DataFrame, docs: DataFrame, level: str = "full", salt: str = "") -> DataFrame:
    """One row of totals: each input is aggregated on its own and the single rows are put side by side."""
    a = docs.agg(F.count(F.lit(1)).alias("obfuscation_events"))
    b = judged.agg(F.count(F.lit(1)).alias("entities_detected"), F.count_if(F.col("drop_reason").isNull()).alias("entities_obfuscated"))
    c = mapping.agg(F.count(F.lit(1)).alias("store_mappings"))
    one = [df.withColumn("__one", F.lit(1)) for df in (a, b, c)]
    return one[0].join(one[1], "__one").join(one[2], "__one").drop("__one").withColumn("redaction_level", F.lit(level)).withColumn("salt", F.lit(salt))


def audit_stats(audit: DataFrame) -> DataFrame:
    """Totals by event type."""
    entities = F.when(F.col("event_type") == "obfuscation", F.col("total_entities")).otherwise(0)
    replaced = F.when(F.col("event_type") == "deobfuscation", F.col("total_entities")).otherwise(0)
    return audit.groupBy("session").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("event_type") == "obfuscation").alias("obfuscation_events"),
        F.count_if(F.col("event_type") == "deobfuscation").alias("deobfuscation_events"),
        F.sum(entities).alias("entities_scrubbed"), F.sum(replaced).alias("replacements_restored"))


def category_totals(audit: DataFrame) -> DataFrame:
    """Totals by category over all audit rows."""
    return audit.select(F.explode_outer("categories").alias("category", "n")).filter("category is not null").groupBy("category").agg(F.sum("n").alias("total"))


def history_summary(history: DataFrame) -> DataFrame:
    """Prompts, sessions and last prompt time; control prompts, missing sessions and bad times do not count."""
    ts = F.col("ts").try_cast("double")
    real = history.filter(
        (F.trim(F.coalesce("session_id", F.lit(""))) != "") & ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 1e300)
        & ~F.lower(F.trim(F.coalesce("text", F.lit("")))).isin(*CONTROL_PROMPTS))
    return real.agg(F.count(F.lit(1)).alias("prompts"), F.countDistinct(F.trim("session_id")).alias("sessions"),
                    F.coalesce(F.max((ts * 1000).cast("bigint")), F.lit(0)).alias("last_prompt_ms"))


COUNTERS = ["request_count", "session_count", "store_size", "obfuscation_calls", "deobfuscation_calls", "entities_obfuscated",
            "replacements_deobfuscated", "updated_at"]


def merge_snapshots(snapshots: DataFrame, labels: tuple[str, ...] = ("agent_label",)) -> DataFrame:
    """Snapshots of one session from several writers (session, prio, counters, category_counts): the maximum of
    every counter and of every category, and the label of the best-placed writer that has one."""
    counters = [F.max(c).alias(c) for c in COUNTERS if c in snapshots.columns]
    named = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("prio"))).alias(c) for c in labels]
    merged = snapshots.groupBy("session").agg(*counters, *named)
    best = snapshots.select("session", F.explode_outer("category_counts").alias("category", "n")).filter("category is not null")
    best = best.groupBy("session", "category").agg(F.max("n").alias("n")).groupBy("session").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    return merged.join(best, "session", "left")


def privacy_counters(requests: DataFrame) -> DataFrame:
    """Calls and counts per session from request rows (session, direction, n)."""
    fwd, back = F.col("direction") == "obfuscate", (F.col("direction") == "deobfuscate") & (F.col("n") > 0)
    return requests.groupBy("session").agg(
        F.count_if(fwd).alias("obfuscation_calls"), F.count_if(back).alias("deobfuscation_calls"),
        F.sum(F.when(fwd, F.col("n")).otherwise(0)).alias("entities_obfuscated"),
        F.sum(F.when(back, F.col("n")).otherwise(0)).alias("replacements_deobfuscated"))


def recent_tools(calls: DataFrame, n: int = 20, salt: int = 64) -> DataFrame:
    """Last n tools of each session, oldest first.

    A long session is cut into slices that each keep their own last n, so no task sorts a whole session.
    """
    def last(keys: list[str]):
        return F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seq")))

    cut = calls.select("session", "seq", "tool").withColumn("__slice", F.pmod(F.xxhash64("seq"), F.lit(salt)))
    top = cut.withColumn("__r", last(["session", "__slice"])).filter(F.col("__r") <= n)
    top = top.withColumn("__r", last(["session"])).filter(F.col("__r") <= n)
    return top.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"]).alias("tools"))


def tool_depth(calls: DataFrame, max_depth: int) -> DataFrame:
    """Nesting depth per turn after each call (delta +1 or -1), never below zero when read; warns above the limit."""
    running = W.partitionBy("session", "turn").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = F.greatest(F.sum("delta").over(running), F.lit(0)).cast("bigint")
    return calls.withColumn("depth", depth).withColumn("warn", F.col("depth") > max_depth)


def latency_stats(requests: DataFrame) -> DataFrame:
    """Requests and mean processing time per session."""
    return requests.groupBy("session").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("ms")).cast("bigint").alias("avg_ms"))
