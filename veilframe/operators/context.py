"""Context: how the surroundings of an entity change its confidence, and what one text teaches about others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from veilframe.functions.sql import one_of, sql_text
from veilframe.operators.detect import ENTITY_COLUMNS, by_text, expand_matches, tasks_by_text
from veilframe.operators.examples import is_doc_example
from veilframe.operators.literals import match_literals

# Words of configuration files.
CONFIG_KEYWORDS = [
    "interface ", "router ", "ip route ", "hostname ", "switchport ", "vlan ", "access-list ", "route-map ",
    "ip address ", "description ", "ntp ", "snmp-server ", "logging ", "banner ", "crypto ", "line ",
    "set address ", "set zone ", "set security ", "set interfaces ", "set protocols ",
]
# Categories that support each other when they stand close together.
CLUSTER_GROUPS = [
    ["person_name", "email", "phone", "ssn"],
    ["ip_address", "hostname", "mac_address"],
    ["credit_card", "person_name"],
]
# Common words that are rarely identifiers.
COMMON_WORDS = [
    "permit", "deny", "default", "service", "system", "access", "network", "global", "local", "public",
    "private", "standard", "extended", "input", "output", "inside", "outside", "trust", "untrust", "management",
    "control", "data", "voice", "video", "wireless", "primary", "secondary", "backup", "active", "standby",
]
# Detectors whose findings are remembered for later texts of a session.
LEARNABLE_DETECTORS = [
    "regex:cisco_hostname", "regex:route_map_name", "regex:acl_name", "regex:prefix_list_name", "regex:vlan_name",
    "regex:interface_description", "regex:device_name_dotted", "regex:device_name_short", "context:hostname_propagation",
    "regex:snmp_community", "regex:prose_snmp_community", "regex:bgp_neighbor_password", "regex:cisco_enable_secret",
    "regex:cisco_type7",
]
PROXIMITY_WINDOW, CONTEXT_BOOST, PROXIMITY_BOOST = 200, 0.10, 0.08
LEARN_CAP, LEARN_KEEP = 1000, 500

SEPARATOR = r"\n\s*\n"
HOSTNAME_LINE = r"(?i)(?:^|\n)\s*(?:hostname|switchname)\s+(\S+)"


def keyword_score(text: str) -> str:
    """Number of configuration words in a text; the lambda lowers the text once for all of them."""
    score = " + ".join(f"cast(contains(t, {sql_text(k)}) as int)" for k in CONFIG_KEYWORDS)
    return f"transform(array(lower({text})), t -> {score})[0]"


def paragraph_blocks(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Blocks between blank lines: (doc_id, block_no, start, end); one block when there is no break.

    ``extra`` maps column names to SQL over ``block``, evaluated before the text of the block is dropped.
    """
    extra = extra or {}
    pieces = F.arrays_zip(F.split("text", SEPARATOR, -1).alias("block"),
                          F.transform(F.regexp_extract_all("text", F.lit(SEPARATOR), F.lit(0)), lambda s: F.length(s)).alias("sep"))
    filled = F.size(F.filter(F.split("text", SEPARATOR, -1), lambda b: F.length(b) > 0))
    whole = F.array(F.struct(F.col("text").alias("block"), F.lit(0).alias("sep")))
    rows = docs.select("doc_id", F.posexplode_outer(F.when(filled <= 1, whole).otherwise(pieces)).alias("block_no", "p"))
    rows = rows.select("doc_id", "block_no", F.length("p.block").alias("n"), F.coalesce("p.sep", F.lit(0)).alias("sep"),
                       *[F.expr(sql.replace("block", "p.block")).alias(name) for name, sql in extra.items()])
    before = W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + F.col("sep")).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).filter("n > 0").select(
        "doc_id", "block_no", "start", (F.col("start") + F.col("n")).cast("int").alias("end"), *extra)


def boost_context(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """+0.10 (at most 1) for entities inside one paragraph that holds two or more configuration words.

    Only paragraphs that qualify are kept, and only texts that hold two such words at all are split.
    """
    likely = docs.filter(F.expr(f"{keyword_score('text')} >= 2"))
    blocks = paragraph_blocks(likely, {"score": keyword_score("block")}).filter("score >= 2")
    spans = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("__b"))
    inside = F.exists("__b", lambda b: (F.col("start") >= b["start"]) & (F.col("end") <= b["end"]))
    boosted = F.when(F.coalesce(inside, F.lit(False)), F.least(F.lit(1.0), F.col("confidence") + CONTEXT_BOOST)).otherwise(F.col("confidence"))
    return entities.join(spans, "doc_id", "left").withColumn("confidence", boosted).drop("__b")


def peers_of(category: str) -> list[str]:
    return sorted({c for group in CLUSTER_GROUPS if category in group for c in group if c != category})


def boost_proximity(entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """+0.08 per peer-category entity within 200 characters, at most 1.

    No pairs are formed: each entity asks a running count of its peers' starts up to end + 200 and of
    their ends below start - 200; the difference is the number within reach.
    """
    cats = sorted({c for group in CLUSTER_GROUPS for c in group})

    def point(pos, ask: int, kind: str):
        return F.struct(pos.cast("int").alias("pos"), F.lit(ask).alias("ask"), F.lit(kind).alias("kind"))

    start, end = F.col("start"), F.col("end")
    points = F.array(point(start, 0, "start"), point(end, 0, "end"), point(end + PROXIMITY_WINDOW, 1, "start"),
                     point(start - PROXIMITY_WINDOW - 1, 1, "end"))
    points = F.when(F.col("category").isin(*cats), points).otherwise(F.array(point(start, 1, "alone")))
    rows = by_text(entities, tasks).withColumn("p", F.explode_outer(points))  # one exchange serves all steps by text
    running = W.partitionBy("doc_id", "p.kind").orderBy("p.pos", "p.ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"__n_{c}": F.count_if((F.col("p.ask") == 0) & (F.col("category") == c)).over(running) for c in cats})
    near = F.expr("case category " + " ".join(f"when '{c}' then " + " + ".join(f"__n_{p}" for p in peers_of(c)) for c in cats) + " else 0 end")
    near = F.when(F.col("p.kind") == "start", near).otherwise(-near)
    counted = rows.filter("p.ask = 1").groupBy(*entities.columns).agg(F.sum(near).alias("__near"))
    boosted = F.when(F.col("__near") > 0, F.least(F.lit(1.0), F.col("confidence") + PROXIMITY_BOOST * F.col("__near"))).otherwise(F.col("confidence"))
    return counted.withColumn("confidence", boosted).select(*entities.columns)


def decay_common(entities: DataFrame) -> DataFrame:
    """Half the confidence for common words."""
    common = F.expr(one_of("lower(value)", COMMON_WORDS))
    return entities.withColumn("confidence", F.when(common, F.col("confidence") * 0.5).otherwise(F.col("confidence")))


def propagate_hostnames(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Names given by hostname or switchname lines are found wherever they stand in the same text."""
    low = F.lower("text")
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(HOSTNAME_LINE), F.lit(1)))
    named = docs.filter(low.contains("hostname") | low.contains("switchname")).select("tenant", "doc_id", "text", names.alias("__names"))
    longest_first = F.array_sort("__names", lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest_first, lambda n: F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    named = named.filter(F.size("__names") > 0).select("tenant", "doc_id", "text", F.array_join(quoted, "|").alias("pattern"))
    found = expand_matches(named.withColumn("prio", F.lit(0)), [None], [0], pattern_column="pattern")
    added = (found.withColumn("category", F.lit("hostname")).filter(~is_doc_example("value", "category"))
             .join(entities.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti"))
    added = added.withColumn("confidence", F.lit(0.85)).withColumn("detector", F.lit("context:hostname_propagation"))
    return entities.unionByName(added.select(*ENTITY_COLUMNS))


def learn_entities(entities: DataFrame, cap: int | None = None) -> DataFrame:
    """What a session remembers: (session, value, category, first_seq) from entities with session and seq.

    The value is known from ``first_seq`` on, with the category it had last.  ``cap`` keeps only the
    newest half of a cap that was passed, as bounded memories do; batch jobs need none.
    """
    learnable = F.expr(one_of("detector", LEARNABLE_DETECTORS)) | (F.col("category") == "hostname")
    good = entities.filter((F.col("confidence") >= 0.80) & learnable & (F.length("value") >= 3)
                           & ~F.expr(one_of("lower(value)", COMMON_WORDS)) & ~is_doc_example("value", "category"))
    learned = good.groupBy("session", "value").agg(
        F.max_by("category", F.struct("seq", "start")).alias("category"), F.min("seq").alias("first_seq"))
    if cap is None:
        return learned
    from veilframe.operators.ranks import ordered_rank

    total = learned.groupBy("session").count()
    ranked = ordered_rank(learned, ["session"], [F.col("first_seq").desc(), F.col("value")]).join(total, "session")
    return ranked.filter((F.col("count") <= cap) | (F.col("rank") <= LEARN_KEEP)).drop("rank", "count")


def propagate_learned(docs: DataFrame, learned: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Values learned from earlier texts of a session, found in its later texts (docs with session and seq)."""
    literals = learned.select("session", F.col("value").alias("literal"), "category", "first_seq")
    hits = match_literals(docs, literals, by=("session",), keep=("tenant", "seq"), condition=F.col("first_seq") < F.col("seq"))
    hits = hits.filter(~is_doc_example("value", "category"))
    if entities is not None:
        hits = hits.join(entities.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
    return hits.withColumn("confidence", F.lit(0.80)).withColumn("detector", F.lit("context:learned_entity")).select(*ENTITY_COLUMNS, "session", "seq")


def apply_context(docs: DataFrame, entities: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """The context steps in order: learned values, host names, paragraph boost, proximity boost, decay."""
    if learned is not None:
        entities = entities.unionByName(propagate_learned(docs, learned, entities).select(*ENTITY_COLUMNS))
    entities = propagate_hostnames(docs, entities)
    return decay_common(boost_proximity(boost_context(entities, docs), tasks_by_text(docs)))
