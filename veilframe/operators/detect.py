"""Detection: text rows to entity rows.

``docs`` has (tenant, doc_id, text); ``entities`` has (tenant, doc_id, value, start, end, category,
confidence, detector), offsets in code points.  The text itself never crosses a shuffle: rules run as
a projection over the scan, and only the small match rows are exchanged, once, by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.functions.ip import is_mask
from veilframe.functions.sql import sql_array, sql_text
from veilframe.operators.examples import is_doc_example
from veilframe.operators.rules import BUILTIN, GATES, Rule, guard, java_pattern

ENTITY_COLUMNS = ["tenant", "doc_id", "value", "start", "end", "category", "confidence", "detector"]


def as_docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tenant: str | Column = "") -> DataFrame:
    """Any table with an id and a text column as ``docs``."""
    tenant = F.lit(tenant) if isinstance(tenant, str) else tenant
    return df.select(tenant.alias("tenant"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")


SCAN_ROWS, MATCH_ROWS = 5_000, 20_000  # texts per task of a scan with many rules, and of what follows by text


def spread(docs: DataFrame) -> DataFrame:
    """Deal texts by their id to all cores at least, and to so many tasks that none gets more the larger the table is.

    The splits of a file say little about its rows: a row group goes to one of them as a whole.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores, -(-docs.count() // SCAN_ROWS)), "doc_id")


def tasks_by_text(docs: DataFrame) -> int | None:
    """Number of tasks for steps by text, where it passes the session's; else null: the session's, joined when small."""
    n = -(-docs.count() // MATCH_ROWS)
    return n if n > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def by_text(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.repartition(tasks, "doc_id") if tasks else rows.repartition("doc_id")


def by_rule(values: list) -> Column:
    """Constant of a rule, looked up by its number in column ``prio``."""
    return F.expr(f"element_at({sql_array(values)}, prio + 1)")


def by_halves(choices: list[str], first: int = 0) -> str:
    """The expression that ``prio`` numbers, found by halves: a list of cases would be walked through for every row."""
    if len(choices) == 1:
        return choices[0]
    half = len(choices) // 2
    return f"if(prio < {first + half}, {by_halves(choices[:half], first)}, {by_halves(choices[half:], first + half)})"


def raw_matches(docs: DataFrame, rules: list[Rule], tasks: int | None = None) -> DataFrame:
    """Every match of every rule: (tenant, doc_id, prio, m_no, grp, value, start, end), nothing resolved.

    ``tasks`` is the number for what follows by text. Guards and ``rlike`` pick the rules that hit a text; only those are expanded, and only their
    matches leave the row.
    """
    hits = []
    for i, rule in enumerate(rules):
        test = f"text rlike {sql_text(java_pattern(rule))}"
        cheap = guard(rule)
        hits.append(f"case when {test if cheap is None else f'{cheap} and {test}'} then {i} end")
    scanned = (
        docs.select("tenant", "doc_id", "text", F.lower("text").alias("__lower"), F.col("text").rlike("[0-9]").alias("__digit"),
                    *[F.col("text").contains(c).alias(name) for c, name in GATES.items()])
        # all tests are one generated projection: inside a lambda (array_compact has one) they would be interpreted. The lambda
        # around the text only keeps the projection out of a whole stage, where its code would not be cut into methods
        .select("tenant", "doc_id", F.transform(F.array("text"), lambda t: t)[0].alias("text"), F.expr(f"array({', '.join(hits)})").alias("__hits"))
        # the outer form keeps the optimiser from evaluating the rules a second time in a size() filter
        .select("tenant", "doc_id", "text", F.explode_outer("__hits").alias("prio")).filter("prio is not null")
    )
    return expand_matches(scanned, [java_pattern(r) for r in rules], [r.groups for r in rules], tasks=tasks)


MARK = "\ufdd0"  # a code point that Unicode keeps from texts; where a text holds it, a hash of the text follows


def expand_matches(scanned: DataFrame, patterns: list[str], groups: list[int], pattern_column: str | None = None,
                   tasks: int | None = None) -> DataFrame:
    """Match rows with offsets for (text, prio) pairs known to match pattern number ``prio``.

    One replacement marks the matches and their groups, and the text is cut at the marks. Each pattern is a constant of
    its own branch, so it is compiled once a task. With ``pattern_column`` every row brings its own pattern.
    """
    def marked(pattern: str, n: int) -> str:
        return f"regexp_replace(text, {pattern}, concat(m, {', '.join(f"'${g}', m" for g in range(min(n, 2) + 1))}))"

    if pattern_column:
        choice = marked(pattern_column, groups[0])
    else:
        choice = by_halves([marked(sql_text(p), n) for p, n in zip(patterns, groups)])
    mark = F.when(F.col("text").contains(MARK), F.concat(F.lit(MARK), F.sha2("text", 256))).otherwise(F.lit(MARK))
    rows = scanned.withColumns({"__mark": mark, "__groups": by_rule([min(n, 2) for n in groups])})
    # a lambda is not compiled: as generated code the branches would pass what the JVM takes as one method
    rows = rows.withColumn("__marked", F.expr(f"transform(array(__mark), m -> {choice})[0]"))
    rows = rows.select("tenant", "doc_id", "prio", "__groups", F.split("__marked", F.col("__mark"), -1).alias("__cut"))
    # text before the match, match, groups; the text between matches gives exact offsets, whatever look-around the pattern uses
    found = F.expr("""case when size(__cut) > 1 then transform(sequence(0, size(__cut) - 2, __groups + 2), at -> named_struct(
        'full', __cut[at + 1], 'g1', case when __groups >= 1 then __cut[at + 2] end, 'g2', case when __groups >= 2 then __cut[at + 3] end,
        'gap', length(__cut[at]))) end""")
    rows = rows.select("tenant", "doc_id", "prio", "__groups", F.posexplode_outer(found).alias("m_no", "m")).filter("m.full is not null")
    # one exchange for everything that follows: claims, context, overlaps all work per document
    rows = by_text(rows, tasks)
    before = W.partitionBy("doc_id", "prio").orderBy("m_no").rowsBetween(W.unboundedPreceding, -1)
    m_start = F.col("m.gap") + F.coalesce(F.sum(F.col("m.gap") + F.length("m.full")).over(before), F.lit(0))
    rows = rows.select("tenant", "doc_id", "prio", "m_no", "__groups", "m", m_start.cast("int").alias("m_start"))
    p1 = F.instr(F.col("m.full"), F.col("m.g1"))
    p2 = F.call_function("locate", F.col("m.g2"), F.col("m.full"), p1 + F.length("m.g1"))

    def part(no, value, start):
        return F.struct(F.lit(no).alias("grp"), value.alias("value"), (F.col("m_start") + start).cast("int").alias("start"))

    parts = (
        F.when(F.col("__groups") == 0, F.array(part(0, F.col("m.full"), F.lit(0))))
        .when(F.col("__groups") == 1, F.array(part(1, F.col("m.g1"), p1 - 1)))
        .otherwise(F.array(part(1, F.col("m.g1"), p1 - 1), part(2, F.col("m.g2"), p2 - 1)))
    )
    return (
        rows.select("tenant", "doc_id", "prio", "m_no", F.inline_outer(parts))
        .filter(F.length("value") > 0)
        .withColumn("end", (F.col("start") + F.length("value")).cast("int"))
    )


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Number the runs of touching spans within each key (column ``island``); runs never interact."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        spans.withColumn("__new", F.when(F.col("start") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
        .withColumn("island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .drop("__new")
    )


def claim_spans(matches: DataFrame, keys: tuple[str, ...] = ("doc_id",), strict: bool = False) -> DataFrame:
    """Greedy claims in rule order: a match falls when its start or end lies inside a claimed span.

    A match around a claimed span stays, unless ``strict``.  Touching spans are folded island by island, so the work per
    group is the number of spans that really overlap, not the size of the document.
    """
    payload = [c for c in matches.columns if c not in keys]
    order = ["prio", "m_no", "grp"] + [c for c in payload if c not in ("prio", "m_no", "grp")]
    grouped = islands(matches, list(keys)).groupBy(*keys, "island").agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("__spans"))

    def claimed(kept: Column, x: Column) -> Column:
        if strict:
            return F.exists(kept, lambda c: (c["start"] < x["end"]) & (x["start"] < c["end"]))
        return F.exists(kept, lambda c: ((c["start"] <= x["start"]) & (x["start"] < c["end"]))
                        | ((c["start"] < x["end"]) & (x["end"] <= c["end"])))

    kept = F.aggregate(
        "__spans", F.slice("__spans", 1, 0), lambda acc, x: F.when(claimed(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.when(F.size("__spans") == 1, F.col("__spans")).otherwise(kept)
    return grouped.select(*keys, F.inline_outer(kept)).select(*matches.columns)


def detect_regex(docs: DataFrame, rules: list[Rule] | None = None, include_doc_examples: bool = False,
                 resolved_public: DataFrame | None = None, extra_keys: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Run the rules and claim spans in rule order.

    Masks neither match nor claim; documentation values claim their span but are not reported (unless
    ``include_doc_examples``).  ``resolved_public`` (host) adds hosts known to be public.
    ``tasks`` is the number of tasks by text, see ``tasks_by_text``.
    """
    rules = BUILTIN if rules is None else rules
    matches = raw_matches(docs, rules, tasks)
    category = by_rule([r.category for r in rules])
    matches = matches.withColumn("category", category)
    matches = matches.filter(~((F.col("category") == "ip_address") & is_mask("value")))
    is_doc = F.lit(False) if include_doc_examples else is_doc_example("value", "category")
    matches = matches.withColumn("is_doc", is_doc)
    if resolved_public is not None and not include_doc_examples:
        matches = mark_resolved_public(matches, resolved_public)
    return with_rule_columns(claim_spans(matches).filter("not is_doc"), rules)


def mark_resolved_public(matches: DataFrame, resolved_public: DataFrame) -> DataFrame:
    from veilframe.functions.hosts import extract_fqdn

    first_segment = F.split_part(F.col("value"), F.lit("/"), F.lit(2))
    host = F.when(F.col("category") == "url", extract_fqdn(F.col("value"))).when(
        (F.col("category") == "file_path") & first_segment.contains("."), F.lower(first_segment))
    public = resolved_public.select(F.col("host").alias("__host"), F.lit(True).alias("__public")).distinct()
    return (
        matches.withColumn("__h", host).join(public, F.col("__h") == F.col("__host"), "left")
        .withColumn("is_doc", F.col("is_doc") | F.coalesce("__public", F.lit(False))).drop("__h", "__host", "__public")
    )


def with_rule_columns(matches: DataFrame, rules: list[Rule]) -> DataFrame:
    return matches.select(
        "tenant", "doc_id", "value", "start", "end", "category",
        by_rule([float(r.confidence) for r in rules]).alias("confidence"), by_rule([r.label.replace("~", "") for r in rules]).alias("detector"),
    )


def custom_rules(patterns: list[dict]) -> list[Rule]:
    """User patterns: whole match only, confidence 0.9, unknown categories become ``custom``."""
    from veilframe.operators.rules import CATEGORIES

    return [
        Rule(p["name"], p.get("category") if p.get("category") in CATEGORIES else "custom", 0.9, "", p["pattern"],
             f"custom:{p['name']}", True)
        for p in patterns
    ]


def detect_custom(docs: DataFrame, patterns: list[dict]) -> DataFrame:
    """User patterns with their own claims; no mask or documentation test."""
    rules = [Rule("~" + r.name, r.category, r.confidence, r.flags, r.pattern, r.detector, True) for r in custom_rules(patterns)]
    matches = raw_matches(docs, rules).withColumn("category", by_rule([r.category for r in rules]))
    return with_rule_columns(claim_spans(matches), rules)


SOURCE_ORDER = ["regex", "context", "custom", "code", "denylist"]


def sweep(spans: DataFrame, order: list[Column], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Left-to-right choice: earliest start first, then ``order``; keep what starts after the last kept end."""
    payload = [c for c in spans.columns if c not in keys and c != "start"]
    extra = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    grouped = islands(spans, list(keys)).groupBy(*keys, "island").agg(
        F.array_sort(F.collect_list(F.struct("start", *extra, *payload))).alias("__spans"))
    kept = F.aggregate(
        "__spans", F.slice("__spans", 1, 1),
        lambda acc, x: F.when(x["start"] >= F.element_at(acc, -1)["end"], F.concat(acc, F.array(x))).otherwise(acc))
    kept = F.when(F.size("__spans") == 1, F.col("__spans")).otherwise(kept)
    return grouped.select(*keys, F.inline_outer(kept)).select(*spans.columns)


def resolve_overlaps(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Earliest start wins; at the same start the higher confidence, then the detector order."""
    source = F.expr(f"array_position({sql_array(SOURCE_ORDER)}, split_part(detector, ':', 1))")
    return sweep(entities, [-F.col("confidence"), source], keys)


def union_entities(*frames: DataFrame) -> DataFrame:
    out = frames[0].select(*ENTITY_COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*ENTITY_COLUMNS))
    return out
