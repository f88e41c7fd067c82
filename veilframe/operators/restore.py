"""Restoring: stand-ins in derived text back to the real values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.functions.ip import compress_ipv6, expand_ipv6
from veilframe.operators.detect import claim_spans, expand_matches
from veilframe.operators.literals import match_literals, standing_free
from veilframe.operators.mapping import reverse_map
from veilframe.operators.rewrite import own_ids, own_rows, splice
from veilframe.operators.subnets import FAKE_ADDRESS, FAKE_RANGE, FAKE_V6, WIDE_PREFIX, residual_ranges, residual_v4


def fake_hits(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stand-ins found in texts: (tenant, doc_id, value, start, end, repl, category); never within a longer number."""
    literals = reverse_map(mapping).select("tenant", F.col("fake").alias("literal"), F.col("real").alias("repl"), "category")
    return match_literals(docs, literals, by=("tenant",), whole=True)


def restore(docs: DataFrame, mapping: DataFrame, out: str = "text_out") -> DataFrame:
    """Every stand-in by its real value: leftmost, longest first, one pass, so nothing is replaced twice."""
    docs, own = own_rows(docs)
    return own_ids(splice(docs, fake_hits(docs, mapping), out), own)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts (tenant, doc_id, text) with their spans (doc_id, start, end) in arrays ``starts`` and ``ends``, in order."""
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__s"))
    none = F.array().cast("array<int>")
    joined = docs.select("tenant", "doc_id", "text").join(per_doc, "doc_id", "left")
    return joined.select("tenant", "doc_id", "text", F.coalesce("__s.start", none).alias("starts"), F.coalesce("__s.end", none).alias("ends"))


def misread_fakes(texts: DataFrame, fakes: DataFrame) -> DataFrame:
    """Stand-ins (tenant, fake) that also stand in the part of the texts which stays as it is.

    Restoring would take those places for stand-ins. ``texts`` come from ``with_spans`` with what will be replaced; spans do
    not overlap, so the last one that starts before a find decides whether it lies inside one.
    """
    found = standing_free(texts, fakes.select("tenant", F.col("fake").alias("literal")), by=("tenant",), whole=True)
    return found.select("tenant", F.col("literal").alias("fake"))


def restore_with_stats(docs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restored texts, and replacements per text and category; texts that share an id are counted apart."""
    docs, own = own_rows(docs)
    hits = fake_hits(docs, mapping)
    counts = hits.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("replacements"))
    return own_ids(splice(docs, hits), own), own_ids(counts, own)


def restore_exact(docs_out: DataFrame, replaced: DataFrame, out: str = "text_restored", text_col: str = "text_out") -> DataFrame:
    """Inverse of our own rewriting from its span manifest (doc_id, start, end, value, repl); no search.

    Spans move by the lengths of the replacements before them.
    """
    before = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("repl") - F.length("value")).over(before), F.lit(0))
    moved = replaced.withColumn("__s", (F.col("start") + shift).cast("int"))
    edits = moved.select("doc_id", F.col("__s").alias("start"), (F.col("__s") + F.length("repl")).cast("int").alias("end"), F.col("value").alias("repl"))
    return splice(docs_out.withColumn("text", F.col(text_col)), edits, out)


def _found(docs: DataFrame, pattern: str, groups: int, marker: Column) -> DataFrame:
    scanned = docs.filter(marker & F.col("text").rlike(pattern)).select("tenant", "doc_id", "text", F.lit(0).alias("prio"))
    return expand_matches(scanned, [pattern], [groups]).select("tenant", "doc_id", "m_no", "grp", "value", "start", "end")


def residual_v6(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unique-local addresses that equal a stand-in once expanded, or a zero-tailed prefix of one."""
    fakes = mapping.filter(F.lower("fake").startswith("fd00") & F.col("fake").contains(":")).select(
        "tenant", expand_ipv6(F.col("fake")).alias("full"), F.col("real").alias("real_v6"))
    fakes = fakes.withColumn("head", F.substring("full", 1, 19))
    asked = found.select("tenant", "value").distinct().withColumn("asked", expand_ipv6(F.col("value")))
    asked = asked.withColumn("head", F.substring("asked", 1, 19))
    pairs = asked.join(fakes, ["tenant", "head"])
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda n: F.substring_index("full", ":", 1).isNotNull() & (
        F.array_join(F.slice(F.split("full", ":"), 1, n), ":") == F.array_join(F.slice(F.split("asked", ":"), 1, n), ":"))))
    pairs = pairs.withColumn("same", same)
    tail_zero = F.forall(F.slice(F.split("asked", ":"), F.col("same") + 1, F.lit(8)), lambda g: g == "0000")
    rebuilt = compress_ipv6(F.array_join(F.concat(
        F.slice(F.split(expand_ipv6(F.col("real_v6")), ":"), F.lit(1), F.col("same")),
        F.slice(F.split("asked", ":"), F.col("same") + 1, F.lit(8))), ":"))
    repl = F.when(F.col("same") == 8, F.col("real_v6")).when(tail_zero, rebuilt)
    best = (pairs.withColumn("repl", repl).filter("repl is not null").groupBy("tenant", "value")
            .agg(F.max_by("repl", F.struct("same", "full")).alias("repl")))
    return found.join(best, ["tenant", "value"])


def restore_derived(docs: DataFrame, mapping: DataFrame, subnets: DataFrame | None = None, ranges: bool = False,
                    out: str = "text_out") -> tuple[DataFrame, DataFrame]:
    """Restore text that others derived from ours: stand-ins, then addresses made up inside fake subnets,
    shortened IPv6 forms and, only on request, descriptions of the whole fake range.

    All finds refer to the same text and earlier kinds win, so restored values are never rewritten.
    Returns the texts and the list of edits (with ``kind``).
    """
    docs, own = own_rows(docs)
    kinds = [fake_hits(docs, mapping).select("tenant", "doc_id", "value", "start", "end", "repl", F.lit(0).alias("prio"))]
    v6 = residual_v6(_found(docs, FAKE_V6, 0, F.lower("text").contains("fd00")), mapping)
    kinds.append(v6.select("tenant", "doc_id", "value", "start", "end", "repl", F.lit(2).alias("prio")))
    if subnets is not None:
        single = FAKE_ADDRESS + (WIDE_PREFIX if ranges else "")
        v4 = residual_v4(_found(docs, single, 1, F.col("text").rlike(r"\d\.\d")), subnets)
        kinds.append(v4.select("tenant", "doc_id", "value", "start", "end", "repl", F.lit(1).alias("prio")))
        if ranges:
            wide = residual_ranges(_found(docs, FAKE_RANGE, 0, F.col("text").contains("100.")), subnets)
            kinds.append(wide.select("tenant", "doc_id", "value", "start", "end", "repl", F.lit(3).alias("prio")))
    edits = kinds[0]
    for frame in kinds[1:]:
        edits = edits.unionByName(frame)
    edits = claim_spans(edits.withColumns({"m_no": F.col("start"), "grp": F.lit(0)}), strict=True).drop("m_no", "grp")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("known", "residual_v4", "residual_v6", "range")]), F.col("prio") + 1)
    edits = edits.withColumn("kind", kind)
    return own_ids(splice(docs, edits, out), own), own_ids(edits, own)


def restore_json(docs: DataFrame, mapping: DataFrame, out: str = "text_out") -> DataFrame:
    """Restore inside serialised JSON: real values are escaped first, and text that would no longer parse is kept."""
    escaped = F.expr("substring(to_json(named_struct('v', real)), 7, length(to_json(named_struct('v', real))) - 8)")
    done = restore(docs, mapping.withColumn("real", escaped), "__restored")
    still_json = F.expr("try_parse_json(__restored) is not null")
    return done.withColumn(out, F.when(still_json, F.col("__restored")).otherwise(F.col("text"))).drop("__restored")


def strip_canary(text: Column, prefix: str) -> Column:
    """Remove canary comments."""
    return F.regexp_replace(text, f"\\n?<!-- \\Q{prefix}\\E-[a-f0-9]+ -->", "")
