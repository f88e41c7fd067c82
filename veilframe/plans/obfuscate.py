"""The whole job: detect, filter, mint, rewrite; and mixed batches of both directions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.keyed import Keys
from veilframe.functions.text import strip_chat_links
from veilframe.operators.code import detect_in_code
from veilframe.operators.context import apply_context
from veilframe.operators.detect import detect_custom, detect_regex, resolve_overlaps, tasks_by_text, union_entities
from veilframe.operators.filters import filter_stats, with_drop_reason
from veilframe.operators.literals import detect_denylist
from veilframe.operators.mapping import distinct_values, fix_collisions, mint, upsert_store
from veilframe.operators.restore import fake_hits, misread_fakes, with_spans
from veilframe.operators.rewrite import own_ids, own_rows, replacements, splice
from veilframe.operators.rules import Rule
from veilframe.operators.subnets import learn_subnets
from veilframe.session import materialize


@dataclass(frozen=True)
class Config:
    """Parameters of a job.  Lists are driver-side settings; tables go to the operators themselves."""

    keys: Keys = Keys("change-me")
    rules: list[Rule] | None = None
    min_confidence: float = 0.0
    allowlist: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    exempt: tuple[str, ...] = ()
    custom_patterns: tuple[dict, ...] = ()
    generators: dict[str, str] = field(default_factory=dict)
    detectors: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    level: str = "full"  # full, masked or stats
    unambiguous: bool = True  # no stand-in equals something that the texts keep, so restoring finds stand-ins only
    dry_run: bool = False
    context: bool = True
    code: bool = True
    include_doc_examples: bool = False
    resolved_public: DataFrame | None = None

    def __post_init__(self):
        if self.level not in ("full", "masked", "stats"):
            raise ValueError("level must be full, masked or stats")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must lie between 0 and 1")

    def register_detector(self, detect: Callable[[DataFrame], DataFrame]) -> "Config":
        """Add a detector: a function from docs to entities."""
        return Config(**{**self.__dict__, "detectors": (*self.detectors, detect)})

    def register_generator(self, category: str, sql: str) -> "Config":
        """Use an SQL expression over value, seed, h and d for a category."""
        return Config(**{**self.__dict__, "generators": {**self.generators, category: sql}})


@dataclass(frozen=True)
class Result:
    docs: DataFrame  # tenant, doc_id, text (as scanned), text_out
    entities: DataFrame  # replaced entities, with fake and repl unless dry run
    judged: DataFrame  # all resolved entities with drop_reason
    mapping: DataFrame | None
    subnets: DataFrame | None
    stats: DataFrame


def detect_all(docs: DataFrame, config: Config, learned: DataFrame | None = None) -> DataFrame:
    """All detectors over clean text, overlaps resolved."""
    found = detect_regex(docs, config.rules, config.include_doc_examples, config.resolved_public, tasks=tasks_by_text(docs))
    if config.context:
        # the context steps read the rule findings several times: keep them, they are small
        found = apply_context(docs, materialize(found, "found"), learned)
    frames = [found]
    if config.custom_patterns:
        frames.append(detect_custom(docs, list(config.custom_patterns)))
    if config.code:
        frames.append(detect_in_code(docs, config.rules))
    if config.denylist:
        frames.append(detect_denylist(docs, list(config.denylist)))
    frames += [detect(docs) for detect in config.detectors]
    return resolve_overlaps(union_entities(*frames))


def clean_docs(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.when(F.col("text").contains("<"), strip_chat_links(F.col("text"))).otherwise(F.col("text")))


def obfuscate(docs: DataFrame, config: Config, store: DataFrame | None = None, existing_subnets: DataFrame | None = None,
              learned: DataFrame | None = None) -> Result:
    """Replace what the detectors find.

    The texts are scanned once; entities and distinct values are small tables written to the shared
    folder, so a lost executor costs its own tasks only.  Values already in ``store`` keep their stand-in.
    Rows that repeat a ``doc_id``, in one tenant or several, are texts of their own.
    """
    docs, own = own_rows(clean_docs(docs))
    judged = materialize(with_drop_reason(detect_all(docs, config, learned), config.min_confidence, list(config.exempt),
                                          list(config.allowlist), store), "entities")
    kept = judged.filter("drop_reason is null").drop("drop_reason")
    stats = filter_stats(judged)
    if config.dry_run:
        return Result(own_ids(docs.withColumn("text_out", F.col("text")), own), own_ids(kept, own), own_ids(judged, own), store, existing_subnets, stats)
    values = distinct_values(kept)
    if store is not None:
        values = values.join(store.select("tenant", F.col("real").alias("value")), ["tenant", "value"], "left_anti")
    values = materialize(values, "values")
    categories = sorted(r[0] for r in values.select("category").distinct().collect())  # at most one per category
    known = learn_subnets(docs) if "ip_address" in categories else None
    if known is not None:
        known = materialize(known, "known")
    minted, subnets = mint(values, config.keys, known, existing_subnets, categories, config.generators)
    reversible = config.level == "full" and config.unambiguous
    misread = None
    if reversible:  # each round of stand-ins reads the texts and what will be replaced in them once more
        texts = materialize(with_spans(docs, kept.select("doc_id", "start", "end")), "covered")
        misread = lambda fakes: misread_fakes(texts, fakes)
    mapping = fix_collisions(minted, config.keys, store, config.generators, misread)
    if store is not None:
        mapping = upsert_store(store, mapping)
    replaced = replacements(kept, mapping, config.level)
    return Result(own_ids(splice(docs, replaced), own), own_ids(replaced, own), own_ids(judged, own), mapping, subnets if subnets is not None else existing_subnets, stats)


def process_batch(ops: DataFrame, config: Config, store: DataFrame | None = None) -> DataFrame:
    """Mixed operations (idx, tenant, direction, text): obfuscate, restore, anything else is an error row.

    Restores see the mappings that the same batch minted.
    """
    ops = materialize(ops.withColumn("__row", F.monotonically_increasing_id()), "ops")  # idx repeats between requests
    docs = ops.select("tenant", F.col("__row").alias("doc_id"), "text", "direction")
    forward = obfuscate(docs.filter("direction = 'obfuscate'").select("tenant", "doc_id", "text"), config, store)
    counts = forward.entities.groupBy("doc_id", "category").count().groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("categories"),
        F.sum("count").alias("n"))
    done = forward.docs.join(counts, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.lit("obfuscate").alias("direction"), F.col("text_out").alias("text"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "categories", (F.col("text") != F.col("text_out")).alias("modified"),
        F.lit(None).cast("string").alias("error"))
    asked = docs.filter("direction = 'deobfuscate'").select("tenant", "doc_id", "text")
    hits = materialize(fake_hits(asked, forward.mapping), "hits")
    per_doc = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    back = splice(asked, hits).join(per_doc, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.lit("deobfuscate").alias("direction"), F.col("text_out").alias("text"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.lit(None).cast("map<string,bigint>").alias("categories"),
        (F.col("text") != F.col("text_out")).alias("modified"), F.lit(None).cast("string").alias("error"))
    other = docs.filter("direction not in ('obfuscate', 'deobfuscate')").select(
        F.col("doc_id").alias("idx"), "direction", F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("map<string,bigint>").alias("categories"), F.lit(None).cast("boolean").alias("modified"),
        F.concat(F.lit("Unknown direction: "), "direction").alias("error"))
    own = ops.select(F.col("__row").alias("idx"), F.col("idx").alias("__own"))
    out = done.unionByName(back).unionByName(other)
    return out.join(own, "idx").withColumn("idx", F.col("__own")).select(*out.columns).orderBy("idx")
