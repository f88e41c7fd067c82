"""What users bring to a job: rule files, detectors and generators of their own, and the files that a job leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import D_PII, KEYS, entities_sql, material_duck, pii_docs, query, resolved_sql
from veilframe.operators import detect, filters, rules as R
from veilframe.plans import corpora as C
from veilframe.plans.obfuscate import Config, obfuscate
from veilframe.session import shared_dir
from veilframe.sources import readers


def folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- rule files ------------------------------------------------------------------------------------

SHIPPED = "select o_orderkey as doc_id, concat('order ', cast(o_orderkey as varchar), ' for ', c_name, ' ships to ', n_name, ', answer to clerk', cast(o_orderkey as varchar), '@host.biz') as text from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


@query("rules_file", f"""select doc_id, n_name as value, 'location' as category, 0.7 as confidence, 'regex:nation ' || cast(n_nationkey as varchar) as detector
 from ({SHIPPED}) d join nation on contains(text, ' ' || n_name || ',') where n_nationkey % 7 <> 3
 union all select doc_id, 'clerk' || cast(doc_id as varchar) || '@host.biz', 'email', 0.55, 'regex:email' from ({SHIPPED}) d""")
def rules_file(spark, sf_dir):
    """An overlay written from the table of nations: a rule each, some switched off, the one for addresses less sure."""
    off = F.col("n_nationkey") % 7 == 3
    own = C.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("name"),
        F.struct((~off).alias("enabled"), F.concat(F.lit("(?<= to )"), "n_name", F.lit("(?=,)")).alias("pattern"), F.lit("location").alias("category"), F.lit(0.7).alias("confidence")).alias("change"))
    changed = spark.range(1).select(F.lit("email").alias("name"), F.struct(
        F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("category"), F.lit(0.55).alias("confidence")).alias("change"))
    overlay = own.unionByName(changed).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "change")))).alias("value"))
    path = folder(spark, "rules")
    overlay.coalesce(1).write.text(path)
    rules = readers.read_rules(spark, path, R.named("email", "ssn"))
    found = detect.detect_regex(C.docs_of(C.corpus(spark, sf_dir, SHIPPED, ("orders", "customer", "nation"))), rules)
    return found.select("doc_id", "value", "category", "confidence", "detector")


# --- counters as a file ------------------------------------------------------------------------------

STAT_RULES = R.named("email", "ssn", "credit_card")


@query("stats_file", f"""with recursive {entities_sql(D_PII, STAT_RULES)}, {resolved_sql()}
 select doc_id, count(*) as total_detected, count(*) filter (where category <> 'ssn') as replaced, count(*) filter (where category = 'ssn') as exempted, '2026-01-01T00:00:00Z' as updated_at
 from resolved group by doc_id""")
def stats_file(spark, sf_dir):
    """Counters written by a job and read back."""
    judged = filters.with_drop_reason(detect.resolve_overlaps(detect.detect_regex(pii_docs(spark, sf_dir), STAT_RULES)), 0.0, ["ssn"], [])
    path = folder(spark, "stats")
    readers.write_stats(filters.filter_stats(judged), path, "2026-01-01T00:00:00Z")
    schema = "doc_id bigint, total_detected bigint, replaced bigint, exempted bigint, updated_at string"
    return spark.read.schema(schema).json(path)


# --- detectors and generators ------------------------------------------------------------------------

BADGES = "select c_custkey as doc_id, concat('badge EMP-', lpad(cast(c_custkey as varchar), 6, '0'), ' of ', c_name, ' opens door ', cast(c_nationkey as varchar), '; EMP-', lpad(cast(c_custkey % 10 as varchar), 6, '0'), ' too') as text from customer"
BADGE_FAKE = "concat('GUEST-', substring(h, 1, 16))"


def badges(docs):
    """A detector as users write it: docs to entities."""
    places = detect.expand_matches(docs.filter(F.col("text").contains("EMP-")).select("tenant", "doc_id", "text", F.lit(0).alias("prio")), ["EMP-[0-9]{6}"], [0])
    return places.select("tenant", "doc_id", "value", "start", "end", F.lit("custom").alias("category"), F.lit(1.0).alias("confidence"), F.lit("badge").alias("detector")).select(*detect.ENTITY_COLUMNS)


@query("own_detector", f"""with fakes as (select value, 'GUEST-' || substr(h, 1, 16) as fake from {material_duck(f"(select distinct unnest(regexp_extract_all(text, 'EMP-[0-9]+')) as value, 'custom' as category from ({BADGES}) b)")} m)
 select doc_id, replace(replace(text, a.value, a.fake), b.value, b.fake) as text_out from ({BADGES}) d
 join fakes a on a.value = regexp_extract_all(text, 'EMP-[0-9]+')[1] join fakes b on b.value = regexp_extract_all(text, 'EMP-[0-9]+')[2]""")
def own_detector(spark, sf_dir):
    """A detector and a generator of the user's own take part in the whole job."""
    config = Config(KEYS, R.named("email", "ssn"), context=False, code=False).register_detector(badges).register_generator("custom", BADGE_FAKE)
    return obfuscate(C.docs_of(C.corpus(spark, sf_dir, BADGES, ("customer",))), config).docs.select("doc_id", "text_out")
