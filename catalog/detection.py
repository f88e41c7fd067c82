"""Detection, filters and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (D_ALL, D_DOCS, D_NET, D_PII, D_SECRET, D_VENDOR, MASK, all_docs, doc_sql, documents, entities_sql, net_docs, parts_sql, pii_docs, plain, q,
                          query, resolved_sql, secret_docs, vendor_docs)
from veilframe.operators import code, context, detect, filters, literals, rules as R

SOURCES = {
    "core": (all_docs, D_ALL), "keys": (secret_docs, D_SECRET), "web": (secret_docs, D_SECRET), "network": (net_docs, D_NET),
    "regulated": (pii_docs, D_PII), "vendor": (vendor_docs, D_VENDOR), "plant": (secret_docs, D_SECRET), "prose": (secret_docs, D_SECRET),
    "health": (pii_docs, D_PII), "finance": (pii_docs, D_PII), "legal": (all_docs, D_ALL), "cloud": (secret_docs, D_SECRET),
}


def counted(matches, rules):
    rule = detect.by_rule([r.name for r in rules]).alias("rule")
    return matches.select(rule, "value").groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n"))


def _family(name):
    make, docs = SOURCES[name]
    rules = plain(R.family(name))
    oracle = f"with {parts_sql(docs, rules)} select rule, value, count(*) as n from parts group by rule, value"

    @query(f"detect_{name}", oracle)
    def run(spark, sf_dir):
        return counted(detect.raw_matches(make(spark, sf_dir), rules), rules)


for _name in SOURCES:
    _family(_name)


@query("detect_lookaround")
def detect_lookaround(spark, sf_dir):
    rules = [r for r in R.BUILTIN if r not in plain(R.BUILTIN)]
    return counted(detect.raw_matches(all_docs(spark, sf_dir), rules), rules)


def _single(name, rule, docs=D_DOCS, make=documents):
    rules = R.named(rule)

    @query(name, f"with {parts_sql(docs, rules)} select doc_id, value, cast(s as bigint) as start_at, e as end_at from parts")
    def run(spark, sf_dir):
        return detect.raw_matches(make(spark, sf_dir), rules).select(
            "doc_id", "value", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"))


for _q, _r in (("detect_ipv4", "ipv4"), ("detect_phone", "phone_us"), ("detect_card", "credit_card"), ("detect_email_all", "email")):
    _single(_q, _r)
_single("emit_groups", "snmp_community", D_NET, net_docs)

ENTITY_COLS = ("select doc_id, value, cast(s as bigint) as start_at, e as end_at, category, "
               "round(confidence, 4) as confidence, detector from ")


def shaped(entities):
    return entities.select("doc_id", "value", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"),
                           "category", F.round("confidence", 4).alias("confidence"), "detector")


PLAIN = plain(R.BUILTIN)
NET_RULES = plain(R.family("network", "web", "core"))
PII_RULES = plain(R.family("core", "web", "regulated", "health", "finance", "legal"))


@query("claim_documents", f"with recursive {entities_sql(D_DOCS, PLAIN)} {ENTITY_COLS} ents")
def claim_documents(spark, sf_dir):
    return shaped(detect.detect_regex(documents(spark, sf_dir), PLAIN))


@query("claim_network", f"with recursive {entities_sql(D_NET, NET_RULES)} {ENTITY_COLS} ents")
def claim_network(spark, sf_dir):
    return shaped(detect.detect_regex(net_docs(spark, sf_dir), NET_RULES))


@query("claim_personal", f"with recursive {entities_sql(D_PII, PII_RULES)} {ENTITY_COLS} ents")
def claim_personal(spark, sf_dir):
    return shaped(detect.detect_regex(pii_docs(spark, sf_dir), PII_RULES))


VENDOR_RULES = plain(R.family("network", "vendor"))


@query("claim_vendor", f"with recursive {entities_sql(D_VENDOR, VENDOR_RULES)} {ENTITY_COLS} ents")
def claim_vendor(spark, sf_dir):
    return shaped(detect.detect_regex(vendor_docs(spark, sf_dir), VENDOR_RULES))


SECRET_RULES = plain(R.family("core", "keys", "web", "plant", "prose", "cloud"))


@query("resolve_overlaps", f"with recursive {entities_sql(D_SECRET, SECRET_RULES)}, {resolved_sql()} {ENTITY_COLS} resolved")
def resolve_overlaps(spark, sf_dir):
    docs = secret_docs(spark, sf_dir)
    return shaped(detect.resolve_overlaps(detect.detect_regex(docs, SECRET_RULES, tasks=detect.tasks_by_text(docs))))


@query("doc_filter", f"with {parts_sql(D_SECRET, R.named('email', 'url'))}, j as (select *, " + doc_sql()
       + " as is_doc from parts) select category, is_doc, count(*) as n from j group by category, is_doc")
def doc_filter(spark, sf_dir):
    from veilframe.operators.examples import is_doc_example

    rules = R.named("email", "url")
    m = detect.raw_matches(secret_docs(spark, sf_dir), rules).withColumn("category", detect.by_rule([r.category for r in rules]))
    return m.withColumn("is_doc", is_doc_example("value", "category")).groupBy("category", "is_doc").agg(F.count(F.lit(1)).alias("n"))


@query("mask_filter", f"with {parts_sql(D_NET, R.named('ipv4'))}, j as (select value, " + MASK
       + " as mask from parts) select value, mask, count(*) as n from j group by value, mask")
def mask_filter(spark, sf_dir):
    from veilframe.functions.ip import is_mask

    m = detect.raw_matches(net_docs(spark, sf_dir), R.named("ipv4"))
    return m.withColumn("mask", is_mask("value")).groupBy("value", "mask").agg(F.count(F.lit(1)).alias("n"))


TOKEN = [{"name": "quoted_token", "pattern": 'token = "[0-9a-f]{40}"', "category": "api_key"}]
TOKEN_RULES = [R.Rule("quoted_token", "api_key", 0.9, "", TOKEN[0]["pattern"], "custom:quoted_token")]


@query("custom_token", f"with {parts_sql(D_DOCS, TOKEN_RULES)} {ENTITY_COLS} parts")
def custom_token(spark, sf_dir):
    return shaped(detect.detect_custom(documents(spark, sf_dir), TOKEN))


DENY = ["the", "License", "Apache License", "eau"]
DENY_RULES = [R.Rule("deny", "custom", 1.0, "", "Apache License|License|the|eau", "denylist")]


@query("denylist_scan", f"with {parts_sql(D_DOCS, DENY_RULES)} select doc_id, value, count(*) as n, min(s) as first_at, max(s) as last_at from parts group by doc_id, value")
def denylist_scan(spark, sf_dir):
    hits = literals.detect_denylist(documents(spark, sf_dir), DENY)
    return hits.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("bigint").alias("first_at"), F.max("start").cast("bigint").alias("last_at"))


LIT_TEXT = """select o_orderkey as doc_id, concat('by Customer#', lpad(cast(o_custkey as varchar), 9, '0'), ', not Customer#', lpad(cast(o_custkey * 2 as varchar), 9, '0'), '!') as text from orders"""


@query("literal_join", f"""with found as (select doc_id, unnest(regexp_extract_all(text, 'Customer#[0-9]{{9}}')) as literal from ({LIT_TEXT}) t)
 select literal, count(*) as hits from found join customer on c_name = literal group by literal""")
def literal_join(spark, sf_dir):
    from veilframe.plans import corpora as C

    docs = C.corpus(spark, sf_dir, LIT_TEXT, ("orders",))
    names = C.table(spark, sf_dir, "customer").select(F.col("c_name").alias("literal"))
    return literals.match_literals(docs, names).groupBy(F.col("value").alias("literal")).agg(F.count(F.lit(1)).alias("hits"))


# --- filters -------------------------------------------------------------------------------------

F_ENTS = f"with recursive {entities_sql(D_PII, PII_RULES)}, {resolved_sql()}"


def pii_resolved(spark, sf_dir):
    docs = pii_docs(spark, sf_dir)
    return detect.resolve_overlaps(detect.detect_regex(docs, PII_RULES, tasks=detect.tasks_by_text(docs)))


@query("min_confidence", f"{F_ENTS} select category, count(*) as n from resolved where confidence >= 0.9 group by category")
def min_confidence(spark, sf_dir):
    return filters.min_confidence(pii_resolved(spark, sf_dir), 0.9).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("exempt_categories", f"{F_ENTS} select category, count(*) as n from resolved where category not in ('email', 'phone') group by category")
def exempt_categories(spark, sf_dir):
    exempt = spark.createDataFrame([("email",), ("phone",)], "category string")
    return filters.exempt_categories(pii_resolved(spark, sf_dir), exempt).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("allow_exact", f"{F_ENTS} select count(*) as n, count(distinct value) as v from resolved where value not in (select lpad(cast(c_custkey as varchar), 10, '17') from customer where c_mktsegment = 'MACHINERY')")
def allow_exact(spark, sf_dir):
    from veilframe.plans.corpora import table

    allowed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.expr("lpad(cast(c_custkey as string), 10, '17')").alias("value"))
    return filters.allowlist(pii_resolved(spark, sf_dir), allowed).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("v"))


@query("allow_wildcard", f"{F_ENTS} select category, count(*) as n from resolved where not (regexp_matches(value, '(?i)^john[.]smith.*@acme-1.[.]com$') or regexp_matches(value, '(?i)^https://.*$') or value = 'P33333330') group by category")
def allow_wildcard(spark, sf_dir):
    kept = filters.allowlist(pii_resolved(spark, sf_dir), ["JOHN.smith*@acme-1?.com", "https://*", "P33333330"])
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


STAT_REASON = """case when confidence < 0.85 then 'below_threshold' when category in ('ssn') then 'exempted'
  when regexp_matches(value, '(?i)^https://.*$') then 'allowlisted' when length(value) <= 2 then 'too_short' end"""


@query("filter_stats", f"""{F_ENTS}, j as (select *, {STAT_REASON} as why from resolved)
 select doc_id, count(*) as total_detected, count(*) filter (where why is null) as replaced, count(*) filter (where why = 'below_threshold') as below_threshold,
 count(*) filter (where why = 'allowlisted') as allowlisted, cast(0 as bigint) as doc_examples, cast(0 as bigint) as already_obfuscated, count(*) filter (where why = 'exempted') as exempted
 from j group by doc_id""")
def filter_stats(spark, sf_dir):
    return filters.filter_stats(filters.with_drop_reason(pii_resolved(spark, sf_dir), 0.85, ["ssn"], ["https://*"]))


@query("known_fakes", f"{F_ENTS} select category, count(*) as n from resolved where length(value) > 2 and value not in (select lpad(cast(c_custkey as varchar), 9, '02') from customer) group by category")
def known_fakes(spark, sf_dir):
    from veilframe.plans.corpora import table

    fakes = table(spark, sf_dir, "customer").select(F.lit("").alias("tenant"), F.expr("lpad(cast(c_custkey as string), 9, '02')").alias("fake"))
    kept = filters.drop_short(filters.drop_known_fakes(pii_resolved(spark, sf_dir), fakes))
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# --- context -------------------------------------------------------------------------------------

BLOCKS = """b as (select doc_id, i, p[i] as block, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0)
   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bs from
   (select doc_id, string_split_regex(text, '\\n\\s*\\n') as p, regexp_extract_all(text, '\\n\\s*\\n') as m from docs) z, unnest(range(1, len(p) + 1)) as u(i)),
 blocks as (select doc_id, block, cast(bs as bigint) as bs, cast(bs + length(block) as bigint) as be from b where length(block) > 0)"""
SCORE = "(" + " + ".join(f"cast(contains(lower(block), {q(k)}) as int)" for k in context.CONFIG_KEYWORDS) + ")"


@query("paragraph_blocks", f"with docs as ({D_NET}), {BLOCKS} select doc_id, bs as start_at, be as end_at from blocks")
def paragraph_blocks(spark, sf_dir):
    return context.paragraph_blocks(net_docs(spark, sf_dir)).select(
        "doc_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"))


@query("context_boost", f"""with recursive {entities_sql(D_NET, NET_RULES)}, {BLOCKS}
 select e.doc_id, e.value, cast(e.s as bigint) as start_at, round(case when exists (select 1 from blocks k where k.doc_id = e.doc_id and e.s >= k.bs and e.e <= k.be and {SCORE} >= 2)
   then least(1.0, e.confidence + 0.1) else e.confidence end, 4) as confidence from ents e""")
def context_boost(spark, sf_dir):
    docs = net_docs(spark, sf_dir)
    return context.boost_context(detect.detect_regex(docs, NET_RULES), docs).select(
        "doc_id", "value", F.col("start").cast("bigint").alias("start_at"), F.round("confidence", 4).alias("confidence"))


PEERS = " or ".join(f"(a.category = '{c}' and b.category in ({', '.join(q(p) for p in context.peers_of(c))}))"
                    for c in sorted({c for g in context.CLUSTER_GROUPS for c in g}))


@query("proximity_boost", f"""with recursive {entities_sql(D_PII, PII_RULES)},
 near as (select a.doc_id, a.s, a.e, a.detector, count(*) as n from ents a join ents b on a.doc_id = b.doc_id and ({PEERS})
   and b.s - a.e <= 200 and a.s - b.e <= 200 group by a.doc_id, a.s, a.e, a.detector)
 select e.doc_id, e.value, cast(e.s as bigint) as start_at, round(case when n.n > 0 then least(1.0, e.confidence + 0.08 * n.n) else e.confidence end, 4) as confidence
 from ents e left join near n on n.doc_id = e.doc_id and n.s = e.s and n.e = e.e and n.detector = e.detector""")
def proximity_boost(spark, sf_dir):
    docs = pii_docs(spark, sf_dir)
    tasks = detect.tasks_by_text(docs)
    return context.boost_proximity(detect.detect_regex(docs, PII_RULES, tasks=tasks), tasks).select(
        "doc_id", "value", F.col("start").cast("bigint").alias("start_at"), F.round("confidence", 4).alias("confidence"))


@query("common_decay", f"with {parts_sql(D_DOCS, DENY_RULES)} select value, round(sum(case when lower(value) in ({', '.join(q(w) for w in context.COMMON_WORDS)}) then confidence * 0.5 else confidence end), 4) as total from parts group by value")
def common_decay(spark, sf_dir):
    hits = context.decay_common(literals.detect_denylist(documents(spark, sf_dir), DENY))
    return hits.groupBy("value").agg(F.round(F.sum("confidence"), 4).alias("total"))


@query("hostname_propagation", f"""with docs as ({D_NET}), names as (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:^|\\n)\\s*(?:hostname|switchname)\\s+(\\S+)', 1))) as name from docs)
 select doc_id, name as value, cast((length(text) - length(replace(text, name, ''))) / length(name) as bigint) as n from names""")
def hostname_propagation(spark, sf_dir):
    docs = net_docs(spark, sf_dir)
    none = detect.detect_regex(docs, R.named("iban"))
    return context.propagate_hostnames(docs, none).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def net_sessions(spark, sf_dir):
    """Config texts as turns of one session per nation."""
    from veilframe.plans import corpora as C

    sup = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").cast("string").alias("session"))
    return net_docs(spark, sf_dir).join(sup, "doc_id").withColumn("seq", F.col("doc_id"))


LEARN_RULES = R.named("cisco_hostname", "route_map_name", "acl_name", "vlan_name")
LEARNED = f"""with recursive {entities_sql(D_NET, LEARN_RULES)},
 sess as (select e.*, cast(s_nationkey as varchar) as session, e.doc_id as seq from ents e join supplier on s_suppkey = e.doc_id),
 learned as (select session, value, max(category) as category, min(seq) as first_seq from sess where confidence >= 0.8 and length(value) >= 3
   and lower(value) not in ({', '.join(q(w) for w in context.COMMON_WORDS)}) group by session, value)"""


def session_entities(spark, sf_dir):
    docs = net_sessions(spark, sf_dir)
    found = detect.detect_regex(docs.select("tenant", "doc_id", "text"), LEARN_RULES)
    return docs, found.join(docs.select("doc_id", "session", "seq"), "doc_id")


@query("learned_entities", f"{LEARNED} select session, value, category, first_seq from learned")
def learned_entities(spark, sf_dir):
    return context.learn_entities(session_entities(spark, sf_dir)[1])


@query("learned_propagation", f"""{LEARNED} select d.doc_id, l.value, cast((length(d.text) - length(replace(d.text, l.value, ''))) / length(l.value) as bigint) as n
 from docs d join supplier on s_suppkey = d.doc_id join learned l on l.session = cast(s_nationkey as varchar) and l.first_seq < d.doc_id and contains(d.text, l.value)
 where starts_with(l.value, 'RM-')""")
def learned_propagation(spark, sf_dir):
    docs, found = session_entities(spark, sf_dir)
    learned = context.learn_entities(found).filter("startswith(value, 'RM-')")
    return context.propagate_learned(docs, learned).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("learned_propagation_all")
def learned_propagation_all(spark, sf_dir):
    """All learned values; ``learned_propagation`` and its SQL have those that begin with RM-."""
    docs, found = session_entities(spark, sf_dir)
    return context.propagate_learned(docs, context.learn_entities(found)).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def page_docs(spark, sf_dir):
    from veilframe.operators.detect import as_docs, spread
    from veilframe.plans import corpora as C

    return spread(as_docs(C.table(spark, sf_dir, "pages").withColumn("text", F.replace("html", F.lit(">"), F.lit(">\n"))), "page_id"))


RE2_SPANS = [R.Rule(f"span{i}", "span", 1.0, "", p.replace("*+", "*")) for i, p in enumerate(code.SPAN_PATTERNS)]


def spans_sql(docs):
    """Literals and comments (doc_id, value, s, e) of texts that look like code."""
    signs = " + ".join(f"cast(contains(text, {q(s)}) as int)" for s in code.CODE_INDICATORS)
    looks = (f"length(text) - length(replace(text, chr(10), '')) >= 2 and {signs} + cast(regexp_matches(text, '(?m)[{{}};][ \\t\\r\\n\\v\\f]*$') as int)"
             " + cast(regexp_matches(text, '(?m)^\\s*(def|class|func|fn)\\s+\\w+') as int) >= 2")
    return (f"with recursive {entities_sql(f'select doc_id, text from ({docs}) c where {looks}', RE2_SPANS, True)} "
            f"select doc_id, value, cast(s as bigint) as s, e from ents where not regexp_matches(value, {q(code.CODE_NOISE)})")


D_PAGES = "select page_id as doc_id, replace(html, '>', '>' || chr(10)) as text from pages where html is not null"


@query("code_spans", f"select doc_id, value, s as start_at, cast(e as bigint) as end_at from ({spans_sql(D_PAGES)}) z")
def code_spans(spark, sf_dir):
    return code.code_spans(page_docs(spark, sf_dir)).select("doc_id", "value", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"))


@query("code_score", f"""select page_id as doc_id, cast({' + '.join('cast(contains(text, ' + q(s) + ') as int)' for s in code.CODE_INDICATORS)}
  + cast(regexp_matches(text, '(?m)[{{}};][ \\t\\r\\n\\v\\f]*$') as int) + cast(regexp_matches(text, '(?m)^\\s*(def|class|func|fn)\\s+\\w+') as int) as bigint) as score
  from (select page_id, replace(html, '>', '>' || chr(10)) as text from pages) t""")
def code_score(spark, sf_dir):
    return page_docs(spark, sf_dir).select("doc_id", F.expr(code.code_score()).cast("bigint").alias("score"))


def code_docs(spark, sf_dir):
    """Secrets as string literals of a program."""
    return secret_docs(spark, sf_dir).withColumn("text", F.concat(F.lit("import os\nconst a = 1;\nx = \""), F.replace("text", F.lit("\n"), F.lit("\"\ny = \"")), F.lit("\"\n")))


@query("detect_in_code")
def detect_in_code(spark, sf_dir):
    return shaped(code.detect_in_code(code_docs(spark, sf_dir), R.family("core", "keys", "cloud")))


CODE_RULES = plain(R.family("core", "keys", "cloud"))
D_CODE = f"""select doc_id, 'import os' || chr(10) || 'const a = 1;' || chr(10) || 'x = "' || replace(text, chr(10), '"' || chr(10) || 'y = "') || '"' || chr(10) as text from ({D_SECRET}) s"""


@query("detect_in_code_plain", f"""with spans as ({spans_sql(D_CODE)}),
 found as (with recursive {entities_sql('select doc_id * 1000000 + s as doc_id, value as text from spans', CODE_RULES)} select doc_id // 1000000 as doc_id, doc_id % 1000000 as moved, * exclude (doc_id) from ents)
 select doc_id, arg_min(value, (detector, value, category)) as value, cast(s + moved as bigint) as start_at, cast(e + moved as bigint) as end_at, arg_min(category, (detector, value, category)) as category,
  round(arg_min(confidence, (detector, value, category)) * 0.9, 4) as confidence, 'code:' || min(detector) as detector from found group by doc_id, s + moved, e + moved""")
def detect_in_code_plain(spark, sf_dir):
    """``detect_in_code`` without the rules that look around, which its twin cannot run."""
    return shaped(code.detect_in_code(code_docs(spark, sf_dir), CODE_RULES))


@query("rule_overlay", "select 'email' as name, 'email' as category, 0.5 as confidence union all select 'ipv4', 'hostname', 0.95 union all "
       "select n_name, 'custom', 0.9 from nation")
def rule_overlay(spark, sf_dir):
    from veilframe.plans.corpora import table

    overlay = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("enabled"), F.col("n_name").alias("pattern"),
                                                    F.lit(None).cast("string").alias("flags"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"))
    more = spark.createDataFrame([("email", True, None, None, None, 0.5), ("ipv4", True, None, None, "hostname", None), ("ssn", False, None, None, None, None)], overlay.schema)
    merged = R.overlay_rules(R.rules_frame(spark, R.named("email", "ipv4", "ssn")), overlay.unionByName(more))
    return merged.select("name", "category", "confidence")
