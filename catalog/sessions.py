"""Audit trails, counters, payloads, addresses and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import D_DOCS, entities_sql, q, query, resolved_sql
from catalog.flagship import CORE, run_core
from catalog.rewriting import CORE_OUT
from veilframe.functions.keyed import hmac_pads
from veilframe.operators import audit as A, payload as P, rules as R, urls as U
from veilframe.plans import corpora as C
from veilframe.session import materialize
from veilframe.sources import readers

RULES = R.named(*CORE)


def audit_frames(spark, sf_dir):
    r = run_core(spark, sf_dir)
    return r, materialize(r.docs, "texts")


BY_CAT = "(select string_agg(category || ':' || n, ',' order by category) from (select category, count(*) as n from repl r where r.doc_id = d.doc_id group by category) c)"


@query("audit_entries", f"""{CORE_OUT} select d.doc_id, coalesce(o.n_entities, 0) as total_entities, o.doc_id is not null as modified, length(d.text) as input_chars,
 length(coalesce(o.text_out, d.text)) as output_chars, length(coalesce(o.text_out, d.text)) - length(d.text) as char_delta, coalesce({BY_CAT}, 'none') as by_category
 from docs d left join outs o on o.doc_id = d.doc_id""")
def audit_entries(spark, sf_dir):
    r, docs = audit_frames(spark, sf_dir)
    return A.audit_entries(docs, r.entities).withColumn("by_category", A._pairs("by_category")).drop("by_rule")


@query("audit_lines", f"""{CORE_OUT} select d.doc_id, '[audit] OBFUSCATE req=' || d.doc_id || ' | entities=' || coalesce(o.n_entities, 0) || ' | chars=' || length(d.text) || '->' || length(coalesce(o.text_out, d.text))
 || ' (delta=' || case when length(coalesce(o.text_out, d.text)) >= length(d.text) then '+' else '' end || (length(coalesce(o.text_out, d.text)) - length(d.text)) || ') | modified=' || case when o.doc_id is null then 'NO' else 'YES' end
 || ' | byCat=' || coalesce({BY_CAT}, 'none') || ' | byRule=' || coalesce({BY_CAT.replace('select category, count', 'select detector as category, count').replace('group by category', 'group by detector')}, 'none') as line
 from docs d left join outs o on o.doc_id = d.doc_id""")
def audit_lines(spark, sf_dir):
    r, docs = audit_frames(spark, sf_dir)
    return A.audit_lines(A.audit_entries(docs, r.entities))


@query("proof_hashes", f"{CORE_OUT} select d.doc_id, substr(sha256('pepper' || d.text), 1, 12) as proof_in, substr(sha256('pepper' || coalesce(o.text_out, d.text)), 1, 12) as proof_out from docs d left join outs o on o.doc_id = d.doc_id")
def proof_hashes(spark, sf_dir):
    return A.proof_hashes(audit_frames(spark, sf_dir)[1], "pepper", 12)


@query("fakes_sample", f"{CORE_OUT}, f as (select doc_id, fake, min(s) as s from repl group by doc_id, fake), k as (select *, row_number() over (partition by doc_id order by s) as r from f) select doc_id, string_agg(fake, '|' order by s) as fakes_sample from k where r <= 2 group by doc_id")
def fakes_sample(spark, sf_dir):
    return A.fakes_sample(audit_frames(spark, sf_dir)[0].entities, 2).withColumn("fakes_sample", F.array_join("fakes_sample", "|"))


@query("rule_hits", f"""with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()}, h as (select rule, count(*) as hits from resolved group by rule),
 r(name, category, confidence) as (values {', '.join(f"('{r.name}', '{r.category}', {r.confidence})" for r in R.BUILTIN)})
 select name, category, 'active' as status, round(confidence, 4) as confidence, coalesce(hits, 0) as hits, case when hits > 0 then repeat('█', cast(least(ceil(log2(hits + 1)), 16) as int)) else '' end as bar from r left join h on h.rule = r.name""")
def rule_hits(spark, sf_dir):
    hits = A.rule_hits(run_core(spark, sf_dir).entities, R.rules_frame(spark))
    return hits.withColumn("confidence", F.round("confidence", 4))


@query("category_rollup", f"""with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()}, j as (select *, case when confidence < 0.9 then 'below' end as why, '' as tenant from resolved)
 select tenant, category, count(*) as detected, count(*) filter (where why is null) as replaced from j group by rollup (tenant, category)""")
def category_rollup(spark, sf_dir):
    return A.category_counts(run_core(spark, sf_dir, min_confidence=0.9).judged)


@query("engine_stats", f"{CORE_OUT} select (select count(*) from docs) as obfuscation_events, (select count(*) from resolved) as entities_detected, (select count(*) from resolved) as entities_obfuscated, (select count(*) from fakes) as store_mappings, 'full' as redaction_level, 's' as salt")
def engine_stats(spark, sf_dir):
    r = run_core(spark, sf_dir)
    return A.engine_stats(r.judged, r.mapping, r.docs, "full", "s")


# --- event-table audits ------------------------------------------------------------------------------

EVENTS = "select cast(user_id as varchar) as session, event_id as seq, 1700000000000 + event_id as ts, case when event_type in ('view', 'click') then 'obfuscation' else 'deobfuscation' end as event_type, event_type as category, event_id % 5 + 1 as n from events"


def event_audit(spark, sf_dir):
    e = C.corpus(spark, sf_dir, EVENTS, ("events",))
    return e.select("session", "seq", "ts", "event_type", F.create_map("category", "n").alias("categories"), F.col("n").alias("total_entities"))


def hmac_duck(secret, message):
    ipad, opad = hmac_pads(secret)
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({message}))))"


CHAIN = f"""with recursive a as (select *, '{{"' || category || '":' || n || '}}' as cats, row_number() over (partition by session order by seq) as k from ({EVENTS}) e),
 c as (select session, cast(0 as bigint) as k, '{A.GENESIS}' as chain_hash from (select distinct session from a) s
  union all select a.session, a.k, {hmac_duck('audit-key', "c.chain_hash || ':' || a.ts || ':' || a.event_type || ':' || a.cats")} from c join a on a.session = c.session and a.k = c.k + 1)"""


@query("audit_chain", f"{CHAIN} select a.session, a.seq, c.chain_hash from a join c on c.session = a.session and c.k = a.k")
def audit_chain(spark, sf_dir):
    return A.chain(event_audit(spark, sf_dir), "audit-key").select("session", "seq", "chain_hash")


@query("chain_verify", f"select session, count(*) as entries_checked, not bool_or(seq % 1000 = 0) as valid, min(seq) filter (where seq % 1000 = 0) as first_bad from ({EVENTS}) e group by session")
def chain_verify(spark, sf_dir):
    """Every thousandth entry is forged: its category text changes after it was chained."""
    chained = A.chain(event_audit(spark, sf_dir), "audit-key")
    return A.verify_chain(chained.withColumn("cats", F.when(F.col("seq") % 1000 == 0, "{}").otherwise(F.col("cats"))), "audit-key")


@query("request_chain", f"""with recursive a as (select *, row_number() over (partition by session order by seq) as k from ({EVENTS}) e),
 c as (select session, cast(0 as bigint) as k, '{A.REQUEST_GENESIS}' as h from (select distinct session from a) s
  union all select a.session, a.k, substr(sha256(c.h || a.event_type || a.n), 1, 16) from c join a on a.session = c.session and a.k = c.k + 1)
 select a.session, a.seq, c.h as chain_hash from a join c on c.session = a.session and c.k = a.k""")
def request_chain(spark, sf_dir):
    e = C.corpus(spark, sf_dir, EVENTS, ("events",)).select("session", "seq", F.concat("event_type", F.col("n").cast("string")).alias("data"))
    return A.request_chain(e).select("session", "seq", "chain_hash")


@query("audit_stats", f"""select session, count(*) as total_events, count(*) filter (where event_type = 'obfuscation') as obfuscation_events, count(*) filter (where event_type = 'deobfuscation') as deobfuscation_events,
 cast(coalesce(sum(n) filter (where event_type = 'obfuscation'), 0) as bigint) as entities_scrubbed, cast(coalesce(sum(n) filter (where event_type = 'deobfuscation'), 0) as bigint) as replacements_restored from ({EVENTS}) e group by session""")
def audit_stats(spark, sf_dir):
    return A.audit_stats(event_audit(spark, sf_dir))


@query("category_totals", f"select category, cast(sum(n) as bigint) as total from ({EVENTS}) e group by category")
def category_totals(spark, sf_dir):
    return A.category_totals(event_audit(spark, sf_dir))


HIST = C.HISTORY_SQL


@query("history_summary", "select count(*) as prompts, count(distinct user_id) as sessions, max((1700000000 + event_id) * 1000) as last_prompt_ms from events where event_id % 50 <> 7 and event_id % 40 <> 3 and event_id % 30 <> 5 and event_id % 9 <> 2")
def history_summary(spark, sf_dir):
    return A.history_summary(readers.parse_history(C.corpus(spark, sf_dir, HIST, ("events",))))


SNAP = """select cast(user_id as varchar) as session, event_id % 2 as prio, case when event_id % 3 = 0 then null else concat('agent-', cast(event_id % 2 as varchar)) end as agent_label,
  event_id % 97 as request_count, event_id % 89 as store_size, event_type as category, event_id % 31 as n from events"""


@query("merge_snapshots", f"""with s as ({SNAP}), m as (select session, category, max(n) as n from s group by session, category)
 select session, max(request_count) as request_count, max(store_size) as store_size, min(agent_label) as agent_label,
  (select string_agg(category || ':' || n, ',' order by category) from m where m.session = s.session) as category_counts from s group by session""")
def merge_snapshots(spark, sf_dir):
    s = C.corpus(spark, sf_dir, SNAP, ("events",)).withColumn("category_counts", F.create_map("category", "n"))
    return A.merge_snapshots(s).withColumn("category_counts", A._pairs("category_counts"))


def calls(spark, sf_dir):
    return C.corpus(spark, sf_dir, C.TOOL_CALLS_SQL, ("events",))


@query("privacy_counters", f"""select session, count(*) filter (where tool in ('view', 'click')) as obfuscation_calls, count(*) filter (where tool not in ('view', 'click') and seq % 3 > 0) as deobfuscation_calls,
  cast(coalesce(sum(seq % 3) filter (where tool in ('view', 'click')), 0) as bigint) as entities_obfuscated, cast(coalesce(sum(seq % 3) filter (where tool not in ('view', 'click') and seq % 3 > 0), 0) as bigint) as replacements_deobfuscated from ({C.TOOL_CALLS_SQL}) t group by session""")
def privacy_counters(spark, sf_dir):
    direction = F.when(F.col("tool").isin("view", "click"), "obfuscate").otherwise("deobfuscate")
    return A.privacy_counters(calls(spark, sf_dir).select("session", direction.alias("direction"), (F.col("seq") % 3).alias("n")))


@query("recent_tools", f"select session, string_agg(tool, ',' order by seq) as tools from (select *, row_number() over (partition by session order by seq desc) as r from ({C.TOOL_CALLS_SQL}) t) z where r <= 20 group by session")
def recent_tools(spark, sf_dir):
    return A.recent_tools(calls(spark, sf_dir)).withColumn("tools", F.array_join("tools", ","))


@query("tool_depth", f"select session, seq, cast(greatest(d, 0) as bigint) as depth, d > 3 as warn from (select session, seq, sum(delta) over (partition by session, turn order by seq) as d from ({C.TOOL_CALLS_SQL}) t) z")
def tool_depth(spark, sf_dir):
    return A.tool_depth(calls(spark, sf_dir), 3).select("session", "seq", "depth", "warn")


@query("latency_stats", f"select session, count(*) as requests, cast(round(avg(ms)) as bigint) as avg_ms from ({C.TOOL_CALLS_SQL}) t group by session")
def latency_stats(spark, sf_dir):
    return A.latency_stats(calls(spark, sf_dir))


# --- scopes and payloads -----------------------------------------------------------------------------

SCOPES = [("c*", 1, ["k"]), ("VIE?", 2, ["text", "k"]), ("*e*", 3, ["other"])]


def scoped(spark, sf_dir):
    rules = spark.createDataFrame(SCOPES, "tool_pattern string, priority int, scan_fields array<string>")
    return P.resolve_scope(calls(spark, sf_dir), rules, default=None, never=["secret"])


@query("scope_resolve", f"select tool, case when tool = 'click' then 'k' when tool = 'view' then 'text,k' when contains(tool, 'e') then 'other' end as fields, case when tool in ('click', 'view') or contains(tool, 'e') then 'selected' else 'all' end as mode, count(*) as n from ({C.TOOL_CALLS_SQL}) t group by tool")
def scope_resolve(spark, sf_dir):
    s = scoped(spark, sf_dir)
    return s.groupBy("tool", F.when(F.col("scan_fields").isNotNull(), F.array_join("scan_fields", ",")).alias("fields"), "mode").agg(F.count(F.lit(1)).alias("n"))


@query("walk_scoped", f"select seq, case when tool in ('click', 'view') or not contains(tool, 'e') then 'K' || json_extract_string(props, '$.k') else 'k' || json_extract_string(props, '$.k') end as k, case when tool in ('signup') or (tool not in ('click', 'view') and not contains(tool, 'e')) or tool = 'view' then 'HI' else 'hi' end as text from ({C.TOOL_CALLS_SQL}) t")
def walk_scoped(spark, sf_dir):
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    rows = scoped(spark, sf_dir).withColumns({
        "fields": F.create_map(F.lit("k"), k, F.lit("secret"), F.lit("no")),
        "blocks": F.array(F.struct(F.lit("text").alias("type"), F.lit("hi").alias("text")))})
    blocks, fields = P.walk_strings_scoped(F.col("blocks"), F.col("fields"), F.upper, F.col("scan_fields"), F.col("never_fields"))
    return rows.select("seq", fields["k"].alias("k"), blocks[0]["text"].alias("text"))


@query("walk_strings", f"select seq, 'K' || json_extract_string(props, '$.k') as k, 'HI' as text from ({C.TOOL_CALLS_SQL}) t")
def walk_strings(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumns({
        "fields": F.create_map(F.lit("k"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))),
        "blocks": F.array(F.struct(F.lit("text").alias("type"), F.lit("hi").alias("text")))})
    blocks, fields = P.walk_strings(F.col("blocks"), F.col("fields"), F.upper)
    return rows.select("seq", fields["k"].alias("k"), blocks[0]["text"].alias("text"))


@query("scan_gate", "select event_type, case event_type when 'view' then 'Bash' when 'click' then 'Edit' else 'Read' end as tool, event_type <> 'click' as scan_output, case event_type when 'view' then 'command' when 'click' then 'new_string,old_string' end as restore_fields, count(*) as n from events group by event_type")
def scan_gate(spark, sf_dir):
    tool = F.when(F.col("event_type") == "view", "Bash").when(F.col("event_type") == "click", "Edit").otherwise("Read")
    gated = P.scan_gate(C.table(spark, sf_dir, "events").withColumn("tool", tool))
    return gated.groupBy("event_type", "tool", "scan_output", F.when(F.col("restore_fields").isNotNull(), F.array_join("restore_fields", ",")).alias("restore_fields")).agg(F.count(F.lit(1)).alias("n"))


def payloads(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations")
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.when(x["turn"] % 2 == 0, F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), x["text"].alias("text"))))).otherwise(x["text"]).alias("content")))
    return c.groupBy(F.col("conv_id").alias("msg_id")).agg(F.to_json(F.struct(messages.alias("messages"), F.lit("be brief").alias("system"))).alias("payload"))


@query("explode_messages", """select conv_id as msg_id, case when turn % 2 = 0 then 'messages[' || (row_number() over (partition by conv_id order by turn) - 1) || '].content[0].text' else 'messages[' || (row_number() over (partition by conv_id order by turn) - 1) || '].content' end as path, role, text from conversations
 union all select distinct conv_id, 'system', 'system', 'be brief' from conversations""")
def explode_messages(spark, sf_dir):
    return P.explode_messages(payloads(spark, sf_dir)).select("msg_id", "path", "role", "text")


@query("reassemble_messages", "select conv_id as msg_id, cast(count(*) as bigint) as messages, string_agg(role || '=' || text || '!', '|' order by turn) as all_text from conversations group by conv_id")
def reassemble_messages(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations")
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = c.groupBy(F.col("conv_id").alias("msg_id")).agg(F.to_json(F.struct(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("payload"))
    leaves = P.explode_messages(whole)
    back = P.reassemble_messages(leaves.withColumn("text", F.concat("text", F.lit("!"))))
    parsed = F.from_json("payload", "messages array<struct<role: string, content: string>>")["messages"]
    return back.select("msg_id", F.size(parsed).cast("bigint").alias("messages"), F.array_join(F.transform(parsed, lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("all_text"))


def whole_payloads(leaf: str) -> str:
    """Payloads of every known form with fields that nobody knows; ``leaf`` is the escaped text of each leaf."""
    return f"""select conv_id * 1000 + turn as msg_id, concat('{{"model": "m-1", "system": [{{"type": "text", "text": "', {leaf}, '", "cache": {{"ttl": 5}}}}], "temperature": 1.50, ',
  '"messages": [{{"role": "user",  "content": "', {leaf}, '", "name": null}}, {{"role": "user", "content": [{{"type": "tool_result", "tool_use_id": "t1", "content": "', {leaf}, '"}}, ',
  '{{"type": "image", "source": {{"data": "AAé=="}}}}, {{"type": "text", "text": "', {leaf}, '"}}], "x": []}}, ',
  '{{"role": "assistant", "content": null, "tool_calls": [{{"id": "c1", "type": "function", "function": {{"name": "f", "arguments": "', {leaf}, '"}}}}]}}], ',
  '"contents": [ {{"role": "model", "parts": [{{"text": "', {leaf}, '"}}, {{"data": {{}}}}]}} ], "metadata": {{"text": "', e, '", "content": [true, -1e5]}}}}') as payload
  from (select conv_id, turn, replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')) as e
    from conversations where text is not null) c"""


@query("reassemble_whole", whole_payloads("e || '!'"))
def reassemble_whole(spark, sf_dir):
    """Every leaf changed and put back; all other bytes as they were."""
    whole = C.corpus(spark, sf_dir, whole_payloads("e"), ("conversations",))
    leaves = P.explode_messages(whole)
    return P.reassemble_messages(leaves.withColumn("text", F.concat("text", F.lit("!"))), payloads=whole)


REQUESTS = """select c_custkey, case when c_custkey % 10 = 0 then concat('{broken', cast(c_custkey as varchar)) when c_custkey % 10 = 1 then '{"method": "obfuscate"}'
  else concat('{"id": "', cast(c_custkey as varchar), '", "method": "batch", "params": {"partition": "p', cast(c_nationkey as varchar), '", "operations": [{"direction": "obfuscate", "text": "', c_name, '"}, {"direction": "deobfuscate", "text": "x", "partition": "own"}]}}') end as value from customer"""


@query("read_requests", "select case when c_custkey % 10 = 0 then 'Parse error' when c_custkey % 10 = 1 then 'Missing required field: id and method' end as error, count(*) as n from customer group by 1")
def read_requests(spark, sf_dir):
    return readers.parse_requests(C.corpus(spark, sf_dir, REQUESTS, ("customer",))).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("batch_operations", "select cast(c_custkey as varchar) as id, 0 as idx, 'p' || c_nationkey as tenant, 'obfuscate' as direction, c_name as text from customer where c_custkey % 10 > 1 union all select cast(c_custkey as varchar), 1, 'own', 'deobfuscate', 'x' from customer where c_custkey % 10 > 1")
def batch_operations(spark, sf_dir):
    return readers.batch_operations(readers.parse_requests(C.corpus(spark, sf_dir, REQUESTS, ("customer",))))


@query("read_docs", "select conv_id as doc_id, role as tenant, text from conversations")
def read_docs(spark, sf_dir):
    return readers.read_docs(spark, f"{sf_dir}/conversations.parquet", id_col="conv_id", tenant=F.col("role"))


# --- addresses ---------------------------------------------------------------------------------------

URL_RE = q(U.URL)
PAGES = "select page_id as doc_id, concat('see <', url, '|page> and <', url, '>, or ', url, '.') as text from pages"
STRIP = "regexp_replace(regexp_replace(text, '<(https?://[^|>]+)\\|[^>]*>', '\\1', 'g'), '<(https?://[^>]+)>', '\\1', 'g')"


@query("extract_urls", f"select doc_id, u as url, count(*) as n from (select doc_id, unnest(regexp_extract_all({STRIP}, {URL_RE})) as u from ({PAGES}) p) z group by doc_id, u")
def extract_urls(spark, sf_dir):
    return U.extract_urls(C.corpus(spark, sf_dir, PAGES, ("pages",))).groupBy("doc_id", "url").agg(F.count(F.lit(1)).alias("n"))


HOST = "lower(regexp_extract(url, '(?i)^https?://([^/:]+)', 1))"
FQDN = f"(case when {HOST} <> '' and {HOST} <> 'localhost' and contains({HOST}, '.') then {HOST} end)"


@query("url_fqdn", f"select page_id, {FQDN} as host from pages")
def url_fqdn(spark, sf_dir):
    from veilframe.functions.hosts import extract_fqdn

    return C.table(spark, sf_dir, "pages").select("page_id", extract_fqdn(F.col("url")).alias("host"))


RESOLVED = f"""select host, case when n % 4 = 0 then null when n % 4 = 1 then concat('10.0.', cast(n % 256 as varchar), '.1') when n % 4 = 2 then '93.184.216.34' else 'fd00::1' end as address,
  case when n % 3 = 0 then timestamp '2026-01-01 10:00:00' else timestamp '2026-01-01 11:30:00' end as resolved_at from (select host, min(page_id) as n from (select {{h}} as host, page_id from pages) z where host is not null and page_id % 5 > 0 group by host) y"""
NOW = "2026-01-01 12:00:00"


def resolutions(spark, sf_dir):
    from veilframe.functions.hosts import extract_fqdn

    pages = C.table(spark, sf_dir, "pages").withColumn("h", extract_fqdn(F.col("url")))
    return spark.sql(RESOLVED.replace("{h}", "h").replace("from pages)", "from {pages})").replace("as varchar", "as string"), pages=pages)


D_RES = f"res as ({RESOLVED.replace('{h}', FQDN)})"


@query("hosts_to_resolve", f"with {D_RES} select distinct {FQDN} as host from pages where {FQDN} not in (select host from res where resolved_at >= timestamp '2026-01-01 11:00:00')")
def hosts_to_resolve(spark, sf_dir):
    return U.hosts_to_resolve(C.table(spark, sf_dir, "pages"), resolutions(spark, sf_dir), NOW)


@query("url_class", f"with {D_RES} select page_id, coalesce(r.host is not null and address = '93.184.216.34', false) as public_, r.host is null as unknown, address from (select page_id, {FQDN} as host from pages) p left join (select * from res where resolved_at >= timestamp '2026-01-01 11:00:00') r on r.host = p.host")
def url_class(spark, sf_dir):
    c = U.classify_urls(C.table(spark, sf_dir, "pages").select("page_id", "url"), resolutions(spark, sf_dir), NOW)
    return c.select("page_id", F.coalesce("is_public", F.lit(False)).alias("public_"), F.col("is_public").isNull().alias("unknown"), "address")


@query("url_address", f"with {D_RES} select page_id, address from (select page_id, {FQDN} as host from pages) p left join res r on r.host = p.host")
def url_address(spark, sf_dir):
    return U.address_of(C.table(spark, sf_dir, "pages").select("page_id", "url"), resolutions(spark, sf_dir)).select("page_id", "address")


MIXED_URLS = "select page_id, case when page_id % 3 = 0 then concat('https://gist.github.com/', cast(page_id as varchar)) when page_id % 3 = 1 then concat('http://notgithub.com/', cast(page_id as varchar)) else url end as url from pages"


@query("public_domains", f"select distinct url, 'gist.github.com' as host, 'github.com' as domain from ({MIXED_URLS}) u where page_id % 3 = 0")
def public_domains(spark, sf_dir):
    return U.public_domains(C.corpus(spark, sf_dir, MIXED_URLS, ("pages",)))
