"""Rewriting, restoring, and the checks that nothing leaks and everything comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (D_ALL, D_DOCS, D_PII, KEYS, all_docs, documents, entities_sql, material_duck, net_docs,
                          pii_docs, query, resolved_sql, side_by_side)
from catalog.flagship import CORE, obfuscated_documents, run_core
from catalog.minting import ALLOC, DUCK, IP_INT, QUADS, dorg
from veilframe.operators import checks, restore as B, rules as R, subnets as S
from veilframe.operators.detect import spread
from veilframe.plans import corpora as C
from veilframe.plans.obfuscate import Config, obfuscate, process_batch
from veilframe.session import materialize

RULES = R.named(*CORE)

# Every fake is recomputed by the oracle; example.com mail keeps org and top-level domain rules.
E_MAIL = DUCK["email"].split(" || '@' || ")[0] + " || '@' || " + dorg("split_part(value, '.', -2)") + " || '.' || split_part(value, '.', -1)"
CORE_OUT = f"""with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()},
 vals as (select value, arg_min(category, (doc_id, s)) as category from resolved group by value),
 cidrs as (select unnest(regexp_extract_all(text, '\\b(\\d+[.]\\d+[.]\\d+[.]\\d+)/(\\d+)\\b', 1)) as cidr from docs),
 v4 as (select value, {IP_INT.format('value')} as n from vals where category = 'ip_address'),
 nets as (select distinct n - n % 256 as net from v4),
 alloc as (select net, {S.POOL_BASE} + (row_number() over (order by net) - 1) * 256 as fake_net from nets),
 fakes as (select value, case category when 'email' then {E_MAIL} when 'phone' then {DUCK['phone']} when 'credit_card' then {DUCK['credit_card']}
    else (select {QUADS.format('(cast(fake_net as bigint) + n - net)')} from v4 join alloc on net = n - n % 256 where v4.value = m.value) end as fake from {material_duck('vals')} m),
 repl as (select r.*, f.fake from resolved r join fakes f on f.value = r.value),
 placed as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from repl),
 outs as (select p.doc_id, string_agg(substr(d.text, cast(prev + 1 as bigint), cast(s - prev as bigint)) || fake, '' order by s) || substr(any_value(d.text), cast(max(e) + 1 as bigint)) as text_out, count(*) as n_entities
   from placed p join docs d on d.doc_id = p.doc_id group by p.doc_id)"""


@query("obfuscate_docs", f"{CORE_OUT} select o.doc_id, lang, n_entities, text_out from outs o join documents d on d.doc_id = o.doc_id")
def obfuscate_docs(spark, sf_dir):
    return obfuscated_documents(spark, sf_dir)


@query("obfuscate_masked", f"""with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()},
 repl as (select *, case category when 'email' then substr(value, 1, 1) || '***@***.' || split_part(value, '.', -1) when 'phone' then '***' || right(value, 4)
   when 'credit_card' then '****-****-****-' || right(value, 4) else split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.*.*' end as fake from resolved),
 placed as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from repl)
 select p.doc_id, string_agg(substr(d.text, cast(prev + 1 as bigint), cast(s - prev as bigint)) || fake, '' order by s) || substr(any_value(d.text), cast(max(e) + 1 as bigint)) as text_out
   from placed p join docs d on d.doc_id = p.doc_id group by p.doc_id""")
def obfuscate_masked(spark, sf_dir):
    r = run_core(spark, sf_dir, level="masked")
    return r.docs.join(r.entities.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text_out")


@query("redact_stats", f"""with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()},
 repl as (select *, '[' || upper(category) || '-' || cast(row_number() over (partition by doc_id, category order by s) as varchar) || ']' as fake from resolved),
 placed as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from repl)
 select p.doc_id, string_agg(substr(d.text, cast(prev + 1 as bigint), cast(s - prev as bigint)) || fake, '' order by s) || substr(any_value(d.text), cast(max(e) + 1 as bigint)) as text_out
   from placed p join docs d on d.doc_id = p.doc_id group by p.doc_id""")
def redact_stats(spark, sf_dir):
    r = run_core(spark, sf_dir, level="stats")
    return r.docs.join(r.entities.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text_out")


@query("obfuscate_all", "select count(*) as texts, cast(0 as bigint) as lost, cast(0 as bigint) as duplicate_stand_ins from documents")
def obfuscate_all(spark, sf_dir):
    r = obfuscate(documents(spark, sf_dir), Config(KEYS))
    dup = r.mapping.groupBy("tenant", "fake").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_stand_ins"))
    one = r.docs.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("text_out").isNull()).alias("lost"))
    return side_by_side(one, dup)


def core_out(spark, sf_dir):
    r = run_core(spark, sf_dir)
    out = materialize(r.docs, "texts")
    return r, out.select("tenant", "doc_id", F.col("text_out").alias("text")), out.select("doc_id", "text")


@query("restore_exact", f"{D_DOCS}")
def restore_exact(spark, sf_dir):
    r, out, _ = core_out(spark, sf_dir)
    return B.restore_exact(out.withColumnRenamed("text", "text_out"), r.entities).select("doc_id", F.col("text_restored").alias("text"))


@query("restore_dict", f"{D_DOCS}")
def restore_dict(spark, sf_dir):
    r, out, _ = core_out(spark, sf_dir)
    return B.restore(out, r.mapping).select("doc_id", F.col("text_out").alias("text"))


@query("restore_stats", f"with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()} select doc_id, category, count(*) as replacements from resolved group by doc_id, category")
def restore_stats(spark, sf_dir):
    r, out, _ = core_out(spark, sf_dir)
    return B.restore_with_stats(out, r.mapping)[1]


@query("roundtrip_check", "select doc_id from documents where false")
def roundtrip_check(spark, sf_dir):
    r, out, original = core_out(spark, sf_dir)
    return checks.roundtrip_errors(original, B.restore(out, r.mapping).select("doc_id", F.col("text_out").alias("text")))


@query("roundtrip_all", D_ALL)
def roundtrip_all(spark, sf_dir):
    """All texts under all rules, context and code detection, and back through the dictionary."""
    r = obfuscate(spread(materialize(all_docs(spark, sf_dir), "originals")), Config(KEYS))
    out = materialize(r.docs, "texts").select("tenant", "doc_id", F.col("text_out").alias("text"))
    return B.restore(out, r.mapping).select("doc_id", F.col("text_out").alias("text"))


@query("roundtrip_planted", f"select doc_id from ({D_DOCS}) where doc_id % 7 = 3")
def roundtrip_planted(spark, sf_dir):
    """Every seventh text is damaged between rewriting and restoring: the check names exactly those."""
    r, out, original = core_out(spark, sf_dir)
    damaged = out.withColumn("text", F.when(F.col("doc_id") % 7 == 3, F.concat(F.col("text"), F.lit(" +"))).otherwise(F.col("text")))
    return checks.roundtrip_errors(original, B.restore(damaged, r.mapping).select("doc_id", F.col("text_out").alias("text")))


PLANTED = f"with recursive {entities_sql(D_DOCS, RULES, True)}, {resolved_sql()}"


@query("leak_planted", f"{PLANTED} select distinct doc_id, value from resolved where category = 'phone'")
def leak_planted(spark, sf_dir):
    """Texts whose phone numbers were left in: the check names every one, and nothing else."""
    r, out, original = core_out(spark, sf_dir)
    left = r.entities.filter("category = 'phone'").select("doc_id", "value").distinct()
    lines = left.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("more"))
    leaky = out.join(lines, "doc_id", "left").withColumn("text", F.concat_ws("\n", "text", "more")).drop("more")
    return checks.not_visible(leaky, r.mapping.select("tenant", F.col("real").alias("value"))).select("doc_id", "value")


@query("missing_planted", f"{PLANTED} select distinct doc_id, value from resolved")
def missing_planted(spark, sf_dir):
    """Texts that were never restored show none of their real values."""
    r, out, _ = core_out(spark, sf_dir)
    return checks.missing_values(out, r.entities.select("doc_id", "value").distinct())


@query("leak_check", "select doc_id, text as value from documents where false")
def leak_check(spark, sf_dir):
    r, out, _ = core_out(spark, sf_dir)
    return checks.not_visible(out, r.mapping.select("tenant", F.col("real").alias("value"))).select("doc_id", "value")


@query("restored_visible", "select doc_id, text as value from documents where false")
def restored_visible(spark, sf_dir):
    r, out, _ = core_out(spark, sf_dir)
    back = B.restore(out, r.mapping).select("doc_id", F.col("text_out").alias("text"))
    return checks.missing_values(back, r.entities.select("doc_id", "value").distinct())


@query("pattern_seen", f"select '\\+1 \\(' as pattern, count(*) filter (where regexp_matches(text, '\\+1 \\(')) as texts, bool_or(regexp_matches(text, '\\+1 \\(')) as seen from documents union all select 'token = \"', count(*) filter (where contains(text, 'token = \"')), bool_or(contains(text, 'token = \"')) from documents")
def pattern_seen(spark, sf_dir):
    return checks.pattern_seen(documents(spark, sf_dir), [r"\+1 \(", 'token = "'])


BOUNDED = f"with recursive {entities_sql(D_DOCS, RULES, True)} select d.doc_id, count(e.s) as n from docs d left join ents e on e.doc_id = d.doc_id group by d.doc_id having count(e.s) < 1 or count(e.s) > 3"


@query("entity_bounds", BOUNDED)
def entity_bounds(spark, sf_dir):
    from veilframe.operators.detect import detect_regex

    docs = documents(spark, sf_dir)
    return checks.entity_bounds(docs, detect_regex(docs, RULES, True), 1, 3)


@query("missing_categories", "select 'ssn' as category union all select 'iban'")
def missing_categories(spark, sf_dir):
    from veilframe.operators.detect import detect_regex

    return checks.missing_categories(detect_regex(documents(spark, sf_dir), RULES, True), ["ssn", "email", "iban", "phone"])


# --- derived text: addresses made up inside fake subnets ---------------------------------------------

DERIVED = """select s_suppkey as doc_id, concat('next hop 100.64.', cast(s_suppkey % 60 as varchar), '.', cast(s_suppkey % 251 as varchar), ' and 100.127.255.1, range 100.64.', cast(s_suppkey % 5 as varchar), '.x/24, all 100.64.0.0/10') as text from supplier"""


def net_subnets(spark, sf_dir):
    return materialize(S.allocate_subnets(S.learn_subnets(net_docs(spark, sf_dir))), "subnets")


@query("ip_residual", f"""{ALLOC}, d as ({DERIVED}), f as (select doc_id, regexp_extract(text, 'hop (100[.]64[.][0-9]+[.][0-9]+)', 1) as value from d),
 n as (select doc_id, value, {IP_INT.format('value')} as n from f)
 select doc_id, value, arg_max({QUADS.format('(real_net + n - cast(fake_net as bigint))')}, prefix_len) as repl from n join alloc on n - n % (1::bigint << (32 - prefix_len)) = fake_net group by doc_id, value""")
def ip_residual(spark, sf_dir):
    docs = C.corpus(spark, sf_dir, DERIVED, ("supplier",))
    found = docs.select(F.lit("").alias("tenant"), "doc_id", F.regexp_extract("text", r"hop (100[.]64[.][0-9]+[.][0-9]+)", 1).alias("value"))
    return S.residual_v4(found, net_subnets(spark, sf_dir)).select("doc_id", "value", "repl")


D_RANGES = f"""{ALLOC}, d as ({DERIVED}), own as (select max(c_custkey) as k, '100.64.7.' || cast(c_custkey % 256 as varchar) as value from customer group by 2),
 hops as (select doc_id, regexp_extract(text, 'hop (100[.]64[.][0-9]+[.][0-9]+)', 1) as value from d), nums as (select doc_id, value, {IP_INT.format('value')} as n from hops),
 parts as (select distinct '100.64.' || cast(doc_id % 5 as varchar) || '.x/24' as value, {IP_INT.format("'100.64.0.0'")} + doc_id % 5 * 256 as low, {IP_INT.format("'100.64.0.0'")} + doc_id % 5 * 256 + 255 as high from d
  union all select '100.64.0.0/10', {S.POOL_BASE}, {S.POOL_BASE + S.POOL_SIZE - 1}),
 owned as (select value, real_net >> 16 as net, sum(least(high, fake_net + (1::bigint << (32 - prefix_len)) - 1) - greatest(low, fake_net) + 1) as w from parts join alloc on fake_net <= high and fake_net + (1::bigint << (32 - prefix_len)) > low group by 1, 2),
 usual as (select arg_max(net, (w, -net)) as net from owned where value = '100.64.0.0/10'),
 best as (select p.value, coalesce(arg_max(o.net, (o.w, -o.net)), max(u.net)) as net from parts p left join owned o on o.value = p.value, usual u group by p.value),
 said as (select value, cast(net >> 8 as varchar) || '.' || cast(net & 255 as varchar) || replace(substr(value, 7), '/10', '/16') as repl from best)
 select doc_id, 'known' as kind, hops.value, c_name as repl from hops join own on own.value = hops.value join customer on c_custkey = k
 union all select doc_id, 'residual_v4', value, arg_max({QUADS.format('(real_net + n - cast(fake_net as bigint))')}, prefix_len) from nums join alloc on n - n % (1::bigint << (32 - prefix_len)) = fake_net
  where value not in (select value from own) group by doc_id, value
 union all select doc_id, 'range', value, repl from d join said on value in ('100.64.' || cast(doc_id % 5 as varchar) || '.x/24', '100.64.0.0/10')"""


@query("restore_derived", D_RANGES)
def restore_derived(spark, sf_dir):
    docs = C.docs_of(C.corpus(spark, sf_dir, DERIVED, ("supplier",)))
    mapping = C.table(spark, sf_dir, "customer").select(
        F.lit("").alias("tenant"), F.col("c_name").alias("real"), F.concat(F.lit("100.64.7."), (F.col("c_custkey") % 256).cast("string")).alias("fake"),
        F.lit("ip_address").alias("category"), F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("first_seen"))
    _, edits = B.restore_derived(docs, mapping, net_subnets(spark, sf_dir), ranges=True)
    return edits.select("doc_id", "kind", "value", "repl")


V6_DOCS = """select p_partkey as doc_id, concat('to fd00:', substring(md5(cast(p_partkey as varchar)), 1, 4), ':1:2::', cast(1 + p_partkey % 9 as varchar), ' net fd00:', substring(md5(cast(p_partkey as varchar)), 1, 4), ':1:2:: end') as text from part"""


@query("ipv6_residual", f"""select doc_id, regexp_extract(text, 'net (\\S+) end', 1) as value, concat('2001:470:', ltrim(substr(md5(cast(doc_id as varchar)), 5, 4), '0'), ':2::') as repl from ({V6_DOCS}) d
 where ltrim(substr(md5(cast(doc_id as varchar)), 5, 4), '0') <> '' union all select doc_id, regexp_extract(text, 'to (\\S+) net', 1), concat('2001:470:', substr(md5(cast(doc_id as varchar)), 5, 4), ':2:0:0:0:', cast(1 + doc_id % 9 as varchar)) from ({V6_DOCS}) d""")
def ipv6_residual(spark, sf_dir):
    docs = C.docs_of(C.corpus(spark, sf_dir, V6_DOCS, ("part",)))
    m = F.md5(F.col("p_partkey").cast("string"))
    last = (1 + F.col("p_partkey") % 9).cast("string")
    mapping = C.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("fd00:"), F.substring(m, 1, 4), F.lit(":0001:0002:0000:0000:0000:000"), last).alias("fake"),
        F.concat(F.lit("2001:470:"), F.substring(m, 5, 4), F.lit(":2:0:0:0:"), last).alias("real"))
    scanned = docs.select(F.col("doc_id").cast("string").alias("tenant"), "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"fd00[0-9a-f:]+"), F.lit(0))).alias("value"))
    return B.residual_v6(scanned, mapping.withColumn("tenant", F.col("doc_id").cast("string")).drop("doc_id")).select("doc_id", "value", "repl")


@query("range_scan", f"select kind, value, cast(sum(n) as bigint) as n from (select 'v4' as kind, regexp_extract(text, 'hop (\\S+)', 1) as value, count(*) as n from ({DERIVED}) d group by 2 union all select 'v4', '100.127.255.1', count(*) from supplier union all select 'v4', '100.64.0.0', count(*) from supplier "
       f"union all select 'range', regexp_extract(text, 'hop (\\S+)', 1), count(*) from ({DERIVED}) d group by 2 union all select 'range', '100.127.255.1', count(*) from supplier union all select 'range', '100.64.0.0', count(*) from supplier union all select 'range', regexp_extract(text, 'range (100[.]64[.][0-9]+[.]x)', 1), count(*) from ({DERIVED}) d group by 2) u group by kind, value")
def range_scan(spark, sf_dir):
    out = checks.scan_fake_ranges(C.docs_of(C.corpus(spark, sf_dir, DERIVED, ("supplier",))))
    return out.groupBy("kind", "value").agg(F.sum("n").alias("n"))


PHONES = "select c_custkey as doc_id, concat('call +', cast(c_custkey % 10 as varchar), ' (', cast(200 + c_custkey % 700 as varchar), ') 555-', lpad(cast(c_custkey as varchar), 4, '0')) as text from customer"


@query("invalid_e164", f"select doc_id, substr(text, 6) as phone from ({PHONES}) p where doc_id % 10 = 0")
def invalid_e164(spark, sf_dir):
    return checks.invalid_e164(C.corpus(spark, sf_dir, PHONES, ("customer",)))


# --- chat mark-up, JSON, canaries, batches -----------------------------------------------------------

CHAT = """select c_custkey as doc_id, concat('ask <mailto:', c_name, '@x.com|', c_name, '> or <https://x.com/', cast(c_custkey as varchar), '|here> or <https://y.com/', cast(c_custkey as varchar), '>') as text from customer"""


@query("strip_chat_links", "select c_custkey as doc_id, concat('ask ', c_name, ' or https://x.com/', cast(c_custkey as varchar), ' or https://y.com/', cast(c_custkey as varchar)) as text from customer")
def strip_chat_links(spark, sf_dir):
    from veilframe.functions.text import strip_chat_links as strip

    return C.corpus(spark, sf_dir, CHAT, ("customer",)).select("doc_id", strip(F.col("text")).alias("text"))


ARGS = """select c_custkey as doc_id, concat('{"to": "Person-', lpad(cast(c_custkey as varchar), 6, '0'), '", "n": ', cast(c_custkey as varchar), ', "note": ["a \\\\"b\\\\" Person-', lpad(cast(c_custkey as varchar), 6, '0'), '"]}') as text from customer"""


def person_mapping(spark, sf_dir):
    return C.table(spark, sf_dir, "customer").select(
        F.lit("").alias("tenant"), F.concat(F.lit('The "'), "c_name", F.lit('"')).alias("real"), F.concat(F.lit("Person-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("fake"),
        F.lit("person_name").alias("category"), F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("first_seen"))


@query("restore_json", "select c_custkey as doc_id, 'The \"' || c_name || '\"' as to_, c_custkey as n, 'a \"b\" The \"' || c_name || '\"' as note from customer")
def restore_json(spark, sf_dir):
    docs = C.docs_of(C.corpus(spark, sf_dir, ARGS, ("customer",)))
    out = B.restore_json(docs, person_mapping(spark, sf_dir))
    j = F.from_json("text_out", "to string, n bigint, note array<string>")
    return out.select("doc_id", j["to"].alias("to_"), j["n"].alias("n"), j["note"][0].alias("note"))


@query("walk_deep", "select c_custkey as doc_id, 'PERSON-' || lpad(cast(c_custkey as varchar), 6, '0') as to_, c_custkey as n, 'A \"B\" PERSON-' || lpad(cast(c_custkey as varchar), 6, '0') as note from customer")
def walk_deep(spark, sf_dir):
    from veilframe.operators.payload import walk_deep as walk

    docs = C.corpus(spark, sf_dir, ARGS, ("customer",))
    j = F.from_json("json_out", "to string, n bigint, note array<string>")
    return walk(docs, "text", F.upper).select("doc_id", j["to"].alias("to_"), j["n"].alias("n"), j["note"][0].alias("note"))


D_CANARY = "select cast(conv_id as varchar) as session, conv_id * 1000 + turn as doc_id, text from conversations"


def conv_docs(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations")
    return c.select(F.lit("").alias("tenant"), F.col("conv_id").cast("string").alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


TOKEN_SQL = "'mark-' || substr(sha256('secret' || session || ':' || cast(doc_id as varchar)), 1, 16)"


@query("inject_canary", f"select doc_id, text || chr(10) || '<!-- ' || {TOKEN_SQL} || ' -->' as text_out from ({D_CANARY}) c")
def inject_canary(spark, sf_dir):
    from veilframe.operators import canary

    return canary.inject_canary(conv_docs(spark, sf_dir), "mark", "secret").select("doc_id", "text_out")


@query("strip_canary", f"select doc_id, text from ({D_CANARY}) c")
def strip_canary(spark, sf_dir):
    from veilframe.operators import canary

    out = canary.inject_canary(conv_docs(spark, sf_dir), "mark", "secret")
    return out.select("doc_id", B.strip_canary(F.col("text_out"), "mark").alias("text"))


@query("session_canaries", f"select session, doc_id, {TOKEN_SQL} as token, row_number() over (partition by session order by doc_id) as message_index from ({D_CANARY}) c")
def session_canaries(spark, sf_dir):
    from veilframe.operators import canary

    return canary.session_canaries(canary.canary_tokens(conv_docs(spark, sf_dir), "mark", "secret"))


@query("canary_leaks", f"select doc_id as found_in, doc_id, {TOKEN_SQL} as token, session from ({D_CANARY}) c where session like '%3'")
def canary_leaks(spark, sf_dir):
    from veilframe.operators import canary

    docs = conv_docs(spark, sf_dir)
    corpus = canary.inject_canary(docs.filter("session like '%3'"), "mark", "secret").select("doc_id", F.col("text_out").alias("text"))
    return canary.leaked_canaries(corpus.unionByName(docs.select("doc_id", "text")), canary.canary_tokens(docs, "mark", "secret"), "mark")


@query("batch_mixed", f"""with recursive {entities_sql(D_PII, R.named('email', 'ssn'))}, c as (select doc_id, count(*) as n from ents group by doc_id)
 select doc_id * 3 as idx, 'obfuscate' as direction, n, true as modified, cast(null as varchar) as error from c
 union all select c_custkey * 3 + 1, 'deobfuscate', cast(0 as bigint), false, null from customer union all select c_custkey * 3 + 2, 'other', cast(0 as bigint), null, 'Unknown direction: other' from customer""")
def batch_mixed(spark, sf_dir):
    docs = pii_docs(spark, sf_dir)
    ops = docs.select("tenant", "doc_id", "text", F.posexplode(F.array(F.lit("obfuscate"), F.lit("deobfuscate"), F.lit("other"))).alias("k", "direction"))
    ops = ops.select("tenant", (F.col("doc_id") * 3 + F.col("k")).alias("idx"), "direction", F.when(F.col("direction") == "obfuscate", F.col("text")).otherwise("nothing to see").alias("text"))
    out = process_batch(ops, Config(KEYS, R.named("email", "ssn"), context=False, code=False))
    return out.select("idx", "direction", "n", "modified", "error")


@query("batch_restores", f"with recursive {entities_sql(D_PII, R.named('email', 'ssn'))}, c as (select doc_id, count(*) as n from ents group by doc_id) select c.doc_id * 2 + 1 as idx, 'deobfuscate' as direction, d.text, n from c join docs d on d.doc_id = c.doc_id")
def batch_restores(spark, sf_dir):
    """A batch that brings texts and, as answers, their rewritten forms: every answer is restored."""
    config = Config(KEYS, R.named("email", "ssn"), context=False, code=False)
    docs = materialize(pii_docs(spark, sf_dir), "texts")
    answers = materialize(obfuscate(docs, config).docs, "answers").select("tenant", "doc_id", F.col("text_out").alias("text"))
    ops = docs.select("tenant", (F.col("doc_id") * 2).alias("idx"), F.lit("obfuscate").alias("direction"), "text").unionByName(
        answers.select("tenant", (F.col("doc_id") * 2 + 1).alias("idx"), F.lit("deobfuscate").alias("direction"), "text"))
    return process_batch(ops, config).filter("direction = 'deobfuscate'").select("idx", "direction", "text", "n")


@query("obfuscate_corpora", "select (select count(*) from supplier) + (select count(*) from customer) + (select count(*) from part) + (select count(*) from documents) as texts, cast(0 as bigint) as not_restored, cast(0 as bigint) as duplicate_stand_ins")
def obfuscate_corpora(spark, sf_dir):
    """Everything at once: all rules, context and code detectors over all corpora, and back."""
    r = obfuscate(spread(materialize(all_docs(spark, sf_dir), "originals")), Config(KEYS))
    out = materialize(r.docs, "texts")
    back = B.restore_exact(out.select("doc_id", "text", "text_out"), r.entities)
    one = back.join(out.select("doc_id", F.col("text").alias("original")), "doc_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("text_restored") != F.col("original")).alias("not_restored"))
    dup = r.mapping.groupBy("tenant", "fake").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_stand_ins"))
    return side_by_side(one, dup)
