"""Shared parts of the queries: inputs, keys, registration, and SQL fragments of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.functions.ip import MASK_PREFIXES
from veilframe.functions.keyed import Keys, hmac_pads
from veilframe.operators.detect import as_docs, spread
from veilframe.operators.rules import Rule
from veilframe.plans import corpora as C

KEYS = Keys("catalog-secret-key", "catalog-salt")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(as_docs(C.table(spark, sf_dir, "documents")))


def net_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(C.docs_of(C.corpus(spark, sf_dir, C.NET_SQL, ("supplier", "nation"))))


def pii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(C.docs_of(C.corpus(spark, sf_dir, C.PII_SQL, ("customer",))))


def secret_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(C.docs_of(C.corpus(spark, sf_dir, C.SECRET_SQL, ("part",))))


def vendor_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(C.docs_of(C.corpus(spark, sf_dir, C.VENDOR_SQL, ("supplier",))))


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and all corpora as one table of texts, ids made unique by their source."""
    parts = [(documents, 0), (net_docs, 1), (pii_docs, 2), (secret_docs, 3)]
    frames = [make(spark, sf_dir).withColumn("doc_id", F.col("doc_id") * 4 + k) for make, k in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    out = rows[0].withColumn("__one", F.lit(1))
    for row in rows[1:]:
        out = out.join(row.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


D_DOCS = "select doc_id, text from documents where text is not null"
D_NET = C.NET_SQL
D_PII = C.PII_SQL
D_SECRET = C.SECRET_SQL
D_VENDOR = C.VENDOR_SQL
D_ALL = f"""select doc_id * 4 as doc_id, text from ({D_DOCS}) union all select doc_id * 4 + 1, text from ({D_NET})
  union all select doc_id * 4 + 2, text from ({D_PII}) union all select doc_id * 4 + 3, text from ({D_SECRET})"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(rule: Rule) -> str:
    flags = "".join(f for f in "im" if f in rule.flags)
    return q((f"(?{flags})" if flags else "") + rule.pattern)


LOOKAROUND = {"ipv6", "phone_intl", "file_path_unix", "vrf_name_classic", "gps_coordinate", "icao_designator", "env_var_secret",
              "cisco_line_password", "cisco_banner"}


def plain(rules: list[Rule]) -> list[Rule]:
    """Rules that RE2 can run: no look-around, no back-reference."""
    return [r for r in rules if r.name not in LOOKAROUND]


def parts_sql(docs: str, rules: list[Rule]) -> str:
    """Every match part with offsets: doc_id, prio, m_no, grp, value, s, e, rule, category, confidence, detector."""
    selects = []
    for prio, r in enumerate(rules):
        groups = [0] if r.groups == 0 else list(range(1, r.groups + 1))
        first = "strpos(m[i], g[i])"
        for grp in groups:
            offset = "0" if grp == 0 else f"{first} - 1"
            value = "m[i]" if grp == 0 else "g[i]"
            selects.append(f"""select doc_id, {prio} as prio, i - 1 as m_no, {grp} as grp, {value} as value,
  coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + {offset} as s,
  {q(r.name)} as rule, {q(r.category)} as category, {r.confidence} as confidence, {q(r.label)} as detector
  from (select doc_id, regexp_extract_all(text, {re2(r)}, 0) as m, regexp_extract_all(text, {re2(r)}, {grp}) as g, string_split_regex(text, {re2(r)}) as p
        from docs where regexp_matches(text, {re2(r)})) z, unnest(range(1, len(m) + 1)) as u(i)""")
    return f"docs as ({docs}), parts as (select *, cast(s + length(value) as bigint) as e from (" + " union all ".join(selects) + ") y where length(value) > 0)"


MASK = "(" + " or ".join(f"starts_with(value, '{p}')" for p in MASK_PREFIXES) + \
    " or regexp_matches(value, '^(0|255)([.](0|255)){3}$'))"


def under(host: str, domains: list[str]) -> str:
    return "(" + " or ".join(f"{host} = '{d}' or ends_with({host}, '.{d}')" for d in domains) + ")"


def doc_sql() -> str:
    from veilframe.functions.hosts import DOC_DOMAINS, PUBLIC_DOMAINS
    from veilframe.operators import examples as X

    both = DOC_DOMAINS + PUBLIC_DOMAINS
    starts = lambda t, ps: "(" + " or ".join(f"starts_with({t}, {q(p)})" for p in ps) + ")"
    isin = lambda t, vs: f"{t} in ({', '.join(q(v) for v in vs)})"
    host = "lower(regexp_extract(value, '(?i)^https?://([^/:?#\\s]+)', 1))"
    path = "regexp_replace(lower(value), '^/www[.]', '/')"
    return f"""case category when 'ip_address' then case when contains(value, ':') then {isin('lower(value)', X.DOC_IPV6_EXACT)} or {starts('lower(value)', X.DOC_IPV6_PREFIXES)}
      else {starts('value', X.DOC_IP_PREFIXES)} end
    when 'email' then {under("split_part(lower(value), '@', 2)", DOC_DOMAINS)} when 'url' then {under(host, both)}
    when 'file_path' then starts_with(value, '/') and ({starts('lower(value)', X.OPERATIONAL_PATH_PREFIXES)} or {starts(path, ['/' + d for d in both])})
    when 'hostname' then {isin('value', X.DOC_HOSTNAMES)} or {isin('upper(value)', X.DOC_HOSTNAMES)} or {under('lower(value)', both)} or {starts('upper(value)', X.DOC_HOSTNAME_PREFIXES)}
    else false end"""


def entities_sql(docs: str, rules: list[Rule], include_doc: bool = False) -> str:
    """CTEs up to ``ents``: rule entities after masks, claims and documentation values."""
    doc = "false" if include_doc else doc_sql()
    inside = "len(list_filter(r.claimed, lambda c: (c.s <= o.s and o.s < c.e) or (c.s < o.e and o.e <= c.e))) = 0"
    return f"""{parts_sql(docs, rules)},
cand as (select *, {doc} as is_doc from parts where not (category = 'ip_address' and {MASK})),
ordered as (select *, row_number() over (partition by doc_id order by prio, m_no, grp) as k from cand),
claims as (select doc_id, cast(0 as bigint) as k, cast([] as struct(s bigint, e bigint)[]) as claimed, false as ok from (select distinct doc_id from ordered) w
  union all select o.doc_id, o.k, case when {inside} then list_append(r.claimed, {{'s': cast(o.s as bigint), 'e': o.e}}) else r.claimed end, {inside}
  from claims r join ordered o on o.doc_id = r.doc_id and o.k = r.k + 1),
ents as (select o.* from ordered o join claims c on c.doc_id = o.doc_id and c.k = o.k where c.ok and not o.is_doc)"""


def resolved_sql(source: str = "ents", out: str = "resolved") -> str:
    """CTEs that sweep overlaps: earliest start, then confidence, then priority."""
    return f"""sorted_{out} as (select *, row_number() over (partition by doc_id order by s, confidence desc, prio, e) as n from {source}),
sweep_{out} as (select doc_id, cast(0 as bigint) as n, cast(-1 as bigint) as last_end, false as keep from (select distinct doc_id from sorted_{out}) w
  union all select o.doc_id, o.n, case when o.s >= r.last_end then o.e else r.last_end end, o.s >= r.last_end
  from sweep_{out} r join sorted_{out} o on o.doc_id = r.doc_id and o.n = r.n + 1),
{out} as (select o.* from sorted_{out} o join sweep_{out} w on w.doc_id = o.doc_id and w.n = o.n where w.keep)"""


def seed_duck(value: str = "value", tenant: str = "''") -> str:
    ipad, opad = hmac_pads(KEYS.secret)
    inner = f"sha256(unhex('{ipad}') || encode({q(KEYS.salt)} || {tenant} || {value}))"
    return f"cast('0x' || substr(sha256(unhex('{opad}') || unhex({inner})), 1, 12) as bigint)"


def material_duck(source: str) -> str:
    """Columns value, category, seed, h, d over a source of (value, category)."""
    return (f"(select *, translate(h, 'abcdef', '012345') as d from (select *, sha256(category || ':' || cast(seed as varchar)) as h "
            f"from (select *, {seed_duck()} as seed from {source}) a) b)")
