"""Seeds, stand-ins per category, subnets, collisions and the life of a mapping store."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import D_NET, KEYS, material_duck, net_docs, q, query, seed_duck
from veilframe.functions import hosts, ip, keyed, text
from veilframe.operators import fakes as K, mapping as M, subnets as S
from veilframe.plans import corpora as C
from veilframe.session import materialize
from veilframe.sources import readers

# --- values of each category, in the common dialect ------------------------------------------------

CUST, PART, SUPP, ORD = "customer", "part", "supplier", "orders"
VALUES = {
    "credit_card": (CUST, "select concat('4', lpad(cast(c_custkey as varchar), 15, '7')) as value from customer union all select concat('4000-1234-5678-', lpad(cast(c_custkey % 10000 as varchar), 4, '0')) from customer"),
    "ssn": (CUST, "select concat('123-', lpad(cast(c_custkey % 99 as varchar), 2, '0'), '-', lpad(cast(c_custkey as varchar), 4, '0')) as value from customer"),
    "phone": (CUST, "select concat('+1 (', cast(200 + c_custkey % 700 as varchar), ') 555-', lpad(cast(c_custkey % 10000 as varchar), 4, '0')) as value from customer union all select concat(cast(200 + c_custkey % 700 as varchar), ') 555-', lpad(cast(c_custkey % 10000 as varchar), 4, '0')) from customer union all select concat('+4420', lpad(cast(c_custkey as varchar), 8, '7')) from customer"),
    "iban": (CUST, "select concat('at', lpad(cast(c_custkey as varchar), 18, '3')) as value from customer"),
    "email": (CUST, "select concat(case when c_custkey % 3 = 0 then 'bob' when c_custkey % 3 = 1 then 'jane.doe' else 'salesteam' end, cast(c_custkey as varchar), '@mail.acme-', cast(c_nationkey as varchar), '.co.uk') as value from customer"),
    "mac_address": (PART, "select concat('aa:bb:', substring(md5(cast(p_partkey as varchar)), 1, 2), ':', substring(md5(cast(p_partkey as varchar)), 3, 2), ':00:01') as value from part union all select concat('aa-bb-', substring(md5(cast(p_partkey as varchar)), 1, 2), '-01-02-03') from part union all select concat('aabb.', substring(md5(cast(p_partkey as varchar)), 1, 4), '.0001') from part"),
    "bgp_asn": (SUPP, "select cast(64512 + s_suppkey % 1023 as varchar) as value from supplier union all select cast(3000 + s_suppkey * 7 as varchar) from supplier union all select cast(100000 + s_suppkey as varchar) from supplier"),
    "snmp_community": (SUPP, "select concat('net', cast(s_suppkey as varchar), case when s_suppkey % 3 = 0 then '-RO' when s_suppkey % 3 = 1 then '_RW' else 'x' end) as value from supplier"),
    "ospf_id": (SUPP, "select concat('0.0.', cast(s_suppkey % 200 as varchar), '.1') as value from supplier"),
    "route_map": (SUPP, "select concat('RM-PEER-', upper(substring(md5(cast(s_suppkey as varchar)), 1, 5)), '-in') as value from supplier union all select concat('rmap', cast(s_suppkey as varchar)) from supplier"),
    "acl_name": (SUPP, "select concat('ACL-MGMT-', cast(s_suppkey as varchar)) as value from supplier union all select concat('acl_corp', cast(s_suppkey as varchar), '_in') from supplier"),
    "vlan_id": (SUPP, "select cast(s_suppkey as varchar) as value from supplier union all select concat('PROD-', cast(s_suppkey as varchar)) from supplier union all select concat('VRF-X', cast(s_suppkey as varchar)) from supplier union all select concat(cast(s_suppkey as varchar), ',5,9') from supplier"),
    "org_name": (SUPP, "select concat('Acme', cast(s_suppkey as varchar)) as value from supplier union all select concat('Acme Tools ', cast(s_suppkey as varchar)) from supplier union all select concat('A', cast(s_suppkey as varchar), ' Inc') from supplier"),
    "location": (SUPP, "select concat('Town ', cast(s_suppkey as varchar)) as value from supplier"),
    "person_name": (CUST, "select concat('Erika Muster', cast(c_custkey as varchar)) as value from customer union all select concat('Garcia', cast(c_custkey as varchar)) from customer"),
    "api_key": (PART, "select concat('sk-', md5(cast(p_partkey as varchar))) as value from part union all select md5(cast(p_partkey as varchar)) from part"),
    "jwt": (PART, "select concat('eyJ', md5(cast(p_partkey as varchar)), '.eyJx.y') as value from part"),
    "gps_coordinate": (CUST, "select concat('48.', lpad(cast(c_custkey as varchar), 5, '2'), ', 16.12345') as value from customer"),
    "date_of_birth": (CUST, "select concat(cast(1950 + c_custkey % 50 as varchar), '-', lpad(cast(1 + c_custkey % 12 as varchar), 2, '0'), '-', lpad(cast(1 + c_custkey % 28 as varchar), 2, '0')) as value from customer"),
    "medical_record_number": (CUST, "select concat('M-', lpad(cast(c_custkey as varchar), 7, '1')) as value from customer union all select lpad(cast(c_custkey as varchar), 10, '19') from customer"),
    "bank_account_number": (CUST, "select lpad(cast(c_custkey as varchar), 9, '0') as value from customer union all select concat('12-34-', lpad(cast(c_custkey % 100 as varchar), 2, '0')) from customer union all select concat('DEUTDE', upper(substring(md5(cast(c_custkey as varchar)), 1, 2))) from customer"),
    "tax_id": (CUST, "select concat('12-', lpad(cast(c_custkey as varchar), 7, '0')) as value from customer union all select lpad(cast(c_custkey as varchar), 11, '5') from customer"),
    "passport_number": (CUST, "select concat('P', lpad(cast(c_custkey as varchar), 8, '3')) as value from customer"),
    "drivers_license": (CUST, "select concat('D-x', lpad(cast(c_custkey as varchar), 7, '3')) as value from customer"),
    "national_id": (CUST, "select concat('1234 ', lpad(cast(c_custkey as varchar), 6, '0')) as value from customer union all select concat('ATU', lpad(cast(c_custkey as varchar), 8, '6')) from customer union all select concat('LX', lpad(cast(c_custkey as varchar), 8, '4')) from customer"),
    "case_number": (ORD, "select concat('1:23-cv-', lpad(cast(o_orderkey % 100000 as varchar), 5, '0')) as value from orders union all select concat('US', lpad(cast(o_orderkey as varchar), 8, '1'), 'B2') from orders"),
    "cryptocurrency_address": (PART, "select concat('0x', substring(concat(md5(cast(p_partkey as varchar)), md5('x')), 1, 40)) as value from part union all select concat('bc1', substring(concat(md5(cast(p_partkey as varchar)), md5('x')), 1, 40)) from part"),
    "aws_arn": (PART, "select concat('arn:aws:iam::', lpad(cast(p_partkey as varchar), 12, '7'), ':role/part-', cast(p_partkey as varchar)) as value from part union all select lpad(cast(p_partkey as varchar), 12, '4') from part"),
    "custom": (PART, "select p_name as value from part union all select concat(p_name, ' ', cast(p_partkey as varchar)) from part"),
    "ics_identifier": (PART, "select cast(p_partkey % 1000 as varchar) as value from part union all select concat('opc.tcp://plc', cast(p_partkey as varchar), ':4840') from part"),
    "network_credential": (PART, "select concat('$9$', substring(md5(cast(p_partkey as varchar)), 1, 14), '$abc') as value from part union all select concat('Pw!', cast(p_partkey as varchar), 'x') from part"),
    "hostname": (SUPP, "select concat('srv', cast(s_suppkey as varchar)) as value from supplier union all select concat('AMS-CORE-SW-', lpad(cast(s_suppkey as varchar), 3, '0')) from supplier"),
    "url": (CUST, "select concat('http://api.host', cast(c_custkey as varchar), '.acme-', cast(c_nationkey as varchar), '.com:8080/a/', cast(c_custkey as varchar)) as value from customer"),
    "file_path": (PART, "select concat('/opt/app/conf/part', cast(p_partkey as varchar), '.cfg') as value from part"),
    "certificate": (PART, "select concat('KEY', cast(p_partkey as varchar)) as value from part"),
    "interface_desc": (SUPP, "select concat('LINK TO customer', cast(s_suppkey as varchar)) as value from supplier"),
}

# --- the same expressions in DuckDB's dialect --------------------------------------------------------


def pk(words, n):
    return f"[{', '.join(q(w) for w in words)}][cast(({n}) % {len(words)} as int) + 1]"


def dnib(j):
    return f"(strpos('0123456789abcdef', substr(h, cast(({j}) % 64 as int) + 1, 1)) - 1)"


def dbyte(i):
    return f"({dnib(f'2 * ({i})')} * 16 + {dnib(f'2 * ({i}) + 1')})"


def dchar(pool, n):
    return f"substr({q(pool)}, cast(({n}) % {len(pool)} as int) + 1, 1)"


def dmoved(first, size, number):
    return f"chr(cast({ord(first)} + (ascii(c) - {ord(first)} + 1 + {number} % {size - 1}) % {size} as int))"


def dshape(upper):
    return (f"array_to_string(list_transform(string_split(value, ''), lambda c, i: case when c between 'A' and 'Z' then {upper} "
            f"when c between 'a' and 'z' then {dmoved('a', 26, dbyte('i - 1'))} when c between '0' and '9' then {dmoved('0', 10, dbyte('i - 1'))} else c end), '')")


DSHAPE = dshape(dmoved("A", 26, dbyte("i - 1")))


def dpool(pool, n):
    return f"array_to_string(list_transform(range(0, {n}), lambda i: {dchar(pool, dbyte('i'))}), '')"


def d2(x, w=2):
    return f"lpad(cast({x} as varchar), {w}, '0')"


def dorg(key):
    return pk(K.DOMAIN_BASES, seed_duck(f"('org:' || {key})"))


def dsite(key):
    return pk(K.FAKE_SITES, seed_duck(f"('site:' || {key})"))


LOCAL = "split_part(value, '@', 1)"


def dmail(pool):
    number = f"((seed // {len(pool) * 30}) % 100)"
    dotted = f"array_to_string(list_transform(string_split({LOCAL}, '.'), lambda p, i: {pk(K.EMAIL_PREFIXES, 'seed + i - 1')}), '.')"
    return f"case when contains({LOCAL}, '.') then {dotted} else {pk(pool, 'seed')} end || case when {number} > 0 then cast({number} as varchar) else '' end"


DSHORT, DMEDIUM = [p for p in K.EMAIL_PREFIXES if len(p) <= 4], [p for p in K.EMAIL_PREFIXES if 4 < len(p) <= 7]
LUHN = "list_sum(list_transform(range(0, 15), lambda i: case when i % 2 = 0 then case when {x} > 4 then {x} * 2 - 9 else {x} * 2 end else {x} end))".replace(
    "{x}", "cast(substr(d, i + 1, 1) as int)")
CARD = f"(substr(d, 1, 15) || cast((10 - {LUHN} % 10) % 10 as varchar))"
AREA, MID = (f"(cast(2 + {dnib(i)} % 8 as varchar) || substr(d, {at}, 2))" for i, at in (("0", 2), ("3", 5)))
LAST = "substr(d, 7, 4)"
SEP = "case when contains(value, '-') then '-' when contains(value, '.') then '.' when contains(value, ' ') then ' ' else '' end"
CC = "case when regexp_matches(value, '^[+]1[^0-9]') or regexp_matches(value, '^[+]1[0-9]{10}$') then '+1' else regexp_extract(value, '^([+][0-9]{1,3})', 1) end"
MACF = "lpad(printf('%x', (cast('0x' || substr(h, 1, 2) as int) | 2) & 254), 2, '0') || substr(h, 3, 10)"


def dmac(sep):
    return "(select " + f" || '{sep}' || ".join(f"substr(f, {1 + 2 * i}, 2)" for i in range(6)) + f" from (select {MACF} as f) z)"


ASN, SHIFT = "cast(value as bigint)", seed_duck("'asn:'")


def dband(low, size):
    return f"cast({low} + ({ASN} - {low} + {SHIFT} % {size - 1} + 1) % {size} as varchar)"


ROUTE = "upper(value)"
KNOWN_ACL = "x in (" + ", ".join(q(w) for w in K.ACL_PREFIXES + K.ACL_PURPOSES) + ")"
CULTURE = ("case " + " ".join(f"when regexp_matches(value, {q(p)}) then '{n}'" for n, p in K.CULTURE_PATTERNS) + " else 'western' end")


def dname(n):
    first, last = K.NAME_POOLS[n]
    f, la = pk(first, "seed"), pk(last, f"seed // {len(first)}")
    return f"case when contains(value, ' ') then {f} || ' ' || {la} else {f} end"


def axis(number, most):
    return f"printf('%.6f', cast(({number}) % {2000 * most + 1} - {1000 * most} as double) / 1000.0)"


ROUTE_IN = ", ".join(q(w) for w in K.ROUTE_KEEP)
HOST_KEPT = ", ".join(q(w) for w in K.ROLE_KEYWORDS + K.TIER_KEYWORDS)
SIMPLE = f"{pk(K.FAKE_SITES, 'seed // 10')} || '-' || {pk(K.HOST_NOUNS, 'seed')} || '-' || {d2('seed % 99 + 1')}"
DUCK = {
    "credit_card": f"case when contains(value, '-') then substr({CARD}, 1, 4) || '-' || substr({CARD}, 5, 4) || '-' || substr({CARD}, 9, 4) || '-' || substr({CARD}, 13, 4) else {CARD} end",
    "ssn": "'9' || substr(d, 1, 2) || '-' || substr(d, 3, 2) || '-' || substr(d, 5, 4)",
    "phone": f"case when starts_with(value, '+') then concat_ws({SEP}, {CC}, {AREA}, {MID}, {LAST}) when contains(value, '(') then '(' || {AREA} || ') ' || {MID} || '-' || {LAST} when contains(value, ')') then {AREA} || ') ' || {MID} || '-' || {LAST} else concat_ws({SEP}, {AREA}, {MID}, {LAST}) end",
    "iban": "upper(substr(value, 1, 2)) || substr(d, 1, greatest(length(replace(value, ' ', '')) - 2, 13))",
    "email": f"case when length({LOCAL}) between 1 and 4 then {dmail(DSHORT)} when length({LOCAL}) > 7 then {dmail(K.EMAIL_PREFIXES)} else {dmail(DMEDIUM)} end || '@' || {dorg(chr(39) + 'acme-' + chr(39) + ' || regexp_extract(value, ' + q('acme-([0-9]+)') + ', 1)')} || '.uk'",
    "mac_address": f"case when contains(value, '.') then substr({MACF}, 1, 4) || '.' || substr({MACF}, 5, 4) || '.' || substr({MACF}, 9, 4) when contains(value, '-') then {dmac('-')} else {dmac(':')} end",
    "bgp_asn": f"case when {ASN} between 64512 and 65534 then {dband(64512, 1023)} when {ASN} between 1000 and 63999 then {dband(1000, 63000)} else cast({ASN} + {SHIFT} % 100000 + 1 as varchar) end",
    "snmp_community": f"case when regexp_matches(upper(value), '([-_]?RW$|WRITE)') then {pk(K.SNMP_BASES, 'seed')} || '-RW' when regexp_matches(upper(value), '([-_]?R[O0]$|READ)') then {pk(K.SNMP_BASES, 'seed')} || '-RO' else {pk(K.SNMP_COMMUNITIES, 'seed')} end",
    "ospf_id": "'10.' || cast(seed % 256 as varchar) || '.' || cast((seed // 256) % 256 as varchar) || '.' || cast((seed // 65536) % 256 as varchar)",
    "route_map": f"case when not contains(value, '-') then {pk(K.ROUTE_MAP_NAMES, 'seed')} else array_to_string(list_transform(string_split({ROUTE}, '-'), lambda x, i: case when x in ({ROUTE_IN}) then x else {pk(K.PROVIDERS, 'seed + i - 1')} end), '-') end",
    "acl_name": f"case when contains(value, '_') then array_to_string(list_transform(string_split(upper(value), '_'), lambda x, i: case when {KNOWN_ACL} then x when regexp_matches(x, '^[0-9]+$') then cast(100 + seed % 900 as varchar) else {pk(K.FAKE_PURPOSES, 'seed + i - 1')} end), '_') else 'ACL-' || {pk(K.FAKE_PURPOSES, 'seed + 1')} || '-' || cast(100 + seed % 900 as varchar) end",
    "vlan_id": f"case when starts_with(value, 'PROD-') then 'PROD-' || {pk(K.VLAN_NAMES, 'seed')} when starts_with(value, 'VRF-') then 'VRF-' || {pk(K.VLAN_NAMES, 'seed')} when contains(value, ',') then array_to_string(list_transform(string_split(value, ','), lambda x, i: cast(2 + seed % 3900 + i - 1 as varchar)), ',') else cast(2 + seed % 3900 as varchar) end",
    "org_name": f"case length(value) - length(replace(value, ' ', '')) when 0 then {pk(K.ORG_PREFIXES, 'seed')} when 1 then {pk(K.ORG_PREFIXES, 'seed')} || ' ' || {pk(K.ORG_SUFFIXES, 'seed // 24')} else {pk(K.ORG_PREFIXES, 'seed')} || ' ' || {pk(K.ORG_PREFIXES, 'seed + 1')} || ' ' || {pk(K.ORG_SUFFIXES, 'seed // 24')} end",
    "location": pk(K.LOCATIONS, "seed"),
    "person_name": f"case {CULTURE} when 'hispanic' then {dname('hispanic')} when 'western' then {dname('western')} end",
    "api_key": "case when starts_with(value, 'sk-') then 'sk-' || substr(h, 1, 32) else 'sk-test-' || substr(h, 1, 32) end",
    "jwt": f"{q(K.JWT_HEAD)} || replace(translate(to_base64(unhex(h)), '+/', '-_'), '=', '')",
    "gps_coordinate": f"{axis('seed', 60)} || ', ' || {axis('seed // 120001', 180)}",
    "date_of_birth": "strftime(cast(value as date) + cast(30 + seed % 270 as int), '%Y-%m-%d')",
    "medical_record_number": f"case when regexp_matches(value, '^[0-9]{{10}}$') then substr(d, 1, 10) else {DSHAPE} end",
    "bank_account_number": f"case when starts_with(value, 'DEUT') and length(value) = 8 then {pk(K.BANKS, 'seed')} || 'DE' || upper(substr(h, 1, 2)) when contains(value, '-') then substr(d, 1, 2) || '-' || substr(d, 3, 2) || '-' || substr(d, 5, 2) else substr(d, 1, 9) end",
    "tax_id": "case when contains(value, '-') then substr(d, 1, 2) || '-' || substr(d, 3, 7) else substr(d, 1, 11) end",
    "passport_number": DSHAPE, "drivers_license": DSHAPE,
    "national_id": f"case when regexp_full_match(value, '[CFGHJKLMNPRTVWXYZ0-9]{{9,10}}') then {dshape(dchar(K.CARD_LETTERS, dbyte('i - 1')))} else {DSHAPE} end",
    "case_number": "case when contains(value, ':') then substr(d, 1, 1) || ':' || substr(d, 3, 2) || '-cv-' || substr(d, 5, 5) else 'US' || substr(d, 1, 8) || 'B2' end",
    "cryptocurrency_address": f"case when starts_with(value, '0x') then '0x' || substr(h, 1, 40) else 'bc1' || {dpool(K.BECH32, '40')} end",
    "aws_arn": "case when starts_with(value, 'arn:') then 'arn:aws:iam::' || substr(d, 1, 12) || ':role/item-' || substr(h, 1, 10) else substr(d, 1, 12) end",
    "custom": "'[REDACTED-custom-' || substr(h, 1, 12) || ']'",
    "ics_identifier": "case when contains(value, 'opc') then 'opc.tcp://node-' || substr(h, 1, 6) || '.invalid:4' || substr(d, 7, 3) || '/' || substr(h, 10, 8) else cast(seed % 247 + 1 as varchar) end",
    "network_credential": f"case when starts_with(value, '$9$') then '$9$' || substr(h, 1, 14) || '$' || substr(h, 15, 43) else {DSHAPE} end",
    "hostname": f"case when contains(value, '-') then {dsite(q('AMS'))} || '-CORE-SW-' || {d2('seed % 99 + 1', 3)} else {SIMPLE} end",
    "url": f"'http://api.' || {pk(K.PATH_SEGMENTS, 'seed + 1')} || '.' || {dorg(chr(39) + 'acme-' + chr(39) + ' || regexp_extract(value, ' + q('acme-([0-9]+)') + ', 1)')} || '.com:8080/' || {pk(K.PATH_SEGMENTS, 'seed')} || '/' || {pk(K.PATH_SEGMENTS, 'seed + 1')}",
    "file_path": "'/' || " + " || '/' || ".join(pk(K.DIR_NAMES, f"seed + {i}") for i in (1, 2, 3)) + f" || '/' || split_part({pk(K.FILE_NAMES, 'seed + 4')}, '.', 1) || '.cfg'",
    "certificate": "'CERT-' || upper(substr(h, 1, 12))",
    "interface_desc": f"'LINK TO ' || coalesce(nullif(string_split({pk(K.INTERFACE_DESCS, 'seed')}, ' ')[3], ''), 'Link')",
}


def _mint(category):
    source, sql = VALUES[category]
    oracle = f"select value, {DUCK[category]} as fake from {material_duck(f'(select distinct value, {q(category)} as category from ({sql}) v)')} m"

    @query(f"mint_{category}", oracle)
    def run(spark, sf_dir):
        values = C.corpus(spark, sf_dir, sql, (source,)).distinct().select(F.lit("").alias("tenant"), "value", F.lit(category).alias("category"))
        minted, _ = M.mint(values, KEYS, categories=[category])
        return minted.select(F.col("real").alias("value"), "fake")


for _c in VALUES:
    _mint(_c)


@query("seed_values", f"select tenant, value, {seed_duck('value', 'tenant')} as seed from (select distinct n_name as tenant, c_name as value from customer join nation on c_nationkey = n_nationkey) v")
def seed_values(spark, sf_dir):
    c, n = C.table(spark, sf_dir, "customer"), C.table(spark, sf_dir, "nation")
    values = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("tenant"), F.col("c_name").alias("value")).distinct()
    return values.withColumn("seed", keyed.seed(F.col("value"), KEYS, F.col("tenant")))


IP_INT = "(cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 + cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint))"
QUADS = "concat(cast(({0} >> 24) & 255 as varchar), '.', cast(({0} >> 16) & 255 as varchar), '.', cast(({0} >> 8) & 255 as varchar), '.', cast({0} & 255 as varchar))"
KNOWN = f"""docs as ({D_NET}), cidr as (select unnest(regexp_extract_all(text, '\\b(\\d+[.]\\d+[.]\\d+[.]\\d+)/(\\d+)\\b', 1)) as ip, unnest(regexp_extract_all(text, '\\b(\\d+[.]\\d+[.]\\d+[.]\\d+)/(\\d+)\\b', 2)) as p from docs),
 masks as (select unnest(regexp_extract_all(text, '\\b(\\d+[.]\\d+[.]\\d+[.]\\d+) (\\d+[.]\\d+[.]\\d+[.]\\d+)\\b', 1)) as ip, unnest(regexp_extract_all(text, '\\b(\\d+[.]\\d+[.]\\d+[.]\\d+) (\\d+[.]\\d+[.]\\d+[.]\\d+)\\b', 2)) as mk from docs),
 pairs as (select ip, cast(p as int) as prefix_len from cidr union all select ip, 32 - bit_count(4294967295 - {IP_INT.format('mk')}) from masks where starts_with(mk, '255.')),
 known as (select distinct {IP_INT.format('ip')} - {IP_INT.format('ip')} % (1::bigint << (32 - prefix_len)) as real_net, prefix_len from pairs where prefix_len between 8 and 30)"""


@query("subnet_learn", f"with {KNOWN} select real_net, cast(prefix_len as int) as prefix_len from known")
def subnet_learn(spark, sf_dir):
    return S.learn_subnets(net_docs(spark, sf_dir)).select("real_net", "prefix_len")


ALLOC = f"""with {KNOWN}, alloc as (select real_net, prefix_len, {S.POOL_BASE} + coalesce(sum(1::bigint << (32 - prefix_len)) over (order by prefix_len, real_net rows between unbounded preceding and 1 preceding), 0) as fake_net from known)"""


@query("subnet_alloc", f"{ALLOC} select real_net, cast(prefix_len as int) as prefix_len, cast(fake_net as bigint) as fake_net from alloc")
def subnet_alloc(spark, sf_dir):
    return S.allocate_subnets(S.learn_subnets(net_docs(spark, sf_dir))).select("real_net", "prefix_len", "fake_net")


NET_VALUES = f"values_ as (select distinct unnest(regexp_extract_all(text, '\\b10[.]\\d+[.]\\d+[.]\\d+\\b')) as value from docs), nums as (select value, {IP_INT.format('value')} as n from values_)"


@query("prefix_len", f"with {KNOWN}, {NET_VALUES} select value, cast(coalesce(max(k.prefix_len), 24) as int) as prefix_len from nums left join known k on n - n % (1::bigint << (32 - k.prefix_len)) = k.real_net group by value")
def prefix_len(spark, sf_dir):
    docs = net_docs(spark, sf_dir)
    values = docs.select("tenant", F.explode_outer(F.regexp_extract_all("text", F.lit(r"(?<!\w)10[.]\d+[.]\d+[.]\d+(?!\w)"), F.lit(0))).alias("value")).filter("value is not null").distinct()
    return S.prefix_len(values, S.learn_subnets(docs)).select("value", "prefix_len")


@query("mint_ipv4", f"""with {KNOWN}, {NET_VALUES}, placed as (select value, n, coalesce(max(k.prefix_len), 24) as p from nums left join known k on n - n % (1::bigint << (32 - k.prefix_len)) = k.real_net group by value, n),
 nets as (select distinct p, n - n % (1::bigint << (32 - p)) as net from placed),
 alloc as (select p, net, {S.POOL_BASE} + coalesce(sum(1::bigint << (32 - p)) over (order by p, net rows between unbounded preceding and 1 preceding), 0) as fake_net from nets)
 select value, {QUADS.format('(cast(fake_net as bigint) + n - net)')} as fake from placed join alloc on alloc.p = placed.p and net = n - n % (1::bigint << (32 - placed.p))""")
def mint_ipv4(spark, sf_dir):
    docs = net_docs(spark, sf_dir)
    values = docs.select("tenant", F.explode_outer(F.regexp_extract_all("text", F.lit(r"(?<!\w)10[.]\d+[.]\d+[.]\d+(?!\w)"), F.lit(0))).alias("value"))
    values = values.filter("value is not null").distinct().withColumn("category", F.lit("ip_address"))
    minted, _ = M.mint(values, KEYS, S.learn_subnets(docs), categories=["ip_address"])
    return minted.select(F.col("real").alias("value"), "fake")


V6_VALUES = "select concat('2001:470:', substring(md5(cast(c_custkey as varchar)), 1, 4), '::', cast(1 + c_custkey % 9 as varchar)) as value from customer"


@query("mint_ipv6", f"select value, 'fd00:' || " + " || ':' || ".join(f"substr(h, {5 + 4 * i}, 4)" for i in range(7)) + f""" as fake
 from {material_duck(f"(select distinct value, 'ip_address' as category from ({V6_VALUES}) v)")} m""")
def mint_ipv6(spark, sf_dir):
    values = C.corpus(spark, sf_dir, V6_VALUES, (CUST,)).distinct().select(F.lit("").alias("tenant"), "value", F.lit("ip_address").alias("category"))
    minted, _ = M.mint(values, KEYS, S.learn_subnets(net_docs(spark, sf_dir)), categories=["ip_address"])
    return minted.select(F.col("real").alias("value"), "fake")


DNS_VALUES = """select concat('core-SW-', lpad(cast(s_suppkey % 1000 as varchar), 3, '0'), '.dc1.Prod.acme-', cast(s_nationkey as varchar), '.com') as value from supplier
 union all select concat('db', cast(s_suppkey as varchar), '.Team', cast(s_nationkey as varchar), '.qa') from supplier"""


@query("mint_dns_host", f"""select value, case when ends_with(value, '.com')
   then 'core-SW-' || {d2('seed % 99 + 1', 3)} || '.dc1.Prod.' || {dorg("'acme-' || regexp_extract(value, 'acme-([0-9]+)', 1)")} || '.com'
   else lower({pk(K.HOST_NOUNS, 'seed')}) || '.' || {dorg("'team' || regexp_extract(value, 'Team([0-9]+)', 1)")} || '.qa' end as fake
 from {material_duck(f"(select distinct value, 'hostname' as category from ({DNS_VALUES}) v)")} m""")
def mint_dns_host(spark, sf_dir):
    """Dotted names: what says the kind of host or its environment stays, who runs it goes."""
    values = C.corpus(spark, sf_dir, DNS_VALUES, (SUPP,)).distinct().select(F.lit("").alias("tenant"), "value", F.lit("hostname").alias("category"))
    minted, _ = M.mint(values, KEYS, categories=["hostname"])
    return minted.select(F.col("real").alias("value"), "fake")


@query("mint_second_batch", f"""{ALLOC}, {NET_VALUES}, hit as (select value, n, arg_max({{}}, prefix_len) as fake from nums join alloc on n - n % (1::bigint << (32 - prefix_len)) = real_net group by value, n),
 rest as (select value, n, dense_rank() over (order by n - n % 256) - 1 as net from nums where value not in (select value from hit)),
 used as (select coalesce(sum(1::bigint << (32 - prefix_len)), 0) as total from known),
 placed as (select value, fake from hit union all select value, {S.POOL_BASE} + cast(ceil(total / 256) as bigint) * 256 + net * 256 + n % 256 as fake from rest, used)
 select value, {QUADS.format('cast(fake as bigint)')} as fake from placed""".replace("{}", "cast(fake_net as bigint) + n - real_net"))
def mint_second_batch(spark, sf_dir):
    """The first batch announces subnets, the second holds addresses alone: they go to the blocks of the first."""
    docs = net_docs(spark, sf_dir)
    first = materialize(S.allocate_subnets(S.learn_subnets(docs)), "subnets")
    values = docs.select("tenant", F.explode_outer(F.regexp_extract_all("text", F.lit(r"(?<!\w)10[.]\d+[.]\d+[.]\d+(?!\w)"), F.lit(0))).alias("value"))
    values = values.filter("value is not null").distinct().withColumn("category", F.lit("ip_address"))
    minted, _ = M.mint(values, KEYS, existing_subnets=first, categories=["ip_address"])
    return minted.select(F.col("real").alias("value"), "fake")


def minted_people(spark, sf_dir):
    """Personal values of all customers with stand-ins, two small-pool categories among them."""
    frames = None
    for category in ("email", "phone", "snmp_community", "location", "vlan_id", "passport_number"):
        source, sql = VALUES[category]
        v = C.corpus(spark, sf_dir, sql, (source,)).select(F.lit("").alias("tenant"), "value", F.lit(category).alias("category"))
        frames = v if frames is None else frames.unionByName(v)
    values = frames.groupBy("tenant", "value").agg(F.min("category").alias("category")).withColumn("first_seen", F.length("value").cast("bigint"))
    minted, _ = M.mint(values, KEYS, categories=["email", "phone", "snmp_community", "location", "vlan_id", "passport_number"])
    return minted


ALL_VALUES = " union all ".join(f"select value, '{c}' as category from ({VALUES[c][1]}) v" for c in ("email", "phone", "snmp_community", "location", "vlan_id", "passport_number"))


@query("fix_collisions", f"select count(*) as mapped, count(*) as stand_ins, cast(0 as bigint) as same_as_real from (select distinct value from ({ALL_VALUES}) a) b")
def fix_collisions(spark, sf_dir):
    m = M.fix_collisions(minted_people(spark, sf_dir), KEYS)
    return m.agg(F.count(F.lit(1)).alias("mapped"), F.countDistinct("tenant", "fake").alias("stand_ins"), F.count_if(F.col("fake") == F.col("real")).alias("same_as_real"))


def simple_store(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("tenant"), F.col("c_name").alias("real"), F.concat(F.lit("Person-"), (F.col("c_custkey") % 700).cast("string")).alias("fake"),
                    F.lit("person_name").alias("category"), F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("first_seen"))


D_STORE = "(select c_mktsegment as tenant, c_name as real, concat('Person-', cast(c_custkey % 700 as varchar)) as fake, 'person_name' as category, c_custkey as seed, c_custkey as first_seen from customer)"


@query("evict_store", f"select tenant, real, first_seen from (select *, row_number() over (partition by tenant order by first_seen desc) as r from {D_STORE} s) t where r <= 100")
def evict_store(spark, sf_dir):
    return M.evict(simple_store(spark, sf_dir), 100).select("tenant", "real", "first_seen")


@query("reverse_map", f"select tenant, fake, arg_max(real, first_seen) as real from {D_STORE} s group by tenant, fake")
def reverse_map(spark, sf_dir):
    return M.reverse_map(simple_store(spark, sf_dir)).select("tenant", "fake", "real")


@query("upsert_store", f"select tenant, real, fake from {D_STORE} s union all select 'FURNITURE', o_orderpriority || cast(o_orderkey as varchar), 'new' from orders union all select tenant, real || '!', fake || '!' from {D_STORE} z")
def upsert_store(spark, sf_dir):
    store = simple_store(spark, sf_dir)
    extra = C.table(spark, sf_dir, "orders").select(
        F.lit("FURNITURE").alias("tenant"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("real"), F.lit("new").alias("fake"),
        F.lit("custom").alias("category"), F.col("o_orderkey").alias("seed"), F.col("o_orderkey").alias("first_seen"))
    changed = store.withColumn("fake", F.lit("changed"))
    bang = store.withColumns({"real": F.concat("real", F.lit("!")), "fake": F.concat("fake", F.lit("!"))})
    return M.upsert_store(store, extra.unionByName(changed).unionByName(bang)).select("tenant", "real", "fake")


@query("partition_store", f"select count(distinct tenant) as tenants, count(*) as n, count(distinct seed) as seeds from (select tenant, value, {seed_duck('value', 'tenant')} as seed from (select n_name as tenant, c_name as value from customer, nation where c_custkey % 25 = n_nationkey or n_nationkey = 0) v) w")
def partition_store(spark, sf_dir):
    c, n = C.table(spark, sf_dir, "customer"), C.table(spark, sf_dir, "nation")
    names = c.select(F.col("c_name").alias("value"), F.explode(F.array_distinct(F.array((F.col("c_custkey") % 25).cast("int"), F.lit(0)))).alias("n_nationkey"))
    values = names.join(n, "n_nationkey").select(F.col("n_name").alias("tenant"), "value")
    seeds = values.withColumn("seed", keyed.seed(F.col("value"), KEYS, F.col("tenant")))
    return seeds.agg(F.countDistinct("tenant").alias("tenants"), F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("seeds"))


@query("store_roundtrip", "select c_mktsegment as tenant, c_name as real, concat('Person-', cast(c_custkey % 700 as varchar)) as fake, 'person_name' as category, 's1' as salt, '2026-01-01T00:00:00Z' as exported_at from customer")
def store_roundtrip(spark, sf_dir):
    return readers.parse_export(readers.export_rows(simple_store(spark, sf_dir), "s1", "2026-01-01T00:00:00Z"))


@query("consistency_check", "select count(distinct p_name) as same, cast(0 as bigint) as different from part")
def consistency_check(spark, sf_dir):
    values = C.table(spark, sf_dir, "part").select(F.lit("").alias("tenant"), F.col("p_name").alias("value"), F.lit("custom").alias("category")).distinct()
    return M.consistency_check(M.mint(values, KEYS, categories=["custom"])[0], M.mint(values, KEYS, categories=["custom"])[0])


# --- scalar helpers over table columns ---------------------------------------------------------------

IPS = "select concat(cast(o_orderkey % 256 as varchar), '.', cast(o_custkey % 256 as varchar), '.', cast(o_orderkey % 100 as varchar), '.7') as ip from orders"


@query("ip_numbers", f"select ip, {IP_INT.format('ip')} as n, ip as back, ({IP_INT.format('ip')} - {IP_INT.format('ip')} % 1048576 = 2886729728) as inside from ({IPS}) i")
def ip_numbers(spark, sf_dir):
    rows = C.corpus(spark, sf_dir, IPS, ("orders",))
    n = ip.ip_to_int(F.col("ip"))
    return rows.select("ip", n.alias("n"), ip.int_to_ip(n).alias("back"), ip.in_cidr(F.col("ip"), F.lit("172.16.0.0/12")).alias("inside"))


@query("private_ranges", f"""select a, b, bool_or(a in (0, 10, 127) or a >= 224 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 100 and b between 64 and 127)) as private
 from (select cast(split_part(ip, '.', 1) as int) as a, cast(split_part(ip, '.', 2) as int) as b from ({IPS}) i) z group by a, b""")
def private_ranges(spark, sf_dir):
    rows = C.corpus(spark, sf_dir, IPS, ("orders",))
    parts = F.split("ip", r"\.")
    return rows.groupBy(parts[0].cast("int").alias("a"), parts[1].cast("int").alias("b")).agg(F.bool_or(ip.is_private_v4(F.col("ip"))).alias("private"))


V6 = "select concat('2001:db8:', substring(md5(cast(p_partkey as varchar)), 1, 4), '::', cast(p_partkey % 10 as varchar)) as addr from part"


@query("ipv6_forms", f"select addr, concat('2001:0db8:', split_part(addr, ':', 3), ':0000:0000:0000:0000:000', split_part(addr, ':', 5)) as full_form, count(*) as n from ({V6}) v group by addr")
def ipv6_forms(spark, sf_dir):
    return C.corpus(spark, sf_dir, V6, ("part",)).select("addr", ip.expand_ipv6(F.col("addr")).alias("full_form")).groupBy("addr", "full_form").agg(F.count(F.lit(1)).alias("n"))


@query("build_ids", "select p_brand, p_size, substr(sha256(trim(p_brand) || ':' || trim(' ' || cast(p_size as varchar))), 1, 16) as id, count(*) as n from part group by p_brand, p_size")
def build_ids(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    return p.select("p_brand", "p_size", keyed.build_id(F.col("p_brand"), F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("id")).groupBy("p_brand", "p_size", "id").agg(F.count(F.lit(1)).alias("n"))


@query("culture_of", f"select value, {CULTURE} as culture from ({VALUES['person_name'][1]}) v")
def culture_of(spark, sf_dir):
    return C.corpus(spark, sf_dir, VALUES["person_name"][1], ("customer",)).select("value", F.expr(K.culture()).alias("culture"))


@query("org_domains", f"select value, 'acme-' || regexp_extract(value, 'acme-([0-9]+)', 1) as org from ({VALUES['email'][1]}) v")
def org_domains(spark, sf_dir):
    rows = C.corpus(spark, sf_dir, VALUES["email"][1], ("customer",))
    return rows.select("value", hosts.org_of_domain(F.substring_index("value", "@", -1)).alias("org"))


@query("redact_masked", f"""select value, case when length(value) <= 4 then '***' when category = 'email' then substr(value, 1, 1) || '***@***.' || regexp_extract(value, '[.]([^.]*)$', 1)
 when category = 'phone' then '***' || right(value, 4) when length(value) <= 6 then substr(value, 1, 1) || '***' || right(value, 1) else substr(value, 1, 2) || '***' || right(value, 2) end as mask
 from ({ALL_VALUES}) v""")
def redact_masked(spark, sf_dir):
    frames = None
    for category in ("email", "phone", "snmp_community", "location", "vlan_id", "passport_number"):
        v = C.corpus(spark, sf_dir, VALUES[category][1], (VALUES[category][0],)).withColumn("category", F.lit(category))
        frames = v if frames is None else frames.unionByName(v)
    return frames.select("value", text.redact_masked(F.col("value"), F.col("category")).alias("mask"))
