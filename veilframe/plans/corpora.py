"""Test corpora: larger and richer texts derived from the given tables by column arithmetic.

Each corpus is one SELECT in the common dialect of Spark SQL and DuckDB, so an oracle can build the same
rows.  ``{t}`` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Network configuration: one block of lines per supplier x nation key, numbers from the keys.
NET_SQL = """
select s_suppkey as doc_id,
  concat('hostname ', upper(substring(n_name, 1, 3)), '-CORE-RTR-', lpad(cast(s_suppkey % 97 as varchar), 2, '0'), chr(10),
    'interface Gi0/', cast(s_suppkey % 48 as varchar), chr(10),
    ' description UPLINK TO ', upper(substring(n_name, 1, 3)), '-DIST-SW-', lpad(cast(s_suppkey % 89 as varchar), 2, '0'), chr(10),
    ' ip address 10.', cast(s_nationkey as varchar), '.', cast(s_suppkey % 250 as varchar), '.1 255.255.255.0', chr(10),
    ' ip address 172.20.', cast(s_suppkey % 200 as varchar), '.', cast((s_suppkey * 4) % 256 as varchar), ' 255.255.255.252', chr(10),
    'ip route 10.', cast(s_nationkey as varchar), '.', cast(s_suppkey % 250 as varchar), '.0/24 172.20.', cast(s_suppkey % 200 as varchar), '.', cast((s_suppkey * 4 + 1) % 256 as varchar), chr(10),
    'router bgp ', cast(64512 + s_suppkey % 1000 as varchar), chr(10),
    ' neighbor 10.', cast(s_nationkey as varchar), '.', cast(s_suppkey % 250 as varchar), '.9 remote-as ', cast(64513 + s_suppkey % 1000 as varchar), chr(10),
    'snmp-server community Net', substring(md5(cast(s_suppkey as varchar)), 1, 8), '-RO RO', chr(10),
    'route-map RM-PEER-', upper(substring(n_name, 1, 4)), '-IN permit 10', chr(10),
    'ip access-list extended ACL-', upper(substring(n_name, 1, 4)), '-', cast(s_suppkey % 300 as varchar), chr(10),
    'vlan ', cast(100 + s_suppkey % 900 as varchar), chr(10), ' name VLAN_', cast(s_suppkey as varchar), chr(10),
    'enable secret 5 $1$', substring(md5(concat('s', cast(s_suppkey as varchar))), 1, 4), '$', substring(md5(concat('h', cast(s_suppkey as varchar))), 1, 22), chr(10),
    'ip ospf 1 area 0.0.0.', cast(s_suppkey % 9 as varchar), chr(10),
    'mac ', substring(md5(concat('m', cast(s_suppkey as varchar))), 1, 4), '.', substring(md5(concat('m', cast(s_suppkey as varchar))), 5, 4), '.', substring(md5(concat('m', cast(s_suppkey as varchar))), 9, 4)
  ) as text
from supplier join nation on s_nationkey = n_nationkey
"""

# Personal, health, finance and legal data: one text per customer.
PII_SQL = """
select c_custkey as doc_id,
  concat('Mail john.smith', cast(c_custkey as varchar), '@acme-', cast(c_nationkey as varchar), '.com or call ', cast(200 + c_custkey % 700 as varchar), '-555-', lpad(cast(c_custkey % 10000 as varchar), 4, '0'), '.', chr(10),
    'SSN ', lpad(cast(100 + c_custkey % 500 as varchar), 3, '0'), '-', lpad(cast(10 + c_custkey % 80 as varchar), 2, '0'), '-', lpad(cast(1000 + c_custkey % 9000 as varchar), 4, '0'), ', card 4', lpad(cast(c_custkey % 1000 as varchar), 3, '0'), ' 1234 ', lpad(cast(c_custkey % 7919 as varchar), 4, '0'), ' 9', lpad(cast(c_custkey % 991 as varchar), 3, '0'), '.', chr(10),
    'IBAN DE', lpad(cast(c_custkey % 97 as varchar), 2, '0'), lpad(cast(c_custkey as varchar), 16, '37'), '00', chr(10),
    'DOB: ', lpad(cast(1 + c_custkey % 12 as varchar), 2, '0'), '/', lpad(cast(1 + c_custkey % 28 as varchar), 2, '0'), '/', cast(1950 + c_custkey % 50 as varchar), chr(10),
    'MRN: M', lpad(cast(c_custkey as varchar), 7, '4'), ' NPI: ', lpad(cast(c_custkey as varchar), 10, '17'), ' DEA: AB', lpad(cast(c_custkey as varchar), 7, '5'), chr(10),
    'routing number: ', lpad(cast(c_custkey as varchar), 9, '02'), ', account number: ', lpad(cast(c_custkey as varchar), 10, '83'), ', EIN: ', lpad(cast(c_custkey % 100 as varchar), 2, '0'), '-', lpad(cast(c_custkey as varchar), 7, '6'), chr(10),
    'sort code: ', lpad(cast(c_custkey % 100 as varchar), 2, '0'), '-', lpad(cast(c_custkey % 90 as varchar), 2, '1'), '-', lpad(cast(c_custkey % 80 as varchar), 2, '2'), chr(10),
    'passport no: P', lpad(cast(c_custkey as varchar), 8, '3'), ', driver license: D', lpad(cast(c_custkey as varchar), 7, '9'), ', docket no: ', cast(1 + c_custkey % 9 as varchar), ':', lpad(cast(c_custkey % 30 as varchar), 2, '2'), '-cv-', lpad(cast(c_custkey as varchar), 5, '0'), chr(10),
    'GPS 48.', lpad(cast(c_custkey % 100000 as varchar), 5, '2'), ', 16.', lpad(cast(c_custkey % 90000 as varchar), 5, '3'), chr(10),
    'see https://portal', cast(c_custkey % 50 as varchar), '.acme-', cast(c_nationkey as varchar), '.com/users/', cast(c_custkey as varchar), '/profile'
  ) as text
from customer
"""

# Keys, tokens, cloud and crypto identifiers: one text per part.
SECRET_SQL = """
select p_partkey as doc_id,
  concat('aws AKIA', upper(substring(md5(cast(p_partkey as varchar)), 1, 16)), chr(10),
    'github ghp_', substring(concat(md5(cast(p_partkey as varchar)), md5(concat('g', cast(p_partkey as varchar)))), 1, 36), chr(10),
    'use sk-', md5(concat('k', cast(p_partkey as varchar))), chr(10),
    'Authorization: Bearer ', md5(concat('b', cast(p_partkey as varchar))), chr(10),
    'stripe sk_live_', substring(md5(concat('s', cast(p_partkey as varchar))), 1, 24), chr(10),
    'gitlab glpat-', substring(md5(concat('l', cast(p_partkey as varchar))), 1, 20), chr(10),
    'postgres://app:pw', cast(p_partkey as varchar), '@db', cast(p_partkey % 20 as varchar), '.internal/prod', chr(10),
    'eth 0x', substring(concat(md5(concat('e', cast(p_partkey as varchar))), md5(concat('f', cast(p_partkey as varchar)))), 1, 40), chr(10),
    'role arn:aws:iam::', lpad(cast(p_partkey as varchar), 12, '7'), ':role/part-', cast(p_partkey as varchar), chr(10),
    'file /opt/app/conf/part', cast(p_partkey as varchar), '.cfg', chr(10),
    'opc.tcp://plc', cast(p_partkey as varchar), ':4840/ns', chr(10),
    'modbus: ', cast(1 + p_partkey % 200 as varchar), ', frequency 118.', cast(p_partkey % 10 as varchar), ' MHz', chr(10),
    'login with password Secret', cast(p_partkey as varchar), '!', chr(10),
    'mail notice', cast(p_partkey as varchar), '@example.com and http://docs.example.com/p/', cast(p_partkey as varchar)
  ) as text
from part
"""

# Agent tool calls from the event table.
TOOL_CALLS_SQL = """
select event_id, user_id, cast(user_id as varchar) as session, event_id as seq, event_type as tool,
  cast(floor(event_id / 50) as bigint) as turn, props,
  case when event_type in ('view', 'click', 'signup') then 1 else -1 end as delta, value as ms
from events
"""

# Prompt history lines, with control prompts and broken lines among them.
HISTORY_SQL = """
select event_id,
  case when event_id % 50 = 7 then concat('{broken ', cast(event_id as varchar))
    else concat('{{"session_id": "', case when event_id % 40 = 3 then '' else concat('s', cast(user_id as varchar)) end,
      '", "ts": ', case when event_id % 30 = 5 then '"soon"' else cast(1700000000 + event_id as varchar) end,
      ', "text": "', case when event_id % 9 = 2 then ' Exit ' else concat('do ', event_type) end, '"}}') end as value
from events
""".replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """Rows of a corpus SELECT over the given tables."""
    frames = {t: table(spark, sf_dir, t) for t in tables}
    text = sql.replace("as varchar", "as string").replace("chr(10)", "'\\n'")
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    text = _escape_braces(text, tables)
    return spark.sql(text, **frames)


def _escape_braces(text: str, tables: tuple[str, ...]) -> str:
    """Literal braces doubled, table markers kept, as the parameterised ``spark.sql`` wants them."""
    doubled = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        doubled = doubled.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return doubled


def docs_of(df: DataFrame, tenant: str = "") -> DataFrame:
    return df.select(F.lit(tenant).alias("tenant"), "doc_id", "text")

# Vendor configuration: one text per supplier with lines of several product families.
VENDOR_SQL = """
select s_suppkey as doc_id,
  concat('set system root-authentication encrypted-password "$6$', substring(md5(cast(s_suppkey as varchar)), 1, 12), '"', chr(10),
    'set snmp community Pub', cast(s_suppkey as varchar), ' authorization read-only', chr(10),
    'pre-shared-key ascii-text "psk', cast(s_suppkey as varchar), '"', chr(10),
    'secret "$9$', substring(md5(concat('j', cast(s_suppkey as varchar))), 1, 16), '"', chr(10),
    'set interfaces ge-0/0/1 description "to rack ', cast(s_suppkey as varchar), '"', chr(10),
    'set mgt-config users admin phash ', md5(concat('p', cast(s_suppkey as varchar))), chr(10),
    'set address srv-', cast(s_suppkey as varchar), ' ip-netmask 10.0.0.1', chr(10),
    'set zone zone', cast(s_suppkey as varchar), ' network layer3', chr(10),
    'set rulebase security rules "rule', cast(s_suppkey as varchar), '" action allow', chr(10),
    'add host name "h', cast(s_suppkey as varchar), '" ip-address 10.1.1.1', chr(10),
    'add access-rule layer net name "ar', cast(s_suppkey as varchar), '"', chr(10),
    'username x secret sha512 $6$', substring(md5(concat('a', cast(s_suppkey as varchar))), 1, 8), '$', md5(concat('b', cast(s_suppkey as varchar))), chr(10),
    'set password ENC ', substring(md5(concat('f', cast(s_suppkey as varchar))), 1, 20), chr(10),
    'crypto isakmp key isk', cast(s_suppkey as varchar), ' address 10.2.2.2', chr(10),
    'crypto ipsec transform-set TS', cast(s_suppkey as varchar), ' esp-aes', chr(10),
    'passphrase pp', cast(s_suppkey as varchar), chr(10), 'auth password ap', cast(s_suppkey as varchar)
  ) as text
from supplier
"""
