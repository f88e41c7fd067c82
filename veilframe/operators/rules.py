"""The rule table: priority, guards, overlays and the translation of patterns to Java."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.functions.sql import sql_text
from veilframe.operators.rulebook import RULES

# Every category a finding can have.
CATEGORIES = [
    "person_name", "email", "phone", "ip_address", "api_key", "url", "org_name", "location",
    "file_path", "credit_card", "ssn", "mac_address", "hostname", "snmp_community", "bgp_asn",
    "network_credential", "vlan_id", "interface_desc", "route_map", "ospf_id", "acl_name", "iban",
    "national_id", "jwt", "ics_identifier", "gps_coordinate", "certificate", "date_of_birth",
    "medical_record_number", "bank_account_number", "tax_id", "passport_number", "drivers_license",
    "case_number", "cryptocurrency_address", "aws_arn", "custom",
]

# Rule families: first and last rule name of consecutive runs in the table.
FAMILIES = {
    "core": [("email", "ssn")],
    "keys": [("api_key_generic", "connection_string_password"), ("jwt_token", "pem_certificate")],
    "web": [("url", "mac_address")],
    "network": [("snmp_community", "description_org"), ("vxlan_vni", "panos_service_group")],
    "regulated": [("iban", "gps_coordinate"), ("ldap_bind_dn", "windows_sid")],
    "vendor": [("junos_secret", "ipsec_transform_set")],
    "plant": [("opc_ua_endpoint", "clli_code")],
    "prose": [("prose_password", "base64_prefixed")],
    "health": [("dob_keyword", "health_insurance_id")],
    "finance": [("us_routing_number", "uk_utr")],
    "legal": [("passport_keyword", "aktenzeichen")],
    "cloud": [("crypto_ethereum", "aws_account_id")],
}

# A guard is a cheap necessary condition: some literal that every match of the rule contains.  It is
# tested by byte search before the regular expression runs.  "\d" stands for "any digit".
DIGIT = r"\d"
GUARDS = {
    "email": "@", "ipv6": "re:[0-9a-fA-F]?:[0-9a-fA-F]{0,4}:", "phone_intl": "+",
    "api_key_generic": "sk- sk_ pk- pk_ api- api_ key- key_ token- token_ secret- secret_ access- access_",
    "api_key_test_placeholder": "_TEST_", "api_key_aws": "AKIA", "bearer_token": "Bearer",
    "url_query_password": "password= passwd= secret= token= api_key= apikey=", "connection_string_password": "://",
    "url": "://", "file_path_unix": "/", "file_path_windows": ":\\", "snmp_community": "snmp-server",
    "snmp_host_community": "snmp-server", "snmp_auth_priv": "auth", "cisco_enable_secret": "enable",
    "cisco_password_line": "password", "cisco_username_secret": "username", "cisco_password_hash_type5": "$1$",
    "cisco_password_hash_type8": "$8$", "cisco_password_hash_type9": "$9$", "cisco_type7": "password",
    "key_string": "key-string", "tacacs_key": "tacacs-server", "radius_key": "radius-server",
    "aaa_server_private_key": "server-private", "standalone_key": "key", "junos_tacplus_secret": "secret",
    "ntp_auth_key": "authentication-key", "bgp_asn": "bgp -as", "bgp_neighbor_password": "neighbor",
    "ospf_router_id": "router-id", "ospf_area": "area", "ospf_auth_key": "authentication-key message-digest-key",
    "vrf_name_classic": "vrf", "vrf_definition": "vrf", "vrf_forwarding": "vrf", "vrf_junos": "vrf",
    "route_distinguisher": "rd", "route_target": "route-target", "vlan_name": "vlan", "vlan_range": "vlan",
    "interface_description": "description", "route_map_name": "route-map", "prefix_list_name": "prefix-list",
    "acl_name": "access-list", "cisco_hostname": "hostname", "device_name_dotted": ".rou. .sw. .rtr. .fw.",
    "device_name_short": "RTR SWT FWL APX DST AGG CPE WLC", "device_name_hyphenated": "-",
    "device_name_infra": "-", "syslog_facility": "%", "syslog_source_interface": "trap-source source-interface",
    "circuit_id": "cid circuit", "description_org": "TO FROM WITH", "german_personalausweis": DIGIT,
    "gps_coordinate": ",", "jwt_token": "eyJ", "oauth_refresh_token": "refresh_token",
    "aws_secret_key": "secretaccesskey aws_secret_access_key", "gcp_api_key": "AIza",
    "azure_connection_string": "DefaultEndpointsProtocol=", "slack_token": "xox", "github_pat": "ghp_ gho_ ghu_ ghs_ ghr_",
    "gitlab_token": "glpat-", "stripe_key": "k_live_ k_test_", "sendgrid_key": "SG.", "hashicorp_vault_token": "s.",
    "db_connection_string": "://", "jdbc_url": "jdbc:", "pem_private_key": "PRIVATE|KEY", "pem_certificate": "BEGIN|CERTIFICATE",
    "ldap_bind_dn": "cn=", "ldap_bind_password": "bindpassword ldap_", "ad_domain_login": "\\", "windows_sid": "S-1-5-21",
    "junos_secret": "\"$9$", "junos_preshared_key": "pre-shared-key", "junos_root_auth": "encrypted-password",
    "junos_community": "community", "junos_description": "description", "panos_api_key": "LUFRPT",
    "panos_password_hash": "phash", "panos_master_key": "master-key", "panos_address_object": "ip-netmask",
    "panos_zone_name": "zone", "panos_rule_name": "rulebase", "checkpoint_password_hash": "password-hash",
    "checkpoint_sic_key": "sic", "checkpoint_api_key": "api-key", "checkpoint_object_name": "name",
    "checkpoint_rule_name": "access-rule", "checkpoint_vpn_community": "vpn-community", "arista_secret": "sha512",
    "f5_password": "auth", "f5_ssl_passphrase": "passphrase", "fortinet_password": "ENC",
    "fortinet_private_key": "private-key", "vpn_preshared_key": "shared-key isakmp psk", "ipsec_transform_set": "transform-set",
    "opc_ua_endpoint": "opc.tcp://", "modbus_address": "modbus slave unit", "scada_credential": "scada hmi plc rtu ied",
    "iec61850_ied_name": "iedName", "dnp3_address": "addr", "bacnet_device_id": "bacnet device", "historian_tag": "\\\\",
    "atc_sector_id": "TWR APP ACC CTR GND DEL ATIS", "nav_frequency": "MHz", "icao_designator": "TWR APP GND CTR ATIS RWY SID STAR",
    "imsi": "IMSI imsi", "imei": "IMEI imei", "clli_code": DIGIT, "prose_password": "password",
    "prose_snmp_community": "community", "env_var_secret": "=", "attribute_password": "=",
    "base64_secret_assignment": "= :", "base64_prefixed": "base64:", "vxlan_vni": "vni", "juniper_vlan_name": "vlans",
    "juniper_vlan_id": "vlan-id", "juniper_vlan_members": "members", "switchport_vlan_id": "switchport",
    "vlan_config_id": "vlan", "l2vpn_vpn_id": "vpn", "eigrp_as": "eigrp", "mpls_label_range": "mpls",
    "cisco_banner": "banner", "cisco_line_password": "password", "tacacs_server_name": "tacacs", "radius_server_name": "radius",
    "juniper_firewall_filter": "firewall", "panos_service_group": "service-group", "dob_keyword": "dob birth born geburt",
    "dob_iso": "dob birth", "dob_written": "dob birth born", "mrn_keyword": "mrn medical patient", "npi_number": "npi provider",
    "dea_number": "dea drug", "health_insurance_id": "insurance policy member subscriber group",
    "us_routing_number": "routing aba transit", "bank_account_keyword": "acc", "uk_sort_code": "sort", "swift_bic": "swift bic",
    "us_ein": "ein employer tax", "tax_id_generic": "tin tax", "uk_utr": "utr taxpayer", "passport_keyword": "passport",
    "passport_de": "pass ausweis", "travel_document": "travel", "drivers_license_keyword": "dl driver driving hrerschein",
    "dl_california": "dl driver", "license_plate": "licen registration vehicle kennzeichen plaque",
    "us_federal_case": ":", "case_number_keyword": "case docket cause filing", "patent_number": "US EP WO JP CN KR AU CA",
    "aktenzeichen": "az aktenzeichen", "crypto_ethereum": "0x", "crypto_bitcoin_bech32": "bc1",
    "crypto_wallet_keyword": "wallet crypto bitcoin ethereum eth btc", "aws_arn": "arn:aws", "aws_account_id": "account",
}
# Matches of these rules always hold a digit, and often nothing else that could be searched for.
for _name in ("ipv4", "phone_us", "credit_card", "ssn", "mac_address", "iban", "austrian_svnr", "eu_vat_number",
              "crypto_bitcoin_p2pkh", "crypto_bitcoin_p2sh"):
    GUARDS[_name] = DIGIT
del GUARDS["mac_address"]  # hexadecimal letters alone can form one


# Rules whose every match holds a digit: texts without digits skip them before any other test.
NEEDS_DIGIT = set("""
bgp_asn ospf_router_id ospf_area route_distinguisher route_target vlan_name vlan_range device_name_short
device_name_hyphenated device_name_infra syslog_facility gps_coordinate modbus_address dnp3_address bacnet_device_id imsi imei
nav_frequency vxlan_vni juniper_vlan_id switchport_vlan_id vlan_config_id l2vpn_vpn_id eigrp_as mpls_label_range dob_keyword
dob_iso dob_written npi_number dea_number us_routing_number bank_account_keyword uk_sort_code us_ein tax_id_generic uk_utr
dl_california us_federal_case patent_number aktenzeichen crypto_ethereum crypto_bitcoin_bech32 aws_account_id phone_intl
cisco_password_line cisco_username_secret cisco_type7 ntp_auth_key arista_secret windows_sid
""".split())
# Characters asked for once per text; a guard literal that holds one is only searched when the text has it.
GATES = {"-": "__dash", "_": "__under", ":": "__colon", "$": "__dollar", "=": "__equal", "/": "__slash", "\"": "__quote"}


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    confidence: float
    flags: str
    pattern: str
    detector: str = ""
    full_match: bool = False  # emit the whole match even when the pattern has groups

    @property
    def groups(self) -> int:
        return 0 if self.full_match else re.compile(self.pattern).groups

    @property
    def label(self) -> str:
        return self.detector or f"regex:{self.name}"


BUILTIN = [Rule(*row) for row in RULES]


BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_WORD_ATOM_AFTER = re.compile(r"^(?:\(\?:|\()*(?:[A-Za-z0-9_]|\[[A-Z0-9a-z]|\\[dw])")
_BUILTIN_PATTERNS = {r.pattern for r in BUILTIN}


#: Repeated groups that Java would match by recursion, one level a round, and forms that find the same in a loop.
#: Labels between dots, or parts between backslashes, become one run of characters whose neighbours are tested instead.
_LOOPS = {
    r"(?:/[\w.\-]+){3,}": r"(?:/[\w.\-]+){3,}+",
    r"(?:,(?:OU|DC|O|C)=[^,]+){2,}": r"(?:,(?:OU|DC|O|C)=[^,]+){2,}+",
    r"(?:\\[A-Za-z0-9\-_.]+)*": r"(?:\\[A-Za-z0-9\-_.]+)*+",
    r"(?:[\w.\-]+\\)*[\w.\-]+": r"[\w.\-](?:[\w.\-\\](?<!\\\\))*(?<=[\w.\-])",
    r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}":
        r"[a-zA-Z0-9](?:[a-zA-Z0-9.\-](?<!\.[.\-]|-\.))*(?<![.\-])\.[a-zA-Z]{2,}",
}


def java_pattern(rule: Rule) -> str:
    """Pattern for Java: ASCII word boundaries, inline flags, and slash-separated paths of any length.

    Java's own word boundary counts accented letters as word characters; the look-around form does not.
    """
    text, out, i = rule.pattern, [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append(BOUNDARY if text[i + 1] == "b" else text[i:i + 2])
            i += 2
        else:
            out.append(text[i])
            i += 1
    body = "".join(out)
    if (text in _BUILTIN_PATTERNS and text.startswith(r"\b") and "|" not in _top_level(text)
            and _WORD_ATOM_AFTER.match(text[2:])):
        body = r"(?<!\w)" + body[len(BOUNDARY):]  # the first atom is a word character: half the test is enough
    if text in _BUILTIN_PATTERNS:
        for group, loop in _LOOPS.items():
            body = body.replace(group, loop)
    flags = "".join(f for f in "im" if f in rule.flags)
    first = first_characters(text, "i" in rule.flags) if text in _BUILTIN_PATTERNS else None
    if first and 1 < len(first) < 100:  # most positions fall at one look at their character
        body = f"(?=[{''.join(f'\\x{ord(c):02x}' for c in sorted(first))}])" + (f"(?:{body})" if "|" in _top_level(body) else body)
    return (f"(?{flags})" if flags else "") + body


def first_characters(pattern: str, ignore_case: bool) -> set[str] | None:
    """ASCII characters that a match can begin with, perhaps some more; null where it may be any other, or nothing."""
    from re import _constants as K, _parser

    classes = {K.CATEGORY_DIGIT: string.digits, K.CATEGORY_SPACE: " \t\n\r\f\v", K.CATEGORY_WORD: string.ascii_letters + string.digits + "_"}

    def one(op, arg) -> tuple[set[str], bool] | None:
        """First characters of an element, and whether it may be empty."""
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            return set(), True
        if op is K.LITERAL and arg < 128:
            return {chr(arg)}, False
        if op is K.RANGE and arg[1] < 128:
            return {chr(c) for c in range(arg[0], arg[1] + 1)}, False
        if op is K.CATEGORY and arg in classes:
            return set(classes[arg]), False
        if op is K.IN:
            found = [one(*x) for x in arg]
            return None if None in found else (set().union(*(f[0] for f in found)), False)
        if op is K.BRANCH:
            found = [run(x) for x in arg[1]]
            return None if None in found else (set().union(*(f[0] for f in found)), any(f[1] for f in found))
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            return run(arg[3])
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            found = run(arg[2])
            return found and (found[0], found[1] or arg[0] == 0)
        return None

    def run(items) -> tuple[set[str], bool] | None:
        first: set[str] = set()
        for op, arg in items:
            found = one(op, arg)
            if found is None:
                return None
            first |= found[0]
            if not found[1]:
                return first, False
        return first, True

    found = run(_parser.parse(pattern))
    if found is None or found[1]:
        return None
    return found[0] | {c.swapcase() for c in found[0]} if ignore_case else found[0]


def _top_level(pattern: str) -> str:
    """Characters of a pattern that are outside every group and class."""
    out, depth, in_class, i = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0:
            out.append(c)
        i += 1
    return "".join(out)


def guard(rule: Rule) -> str | None:
    """Cheap necessary condition of a rule as SQL over text, __lower, __digit and the gate columns, or None."""
    spec = GUARDS.get(rule.name)
    if spec is None:
        return None
    if spec == DIGIT:
        return "__digit"
    if spec.startswith("re:"):
        return f"__colon and text rlike {sql_text(spec[3:])}"
    source = "__lower" if "i" in rule.flags else "text"
    tests = []
    for literal in spec.split(" "):
        gates = [GATES[c] for c in literal if c in GATES][:1]
        pieces = [f"contains({source}, {sql_text(p)})" for p in literal.split("|") if p not in GATES]
        tests.append(" and ".join(gates + pieces))
    some = "(" + " or ".join(tests) + ")"
    return f"__digit and {some}" if rule.name in NEEDS_DIGIT else some


def family(*names: str) -> list[Rule]:
    """Built-in rules of one or more families, in priority order."""
    order = {r.name: i for i, r in enumerate(BUILTIN)}
    keep: set[int] = set()
    for name in names:
        for first, last in FAMILIES[name]:
            keep.update(range(order[first], order[last] + 1))
    return [BUILTIN[i] for i in sorted(keep)]


def named(*names: str) -> list[Rule]:
    """Built-in rules by name, in priority order."""
    return [r for r in BUILTIN if r.name in set(names)]


def resolve_category(name: str | None) -> str:
    low = re.sub(r"[^a-z_]", "_", (name or "custom").lower())
    low = {"ip": "ip_address"}.get(low, low)
    return low if low in CATEGORIES else "custom"


def pattern_is_valid(spark: SparkSession, pattern: str, flags: str = "") -> bool:
    """Does the pattern compile?  Asked once per overlay rule, on the driver."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(Rule("x", "custom", 0.9, flags, pattern)))
        re.compile(pattern)
        return True
    except Exception:
        return False


def effective_rules(spark: SparkSession, config: dict | None = None, overrides: dict | None = None,
                    builtin: list[Rule] | None = None) -> list[Rule]:
    """Built-in rules under an overlay: changed, disabled and added rules, then the legacy overrides."""
    config, overrides = config or {}, overrides or {}
    rules: list[Rule] = []
    known = set()
    for rule in builtin if builtin is not None else BUILTIN:
        known.add(rule.name)
        change = config.get(rule.name) or {}
        if change.get("enabled") is False:
            continue
        if change.get("pattern") and pattern_is_valid(spark, change["pattern"], change.get("flags", "")):
            rule = replace(rule, pattern=change["pattern"], flags=change.get("flags", "").replace("g", ""),
                           name=rule.name, detector=rule.label)
            rule = replace(rule, name=rule.name + "~")  # the built-in guard does not hold for a new pattern
        if change.get("confidence") is not None:
            rule = replace(rule, confidence=float(change["confidence"]))
        if change.get("category"):
            rule = replace(rule, category=resolve_category(change["category"]))
        rules.append(rule)
    for name, change in config.items():
        if name in known or change.get("enabled") is False or not change.get("pattern"):
            continue
        if pattern_is_valid(spark, change["pattern"], change.get("flags", "")):
            rules.append(Rule(name, resolve_category(change.get("category")), float(change.get("confidence", 0.9)),
                              change.get("flags", "").replace("g", ""), change["pattern"]))
    kept = []
    for rule in rules:
        change = overrides.get(rule.name.rstrip("~")) or {}
        if change.get("enabled") is False:
            continue
        if change.get("confidence") is not None:
            rule = replace(rule, confidence=float(change["confidence"]))
        kept.append(rule)
    return kept


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule dimension: one row per rule, with its priority."""
    rules = BUILTIN if rules is None else rules
    rows = [(i, r.name.rstrip("~"), r.label, r.category, r.confidence, r.flags, r.pattern, True) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "priority int, name string, detector string, category string, confidence double, flags string, pattern string, enabled boolean"
    )


def overlay_rules(builtin: DataFrame, overlay: DataFrame) -> DataFrame:
    """Rule overlay as a join of two tables: same precedence as ``effective_rules`` for valid patterns.

    ``overlay`` has name, enabled, pattern, flags, category, confidence; nulls keep the built-in value.
    """
    o = overlay.select(*[F.col(c).alias("o_" + c) for c in ("name", "enabled", "pattern", "flags", "category", "confidence")])
    joined = builtin.join(o, builtin["name"] == o["o_name"], "full_outer")
    return (
        joined.filter(F.coalesce("o_enabled", F.lit(True)) & (F.col("name").isNotNull() | F.col("o_pattern").isNotNull()))
        .select(
            F.coalesce("priority", F.lit(100000)).alias("priority"),
            F.coalesce("name", "o_name").alias("name"),
            F.coalesce("o_category", "category", F.lit("custom")).alias("category"),
            F.coalesce("o_confidence", "confidence", F.lit(0.9)).alias("confidence"),
            F.when(F.col("o_pattern").isNotNull(), F.coalesce("o_flags", F.lit(""))).otherwise(F.col("flags")).alias("flags"),
            F.coalesce("o_pattern", "pattern").alias("pattern"),
        )
    )
