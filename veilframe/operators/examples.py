"""Values that are never sensitive: documentation ranges, public domains, operational paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.functions.hosts import DOC_DOMAINS, PUBLIC_DOMAINS
from veilframe.functions.sql import host_under_sql, one_of, starts_with_any

# Documentation address prefixes.
DOC_IP_PREFIXES = ["233.252.0.", "100.51.16."]
DOC_IPV6_PREFIXES = ["2001:db8:", "2001:0db8:"]
DOC_IPV6_EXACT = ["::1", "::0", "::"]

# Local paths that tools need to work.
OPERATIONAL_PATH_PREFIXES = ["/home/", "/tmp/", "/proc/", "/sys/", "/dev/", "/run/", "/snap/", "/root/", "/nix/"]

# Placeholder host names and their prefixes.
DOC_HOSTNAMES = ["localhost", "HOSTNAME", "EXAMPLE", "CHANGEME", "YOUR_HOST", "YOURHOST", "hostname", "example"]
DOC_HOSTNAME_PREFIXES = ["TEST-NET-", "TEST-", "RFC-", "EXAMPLE-", "SAMPLE-", "DEMO-", "DUMMY-", "PLACEHOLDER-",
                         "CHANGEME-", "TODO-"]




def doc_example_sql(value: str = "value", category: str = "category") -> str:
    low, up = f"lower({value})", f"upper({value})"
    domains = DOC_DOMAINS + PUBLIC_DOMAINS
    host = f"lower(regexp_extract({value}, '(?i)^https?://([^/:?#\\\\s]+)', 1))"
    path = f"regexp_replace({low}, '^/www[.]', '/')"
    return f"""case {category}
      when 'ip_address' then case when contains({value}, ':')
        then {one_of(low, DOC_IPV6_EXACT)} or {starts_with_any(low, DOC_IPV6_PREFIXES)}
        else {starts_with_any(value, DOC_IP_PREFIXES)} end
      when 'email' then {host_under_sql(f"substring_index({low}, '@', -1)", DOC_DOMAINS)}
      when 'url' then {host_under_sql(host, domains)}
      when 'file_path' then startswith({value}, '/') and ({starts_with_any(low, OPERATIONAL_PATH_PREFIXES)}
        or {starts_with_any(path, ["/" + d for d in domains])})
      when 'hostname' then {one_of(value, DOC_HOSTNAMES)} or {one_of(up, DOC_HOSTNAMES)}
        or {host_under_sql(low, domains)} or {starts_with_any(up, DOC_HOSTNAME_PREFIXES)}
      else false end"""


def is_doc_example(value: str = "value", category: str = "category") -> Column:
    """True for values that a scan recognises but must leave alone (arguments are SQL expressions).

    Hosts are compared whole or by suffix, so ``example.community`` is not mistaken for ``example.com``.
    """
    return F.expr(doc_example_sql(value, category))
