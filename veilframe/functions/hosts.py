"""Host names inside addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Domains reserved for documentation.
DOC_DOMAINS = ["example.com", "example.net", "example.org", "localhost", "invalid"]

# Well-known public domains whose addresses are never sensitive.
PUBLIC_DOMAINS = [
    "youtube.com", "youtu.be", "m.youtube.com",
    "google.com", "google.co.uk", "google.de", "google.fr",
    "github.com", "gitlab.com", "bitbucket.org",
    "stackoverflow.com", "stackexchange.com",
    "wikipedia.org", "wikimedia.org",
    "twitter.com", "x.com",
    "reddit.com",
    "linkedin.com",
    "medium.com",
    "npmjs.com", "pypi.org", "crates.io",
    "docker.com", "hub.docker.com",
    "microsoft.com", "apple.com",
    "mozilla.org",
    "w3.org",
    "archive.org",
]

# Two-part top-level domains.
COMPOUND_TLDS = [".co.uk", ".co.jp", ".co.nz", ".com.au", ".com.br"]


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) address, empty when there is none."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#\s]+)", 1))


def host_under(host: Column, domains: list[str]) -> Column:
    """Is the host one of the domains or below one of them?"""
    test = host.isin(*domains)
    for domain in domains:
        test = test | host.endswith("." + domain)
    return test


def extract_fqdn(url: Column) -> Column:
    """Lower-case host; null for address literals, localhost and bare names."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:]+)", 1))
    literal = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.startswith("[")
    return F.when((host != "") & ~literal & (host != "localhost") & host.contains("."), host)


def org_of_domain(domain: Column) -> Column:
    """The organisation label: ``mail.acme-corp.co.uk`` and ``acme-corp.com`` both give ``acme-corp``."""
    compound = "|".join(t.replace(".", "[.]") for t in COMPOUND_TLDS)
    bare = F.regexp_replace(F.lower(domain), f"({compound}|(?<=.)[.][^.]*)$", "")
    return F.substring_index(bare, ".", -1)
