"""Addresses in texts and what is known about their hosts.  Look-ups happen elsewhere; their results are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.hosts import PUBLIC_DOMAINS, extract_fqdn
from veilframe.functions.ip import is_private_v4, is_private_v6
from veilframe.functions.text import strip_chat_links

URL = r"""https?://[^\s<>"')\]]+[^\s<>"')\].,;:!?]"""
TTL_SECONDS = 3600


def extract_urls(docs: DataFrame) -> DataFrame:
    """Addresses of each text, chat mark-up removed: (doc_id, n, url)."""
    found = F.regexp_extract_all(strip_chat_links(F.col("text")), F.lit(URL), F.lit(0))
    return docs.filter(F.col("text").contains("://")).select("doc_id", F.posexplode_outer(found).alias("n", "url")).filter("url is not null")


def fresh(resolutions: DataFrame, now: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries of a host table (host, address, resolved_at) that have not expired at ``now``."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("resolved_at")
    return resolutions.filter(age <= ttl_seconds)


def hosts_to_resolve(urls: DataFrame, resolutions: DataFrame, now: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Distinct hosts without a valid entry."""
    hosts = urls.select(extract_fqdn(F.col("url")).alias("host")).filter("host is not null").distinct()
    return hosts.join(fresh(resolutions, now, ttl_seconds).select("host"), "host", "left_anti")


def with_public(resolutions: DataFrame) -> DataFrame:
    """is_public of each entry: a failed look-up counts as private."""
    address = F.col("address")
    private = F.when(address.isNull(), True).when(address.contains(":"), is_private_v6(address)).otherwise(is_private_v4(address))
    return resolutions.withColumn("is_public", ~private)


def classify_urls(urls: DataFrame, resolutions: DataFrame, now: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """is_public (null when unknown or expired, which callers treat as sensitive) and the resolved address."""
    known = with_public(fresh(resolutions, now, ttl_seconds)).select("host", "address", "is_public")
    return urls.withColumn("host", extract_fqdn(F.col("url"))).join(known, "host", "left")


def address_of(urls: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolved address of each URL's host, expired or not, for audits."""
    return urls.withColumn("host", extract_fqdn(F.col("url"))).join(resolutions.select("host", "address"), "host", "left")


def public_domains(urls: DataFrame) -> DataFrame:
    """Is the host, or a domain above it, one of the well-known public ones?  Suffixes turn this into an equality join."""
    spark = urls.sparkSession
    table = F.broadcast(spark.createDataFrame([(d,) for d in PUBLIC_DOMAINS], "suffix string"))  # a fixed list
    hosts = urls.select("url").distinct().withColumn("host", extract_fqdn(F.col("url"))).filter("host is not null")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("url", "host", F.explode(suffixes).alias("suffix")).join(table, "suffix").groupBy("url", "host").agg(
        F.max("suffix").alias("domain"))
