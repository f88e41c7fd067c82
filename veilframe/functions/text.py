"""Text helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def strip_chat_links(text: Column) -> Column:
    """Chat mark-up back to plain text: mail links to their label, web links to their address."""
    text = F.regexp_replace(text, r"<mailto:[^|>]+\|([^>]*)>", "$1")
    text = F.regexp_replace(text, r"<(https?://[^|>]+)\|[^>]*>", "$1")
    return F.regexp_replace(text, r"<(https?://[^>]+)>", "$1")


def wildcard_to_regex(pattern: Column) -> Column:
    """``*`` and ``?`` wildcards to an anchored, case-insensitive regular expression."""
    escaped = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def redact_masked(value: Column, category: Column) -> Column:
    """Partial mask by category; four characters or fewer are masked whole."""
    n = F.length(value)
    last4 = F.substring(value, -4, 4)
    short = F.concat(F.substring(value, 1, 1), F.lit("***"), F.substring(value, -1, 1))
    default = F.when(n <= 6, short).otherwise(
        F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, -2, 2))
    )
    octets = F.split(value, r"\.")
    return (
        F.when(n <= 4, F.lit("***"))
        .when((category == "email") & (F.instr(value, F.lit("@")) > 1) & value.contains("."),
              F.concat(F.substring(value, 1, 1), F.lit("***@***."), F.substring_index(value, ".", -1)))
        .when(category == "phone", F.concat(F.lit("***"), last4))
        .when(category == "credit_card", F.concat(F.lit("****-****-****-"), last4))
        .when(category == "ssn", F.concat(F.lit("***-**-"), last4))
        .when((category == "ip_address") & value.contains("."),
              F.concat(F.element_at(octets, 1), F.lit("."), F.element_at(octets, 2), F.lit(".*.*")))
        .otherwise(default)
    )
