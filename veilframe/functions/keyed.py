"""Keyed hashing as Spark columns: HMAC-SHA256 and the seeds that drive every stand-in."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Keys:
    """Job secrets: same secret and salt give the same stand-ins in every run.

    The derived pads are literals of the plan; set ``spark.sql.redaction.string.regex`` to
    ``(?i)[0-9a-f]{128}`` so that they never show in plans or event logs.
    """

    secret: str
    salt: str = ""


def hmac_pads(secret: str) -> tuple[str, str]:
    """Hex of the inner and outer HMAC pads (64 bytes each) of a secret."""
    raw = secret.encode("utf-8")
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_hex(secret: str, message: Column) -> Column:
    """HMAC-SHA256 of a string column, as 64 hex digits."""
    ipad, opad = hmac_pads(secret)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad)), F.unhex(inner)), 256)


def hex_to_long(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def seed(value: Column, keys: Keys, tenant: Column | None = None) -> Column:
    """Unsigned 48-bit seed of a value: first six bytes of HMAC(secret, salt + tenant + value)."""
    parts = [F.lit(keys.salt)]
    if tenant is not None:
        parts.append(tenant)
    return hex_to_long(F.substring(hmac_hex(keys.secret, F.concat(*parts, value)), 1, 12))


def salted_hash(text: Column, salt: str = "", length: int = 64) -> Column:
    """SHA-256 of salt + text, cut to ``length`` hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, length)


def build_id(label: Column, version: Column) -> Column:
    """Sixteen hex digits naming a (label, version) pair; blanks around either do not count."""
    name = F.concat_ws(":", F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(version, F.lit(""))))
    return F.substring(F.sha2(name, 256), 1, 16)


def tag_hash(tag: str, seed_col: Column) -> Column:
    """Hash material of a generator: SHA-256 over its tag and the seed."""
    return F.sha2(F.concat(F.lit(tag + ":"), seed_col.cast("string")), 256)
