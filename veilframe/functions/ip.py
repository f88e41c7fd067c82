"""IPv4 and IPv6 arithmetic on columns.  IPv4 numbers are BIGINT, never INT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.functions.sql import starts_with_any

# Prefixes of subnet masks and wildcard masks, which are not addresses.
MASK_PREFIXES = [
    "255.", "0.0.0.", "0.0.255.", "0.0.15.", "0.0.3.", "0.0.1.",
    "0.255.", "0.128.", "0.192.", "0.224.", "0.240.", "0.248.",
    "0.252.", "128.0.", "192.0.0.", "224.0.", "240.0.", "248.0.",
    "252.0.", "254.0.", "127.0.",
]


def ip_to_int(ip: Column) -> Column:
    def octet(i: int) -> Column:
        return F.try_element_at(F.split(ip, r"\."), F.lit(i)).cast("bigint")

    return octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)


def int_to_ip(number: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)],
    )


def block_size(prefix_len: Column) -> Column:
    """Number of addresses of a /prefix_len block."""
    return F.pow(F.lit(2), F.lit(32) - prefix_len).cast("bigint")


def network_of(number: Column, prefix_len: Column) -> Column:
    size = block_size(prefix_len)
    return number - F.pmod(number, size)


def in_cidr(ip: Column, cidr: Column) -> Column:
    """Is the address inside ``a.b.c.d/len``?"""
    length = F.substring_index(cidr, "/", -1).cast("int")
    base = ip_to_int(F.substring_index(cidr, "/", 1))
    return network_of(ip_to_int(ip), length) == network_of(base, length)


def valid_ipv4(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    ok = F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.cast("int") <= 255))
    return (F.size(parts) == 4) & ok


def mask_sql(ip: str = "value") -> str:
    """Subnet and wildcard masks (255.255.255.0, 0.0.0.255, ...) as SQL over an expression."""
    return f"({starts_with_any(ip, MASK_PREFIXES)} or {ip} rlike '^(0|255)([.](0|255)){{3}}$')"


def is_mask(ip: str = "value") -> Column:
    return F.expr(mask_sql(ip))


def is_private_v4(ip: Column) -> Column:
    """Private, loopback, link-local, carrier-grade, multicast and reserved space; malformed counts as private."""
    parts = F.split(ip, r"\.")
    numeric = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    a = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    b = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    private = (
        a.isin(0, 10, 127) | (a >= 224)
        | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    )
    return F.when(~numeric, True).otherwise(private)


def is_private_v6(ip: Column) -> Column:
    low = F.lower(ip)
    return low.isin("::1", "::") | low.startswith("fc") | low.startswith("fd") | low.startswith("fe80")


def expand_ipv6(addr: Column) -> Column:
    """Full eight-group lower-case form; text that is not a full or '::' address is only lower-cased."""
    clean = F.lower(F.substring_index(addr, "/", 1))

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    left = groups(F.substring_index(clean, "::", 1))
    right = groups(F.substring_index(clean, "::", -1))
    missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    filled = F.concat(left, F.array_repeat(F.lit("0"), missing), right)

    def pad(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ":")

    plain = F.split(clean, ":")
    return F.when(clean.contains("::"), pad(filled)).when(F.size(plain) == 8, pad(plain)).otherwise(clean)


def compress_ipv6(full: Column) -> Column:
    """Shortest form of a full address: the first longest run of two or more zero groups becomes '::'."""
    short = F.transform(F.split(full, ":"), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    text = F.concat(F.lit(":"), F.array_join(short, ":"), F.lit(":"))
    result = F.array_join(short, ":")
    for run in range(2, 9):  # later, longer runs overwrite shorter ones
        zeros = ":" + "0:" * run
        at = F.instr(text, F.lit(zeros))
        head = F.substring(text, F.lit(2), F.greatest(at - 2, F.lit(0)))
        tail = F.substring(text, at + len(zeros), F.greatest(F.length(text) - at - len(zeros), F.lit(0)))
        result = F.when(at > 0, F.concat(head, F.lit("::"), tail)).otherwise(result)
    return result
