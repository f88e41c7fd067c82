"""Subnets: learned from text, given fake blocks, and used to map and restore addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilframe.functions.ip import int_to_ip, ip_to_int, network_of, valid_ipv4
from veilframe.operators.ranks import running_total
from veilframe.session import materialize

# The carrier-grade block that holds fakes, the reserved block for what does not fit (240 to 253), and
# its part for single addresses of subnets that fit nowhere. What begins with 255 looks like a mask.
POOL_BASE, POOL_SIZE = 100 * 2**24 + 64 * 2**16, 2**22
SPILL_BASE, SPILL_SIZE = 240 * 2**24, 14 * 2**24
SINGLE_BASE, SINGLE_SIZE = 254 * 2**24, 2**24
MIN_PREFIX, MAX_PREFIX, DEFAULT_PREFIX = 8, 30, 24
WINDOW_ROWS = 1_000_000  # subnets that one sort per tenant may hold; more are summed range by range

QUAD = r"(?<!\w)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
CIDR = QUAD + r"/(\d{1,2})(?!\w)"
ADDRESS_MASK = QUAD + r"\s+(?:mask\s+|netmask\s+)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w)"


def mask_length(mask: Column) -> Column:
    """Prefix length of a contiguous mask or wildcard mask, else null."""
    number = ip_to_int(mask)
    wildcard = mask.startswith("0.") & ~mask.startswith("0.0.0.0")
    hosts = F.when(wildcard, number).otherwise(F.lit(2**32 - 1) - number)
    contiguous = hosts.bitwiseAND(hosts + 1) == 0
    return F.when(contiguous & (hosts >= 0), F.lit(32) - F.bit_count(hosts))


def learn_subnets(docs: DataFrame) -> DataFrame:
    """Known subnets (tenant, real_net, prefix_len) from ``a.b.c.d/len`` and address-mask pairs."""
    def pairs(pattern: str, likely: str, kind: int) -> Column:
        found = F.zip_with(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)),
                           lambda ip, x: F.struct(ip.alias("ip"), x.alias("x"), F.lit(kind).alias("kind")))
        return F.when(F.col("text").rlike(likely), found).otherwise(F.array().cast("array<struct<ip:string,x:string,kind:int>>"))

    both = F.concat(pairs(CIDR, r"\d/\d", 0), pairs(ADDRESS_MASK, r"\d\s+(?:(?:net)?mask\s+)?(?:255|0)\.", 1))
    rows = docs.filter(F.col("text").rlike(r"\d\.\d")).select("tenant", F.inline_outer(both)).filter("ip is not null")
    length = F.when(F.col("kind") == 0, F.col("x").try_cast("int")).when(valid_ipv4(F.col("x")), mask_length(F.col("x")))
    return (
        rows.withColumn("prefix_len", length.cast("int"))
        .filter(valid_ipv4(F.col("ip")) & F.col("prefix_len").between(MIN_PREFIX, MAX_PREFIX))
        .select("tenant", network_of(ip_to_int(F.col("ip")), F.col("prefix_len")).alias("real_net"), "prefix_len").distinct()
    )


def prefix_lengths(known: DataFrame) -> list[int]:
    """Prefix lengths that occur: at most 23 numbers."""
    return sorted(r[0] for r in known.select("prefix_len").distinct().collect())


def prefix_len(addresses: DataFrame, known: DataFrame) -> DataFrame:
    """Longest known prefix of each (tenant, value), else /24; adds ip, prefix_len and real_net."""
    ips = addresses.withColumn("ip", ip_to_int(F.col("value")))
    lengths = prefix_lengths(known)
    if lengths:
        candidates = ips.select("tenant", "value", "ip", F.explode(F.array(*[F.lit(p) for p in lengths])).alias("prefix_len"))
        candidates = candidates.withColumn("real_net", network_of(F.col("ip"), F.col("prefix_len")))
        best = (candidates.join(known, ["tenant", "real_net", "prefix_len"], "left_semi")
                .groupBy("tenant", "value").agg(F.max("prefix_len").alias("prefix_len")))
        ips = ips.join(best, ["tenant", "value"], "left")
    else:
        ips = ips.withColumn("prefix_len", F.lit(None).cast("int"))
    ips = ips.withColumn("prefix_len", F.coalesce("prefix_len", F.lit(DEFAULT_PREFIX)))
    return ips.withColumn("real_net", network_of(F.col("ip"), F.col("prefix_len")))


def allocate_subnets(subnets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Give each (tenant, real_net, prefix_len) an aligned fake block that overlaps no other.

    Blocks are laid out largest first, so a running sum of sizes is aligned by construction.  Blocks that
    do not fit the carrier-grade space, and those larger than it, go to the reserved space.  What fits there
    neither has a null ``fake_net``: its addresses get single stand-ins, and stay so in later batches.  With
    ``existing`` allocations the new blocks start after the last used address.
    """
    fresh = materialize(subnets.select("tenant", "real_net", "prefix_len").distinct(), "nets")
    used_pool, used_spill = F.lit(0), F.lit(0)
    if existing is not None:
        fresh = fresh.join(existing, ["tenant", "real_net", "prefix_len"], "left_anti")
        end = F.col("fake_net") + F.pow(F.lit(2), F.lit(32) - F.col("prefix_len")).cast("bigint")
        ends = existing.groupBy("tenant").agg(
            F.max(F.when(F.col("fake_net") < SPILL_BASE, end - POOL_BASE)).alias("__pool"),
            F.max(F.when(F.col("fake_net") >= SPILL_BASE, end - SPILL_BASE)).alias("__spill"))
        fresh = fresh.join(ends, "tenant", "left")
        used_pool, used_spill = F.coalesce("__pool", F.lit(0)), F.coalesce("__spill", F.lit(0))
    size = F.pow(F.lit(2), F.lit(32) - F.col("prefix_len")).cast("bigint")
    fresh = fresh.withColumns({"size": size, "__large": F.col("prefix_len") < 10, "__pool0": used_pool, "__spill0": used_spill})
    many = fresh.count() > WINDOW_ROWS

    def offset(rows: DataFrame, used: str, key: str, out: str) -> DataFrame:
        order = [F.col("prefix_len"), F.col("real_net")]
        if many:
            rows = rows.join(rows.groupBy("tenant", key).agg(F.max("size").alias("__largest")), ["tenant", key])
            rows = running_total(rows, ["tenant", key], order, F.col("size"), out)
        else:
            w = W.partitionBy("tenant", key).orderBy(*order)
            rows = rows.withColumns({
                out: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                "__largest": F.first("size").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})  # largest first
        start = F.ceil(F.col(used) / F.col("__largest")).cast("bigint") * F.col("__largest")  # align past earlier allocations
        return rows.withColumn(out, F.col(out) + start).drop("__largest")

    fresh = offset(fresh, "__pool0", "__large", "__at")
    fresh = fresh.withColumn("__spilled", F.col("__large") | (F.col("__at") + F.col("size") > POOL_SIZE))
    fresh = offset(fresh, "__spill0", "__spilled", "__at2")
    too_far = F.col("__at2") + F.col("size") > SPILL_SIZE
    fake = F.when(~F.col("__spilled"), F.lit(POOL_BASE) + F.col("__at")).when(~too_far, F.lit(SPILL_BASE) + F.col("__at2"))
    new = fresh.select("tenant", "real_net", "prefix_len", fake.cast("bigint").alias("fake_net"))
    return new if existing is None else existing.select(*new.columns).unionByName(new)


FAKE_ADDRESS = (r"(?<!\w)((?:100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])|2(?:4\d|5[0-5])\.\d{1,3})"
                r"\.\d{1,3}\.\d{1,3})(?!\w)")
WIDE_PREFIX = r"(?!/(?:[89]|1[0-5])(?!\d))"  # an address before a wide prefix begins a description
FAKE_RANGE = (r"(?i)(?<!\d\.)(?<!\d)(?<!\w)100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.[\dx]+(?:-[\dx]+)?"
              r"(?:\.[\dx]+(?:-[\dx]+)?)?)?(?:/[\dx]+(?:-[\dx]+)?)?(?!\w)")
FAKE_V6 = (r"(?i)(?:^|(?<=[\s,;=(\[]))fd00(?::[0-9a-f]{1,4}){0,7}(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?(?=$|[\s,;)\]/])")


def residual_v4(found: DataFrame, subnets: DataFrame) -> DataFrame:
    """Real address of fake-range addresses by the longest fake subnet; rows without one are dropped.

    ``found`` has tenant and value besides its own columns, which are kept; adds ``repl``.
    """
    subnets = subnets.filter("fake_net is not null")
    lengths = prefix_lengths(subnets)
    if not lengths:
        return found.withColumn("repl", F.lit(None).cast("string")).filter(F.lit(False))
    addresses = found.select("tenant", "value").distinct().filter(valid_ipv4(F.col("value"))).withColumn("ip", ip_to_int(F.col("value")))
    candidates = addresses.withColumn("prefix_len", F.explode(F.array(*[F.lit(p) for p in lengths]))).withColumn(
        "fake_net", network_of(F.col("ip"), F.col("prefix_len")))
    hit = candidates.join(subnets, ["tenant", "fake_net", "prefix_len"]).groupBy("tenant", "value").agg(
        F.max_by(F.col("real_net") + F.col("ip") - F.col("fake_net"), "prefix_len").alias("real_ip"))
    return found.join(hit.select("tenant", "value", int_to_ip(F.col("real_ip")).alias("repl")), ["tenant", "value"])


def described(value: Column) -> Column:
    """Addresses that a description like ``100.64.3.x/24``, ``100.64.0-9`` or ``100.64.0.0/10`` covers, as (low, high).

    Missing octets and those with an ``x`` are open.  Null for whole addresses, alone or with a prefix of 16 or more:
    those are addresses or networks, not descriptions.  Null where a number cannot be part of an address.
    """
    octets = F.split(F.substring_index(value, "/", 1), "[.]")
    length = F.regexp_extract(value, r"/(\d+)$", 1).try_cast("int")

    def end(i: int, at: int, missing: int) -> Column:
        part = F.element_at(F.split(F.get(octets, F.lit(i)), "-"), at)
        return F.when(part.isNull() | F.lower(part).contains("x"), F.lit(missing)).otherwise(part.try_cast("int"))

    lows, highs = [end(i, 1, 0) for i in (1, 2, 3)], [end(i, -1, 255) for i in (1, 2, 3)]
    possible = F.coalesce(length, F.lit(16)).between(MIN_PREFIX, 32)
    for low, high in zip(lows, highs):
        possible = possible & (low <= high) & (high <= 255)
    whole = (F.size(octets) == 4) & ~F.lower(value).rlike("[x-]") & (F.coalesce(length, F.lit(32)) >= 16)
    low, high = (sum((e.cast("bigint") * 256 ** (2 - i) for i, e in enumerate(ends)), F.lit(100 * 2**24)) for ends in (lows, highs))
    size = F.coalesce(length, F.lit(32))
    return F.when(possible & ~whole, F.struct(network_of(low, size).alias("low"), (network_of(high, size) + F.pow(F.lit(2), F.lit(32) - size).cast("bigint") - 1).alias("high")))


def residual_ranges(found: DataFrame, subnets: DataFrame) -> DataFrame:
    """Descriptions of the fake range moved to the real /16 that owns most addresses of what they describe.

    Where no fake block meets the described addresses, the /16 that owns most of the tenant's blocks is taken; ties go
    to the lowest.  The first two octets are replaced and a prefix below 16 becomes 16; the rest stays as written.
    Whole addresses, impossible numbers and tenants without a block get no row.  Adds ``repl``.

    Blocks are cut at the borders of /16 and /24 bins, and descriptions meet the bins they cover by equality: at most 64
    sums of a /16 bin where they are wide, else at most 256 bins that hold at most 64 blocks each.
    """
    size = F.pow(F.lit(2), F.lit(32) - F.col("prefix_len")).cast("bigint")
    parts = subnets.filter(F.col("fake_net").between(POOL_BASE, POOL_BASE + POOL_SIZE - 1)).select(
        "tenant", "fake_net", "real_net", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(65536).cast("bigint"))).alias("at"))
    parts = parts.select(
        "tenant", (F.col("fake_net") + F.col("at")).alias("b_low"), (F.col("fake_net") + F.col("at") + F.least("size", F.lit(65536)) - 1).alias("b_high"),
        F.shiftright(F.col("real_net") + F.col("at"), 16).alias("net16"))
    sums = parts.groupBy("tenant", F.shiftright("b_low", 16).alias("bin"), "net16").agg(F.sum(F.col("b_high") - F.col("b_low") + 1).alias("weight"))
    fine = parts.select("tenant", "b_low", "b_high", "net16", F.explode(F.sequence(F.shiftright("b_low", 8), F.shiftright("b_high", 8))).alias("bin"))
    best = F.max_by("net16", F.struct("weight", -F.col("net16"))).alias("net16")
    usual = sums.groupBy("tenant", "net16").agg(F.sum("weight").alias("weight")).groupBy("tenant").agg(best).withColumnRenamed("net16", "usual")

    asked = found.select("tenant", "value").distinct().withColumn("span", described(F.col("value"))).filter("span is not null")
    asked = asked.select("tenant", "value", F.greatest("span.low", F.lit(POOL_BASE)).alias("low"), F.least("span.high", F.lit(POOL_BASE + POOL_SIZE - 1)).alias("high"))
    wide = F.col("high") - F.col("low") >= 65535
    coarse = asked.filter(wide).withColumn("bin", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16)))).join(sums, ["tenant", "bin"])
    near = asked.filter(~wide).withColumn("bin", F.explode(F.sequence(F.shiftright("low", 8), F.shiftright("high", 8)))).join(fine, ["tenant", "bin"])
    start = F.shiftleft("bin", 8)
    weight = F.least("high", "b_high", start + 255) - F.greatest("low", "b_low", start) + 1
    near = near.withColumn("weight", weight).filter("weight > 0")
    owner = (coarse.select("tenant", "value", "net16", "weight").unionByName(near.select("tenant", "value", "net16", "weight"))
             .groupBy("tenant", "value", "net16").agg(F.sum("weight").alias("weight")).groupBy("tenant", "value").agg(best))
    moved = asked.join(usual, "tenant").join(owner, ["tenant", "value"], "left").withColumn("net16", F.coalesce("net16", "usual"))
    length = F.regexp_extract("value", r"/(\d+)$", 1).try_cast("int")
    rest = F.regexp_replace("value", r"^100[.]\d+", "")
    rest = F.when(length < 16, F.regexp_replace(rest, r"/\d+$", "/16")).otherwise(rest)
    pair = F.concat_ws(".", F.shiftright("net16", 8).cast("string"), F.col("net16").bitwiseAND(F.lit(255)).cast("string"))
    return found.join(moved.select("tenant", "value", F.concat(pair, rest).alias("repl")), ["tenant", "value"])
