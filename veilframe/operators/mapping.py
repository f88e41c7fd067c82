"""Mapping tables: mint stand-ins for distinct values, keep them unique, merge, evict and reverse them.

``mapping`` has (tenant, real, fake, category, seed, first_seen).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.keyed import Keys
from veilframe.operators.fakes import GENERATORS, fake_sql, seed_sql
from veilframe.operators.ranks import ordered_rank
from veilframe.operators.subnets import allocate_subnets, prefix_len
from veilframe.session import materialize

MAPPING_COLUMNS = ["tenant", "real", "fake", "category", "seed", "first_seen"]
REMINT_ROUNDS = 3  # tries with a fresh seed before the stand-in is lengthened


def distinct_values(entities: DataFrame) -> DataFrame:
    """Distinct (tenant, value) with the category of the first occurrence (lowest doc_id, start)."""
    first = F.min(F.struct("doc_id", "start", "category"))
    return entities.groupBy("tenant", "value").agg(first.alias("f")).select(
        "tenant", "value", F.col("f.category").alias("category"), F.col("f.doc_id").cast("bigint").alias("first_seen"))


def with_seed(values: DataFrame, keys: Keys, salt_sql: str = "''") -> DataFrame:
    """Seed and hash material of each value; ``salt_sql`` is appended to the value for later tries."""
    return (
        values.withColumn("seed", F.expr(seed_sql(keys, f"concat(value, {salt_sql})")))
        .withColumn("h", F.expr("sha2(concat(category, ':', cast(seed as string)), 256)"))
        .withColumn("d", F.expr("translate(h, 'abcdef', '012345')"))
    )


def is_v4(column: str = "value") -> Column:
    return F.col(column).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def mint(values: DataFrame, keys: Keys, known_subnets: DataFrame | None = None, existing_subnets: DataFrame | None = None,
         categories: list[str] | None = None, custom: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Stand-ins for distinct (tenant, value, category) rows, and the subnet allocation behind the addresses.

    Everything but IPv4 is a projection; addresses join their allocated block.  The longest prefix wins, of those
    learned now and those of ``existing_subnets``: a later batch puts neighbours into the block of an earlier one.
    """
    addressed, subnets = categories is None or "ip_address" in categories, None
    if addressed:
        spark = values.sparkSession
        v4 = values.filter((F.col("category") == "ip_address") & is_v4()).select("tenant", "value")
        if known_subnets is None:
            known_subnets = spark.createDataFrame([], "tenant string, real_net bigint, prefix_len int")
        if existing_subnets is not None:
            known_subnets = known_subnets.select("tenant", "real_net", "prefix_len").union(existing_subnets.select("tenant", "real_net", "prefix_len"))
        placed = prefix_len(v4, known_subnets)
        subnets = materialize(allocate_subnets(placed, existing_subnets), "subnets")
        blocks = placed.join(subnets, ["tenant", "real_net", "prefix_len"]).drop("prefix_len")
        values = values.join(blocks, ["tenant", "value"], "left")
    else:
        values = values.withColumns({c: F.lit(None).cast("bigint") for c in ("ip", "real_net", "fake_net")})
    if "first_seen" not in values.columns:
        values = values.withColumn("first_seen", F.lit(0).cast("bigint"))
    return _fakes(with_seed(values, keys), lambda names: fake_sql(keys, names, custom), categories, custom), subnets


CASE_WIDTH = 4  # categories per generated projection; wider ones exceed what the JVM compiles into one method


def _fakes(seeded: DataFrame, expression: Callable[[list[str]], str], categories: list[str] | None, custom: dict[str, str] | None) -> DataFrame:
    """Apply the stand-in expressions in groups of categories: each group filters its own values."""
    known = list(dict.fromkeys([*GENERATORS, *(custom or {})]))
    wanted = [c for c in known if categories is None or c in categories]
    groups = [wanted[i:i + CASE_WIDTH] for i in range(0, len(wanted), CASE_WIDTH)]
    rest = seeded.filter(~F.col("category").isin(*known)) if categories is None or set(categories) - set(known) else None
    parts = [(seeded.filter(F.col("category").isin(*g)), g) for g in groups] + ([(rest, [])] if rest is not None else [])
    out = None
    for part, names in parts or [(seeded, [])]:
        one = part.select("tenant", F.col("value").alias("real"), F.expr(expression(names)).alias("fake"), "category", "seed", "first_seen")
        out = one if out is None else out.unionByName(one)
    return out


def fix_collisions(minted: DataFrame, keys: Keys, store: DataFrame | None = None, custom: dict[str, str] | None = None,
                   misread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Make stand-ins unique per tenant and different from their own value.

    Of the values that meet in one stand-in the smallest (seed, real) keeps it.  The others try again:
    addresses move their last octet on, everything else is minted from a fresh seed.  After a few rounds
    what is still taken (small pools run out) gets a keyed suffix of growing length, so every value ends
    with its own stand-in, however many there are.  The winner per stand-in is a partial aggregate, so a
    stand-in that a third of all values share costs no more than the others.

    ``misread`` returns those of the given (tenant, fake) rows that the texts hold themselves; they count as taken.
    """
    settled = [store.select("tenant", "real", "fake")] if store is not None else []
    done: list[DataFrame] = []
    todo = materialize(minted, "minted")
    for attempt in range(1, REMINT_ROUNDS + 6):
        best = todo.filter("fake <> real").groupBy("tenant", "fake").agg(F.min(F.struct("seed", "real")).alias("best"))
        judged = todo.join(best, ["tenant", "fake"], "left").withColumn(
            "free", F.coalesce(F.col("best.real") == F.col("real"), F.lit(False))).drop("best")
        for frame in settled:
            taken = frame.select("tenant", "fake", F.lit(True).alias("taken"))
            judged = judged.join(taken, ["tenant", "fake"], "left").withColumn(
                "free", F.col("free") & F.col("taken").isNull()).drop("taken")
        judged = materialize(judged, "judged")
        if misread is not None:
            held = misread(judged.filter("free").select("tenant", "fake")).withColumn("held", F.lit(True))
            judged = materialize(judged.join(held, ["tenant", "fake"], "left").withColumn("free", F.col("free") & F.col("held").isNull()).drop("held"), "judged")
        won = judged.filter("free").drop("free")
        done.append(won)
        settled.append(won.select("tenant", "real", "fake"))
        lost = judged.filter("not free").drop("free")
        if not lost.take(1):
            break
        todo = materialize(_try_again(lost, keys, attempt, custom), "minted")  # keeps the wide expressions out of the joins
    else:
        raise RuntimeError("stand-ins still collide after the longest suffix")
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out.select(*MAPPING_COLUMNS)


def _try_again(lost: DataFrame, keys: Keys, attempt: int, custom: dict[str, str] | None) -> DataFrame:
    v4 = "old rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' and category = 'ip_address'"
    bumped = "concat(substring_index(old, '.', 3), '.', cast((cast(substring_index(old, '.', -1) as int) + 1) % 256 as string))"
    seeded = with_seed(lost.withColumnRenamed("real", "value").withColumnRenamed("fake", "old"), keys, f"concat(char(0), '{attempt}')")
    seeded = seeded.withColumns({c: F.lit(None).cast("bigint") for c in ("ip", "real_net", "fake_net")})
    if attempt <= REMINT_ROUNDS:
        return _fakes(seeded, lambda names: f"case when {v4} then {bumped} else {fake_sql(keys, names, custom)} end",
                      [r[0] for r in lost.select("category").distinct().collect()], custom)  # a closed list
    n = 12 * 2 ** (attempt - REMINT_ROUNDS - 1)
    longer = f"case when old rlike '^[0-9]+$' then concat(old, substring(d, 1, {n})) else concat(old, '-', substring(h, 1, {n})) end"
    return seeded.select("tenant", F.col("value").alias("real"), F.expr(longer).alias("fake"), "category", "seed", "first_seen")


def upsert_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """Values already stored keep their stand-in; the rest is appended."""
    return new.join(store.select("tenant", "real"), ["tenant", "real"], "left_anti").select(*MAPPING_COLUMNS).unionByName(
        store.select(*MAPPING_COLUMNS))


def evict(store: DataFrame, max_mappings: int) -> DataFrame:
    """Keep the newest ``max_mappings`` rows of each tenant (first in, first out); 0 keeps all."""
    if max_mappings <= 0:
        return store
    ranked = ordered_rank(store, ["tenant"], [F.col("first_seen").desc(), F.col("real")])
    return ranked.filter(F.col("rank") <= max_mappings).drop("rank")


def reverse_map(store: DataFrame) -> DataFrame:
    """Stand-in to real value; the newest mapping wins where two share one."""
    newest = F.max_by(F.struct("real", "category"), F.struct("first_seen", "real"))
    return store.groupBy("tenant", "fake").agg(newest.alias("m")).select("tenant", "fake", "m.real", "m.category")


def consistency_check(one: DataFrame, two: DataFrame) -> DataFrame:
    """How many values of two mint runs agree and differ."""
    same = F.col("a.fake") == F.col("b.fake")
    return one.alias("a").join(two.alias("b"), F.col("a.real") == F.col("b.real")).agg(
        F.count_if(same).alias("same"), F.count_if(~same).alias("different"))
