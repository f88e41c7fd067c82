"""URL filter: stated host/path rules first, then association rules mined from labelled URLs by FP-growth.

Everything is DataFrame work. A URL's tokens are its host labels and their hyphen parts (``h:``) and its path words
without numbers (``p:``). FP-growth runs over the labelled URLs' tokens plus the label; rules whose support and
confidence reach the bounds and that tell more than the base rate stay. Tokens that always occur together are mined
as one. To match, each rule is posted under its rarest token; a URL meets only the rules posted under its own tokens and keeps those it contains whole. Distinct
token sets are matched once, so the URLs of one site cost one match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.session import materialize

BAD = "label:block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.split(rest, "[/?#]", 2)[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    after = F.substr(rest, F.length(F.split(rest, "[/?#]", 2)[0]) + 1)
    return F.when(F.instr(url, "://") > 0, F.split(after, "[?#]", 2)[0]).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    labels = F.split(host, r"[.]")
    words = F.flatten(F.transform(labels, lambda x: F.when(F.instr(x, "-") > 0, F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))
    return F.array_sort(F.array_distinct(F.concat(
        F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)))))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule; rules are (host, path, verdict). Null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def interchangeable(items: DataFrame, column: str = "items", number: str = "row") -> DataFrame:
    """(token, root, members): tokens that stand in the same rows form a class; its root is the smallest of them.

    Rows are compared by their number and two 64-bit hashes of all row numbers. The label is in no class.
    """
    row = F.col(number)
    sums = (F.count(F.lit(1)), F.bit_xor(F.xxhash64(row)), F.bit_xor(F.xxhash64(row, F.lit(1))))
    each = items.select(number, F.explode(column).alias("token")).filter(F.col("token") != BAD).groupBy("token").agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)])
    classes = each.groupBy("s0", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return classes.select(F.explode("members").alias("token"), F.col("members")[0].alias("root"), "members")


def mine_rules(labelled: DataFrame, tokens: str = "tokens", bad: str = "bad", min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.2) -> DataFrame:
    """Rules (antecedent array, confidence, support, lift, classes) that foretell a bad URL. No labelled row: no rule.

    Tokens that always occur together are mined as one, so a long template of URLs makes one item and not all subsets
    of its words. ``antecedent`` holds the roots, ``classes`` for each root the tokens that may stand for it: any
    choice of one per class has the same support and confidence. Rows without tokens, with a null label, or none of
    whose tokens is frequent take no part in a rule.
    """
    from pyspark.ml.fpm import FPGrowth

    items = labelled.filter(F.col(bad).isNotNull()).select(F.array_distinct(F.concat(F.col(tokens), F.when(F.col(bad), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))).alias("items"))
    items = materialize(items.filter(F.size("items") > 0).withColumn("row", F.monotonically_increasing_id()), "labelled_urls")
    empty = items.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double, classes array<array<string>>")
    if items.isEmpty():
        return empty
    classes = materialize(interchangeable(items), "token_classes")
    root = items.select("row", F.explode("items").alias("token")).join(classes, "token", "left").select("row", F.coalesce("root", "token").alias("item"))
    merged = root.groupBy("row").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(merged)
    found = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    found = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift"), "url_rules")
    members = classes.filter("token = root").select("root", "members")
    wide = found.select("antecedent", F.explode("antecedent").alias("root")).join(members, "root").groupBy("antecedent").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("root", "members"))), lambda x: x["members"]).alias("classes"))
    return materialize(found.join(wide, "antecedent"), "url_rules_wide")


def match_rules(sets: DataFrame, rules: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(tokens, confidence, antecedent) of distinct token sets that hold a rule whole: the most confident rule.

    A rule is posted under every token of its rarest class; ``antecedent`` names the last token of each class in the set.
    """
    counts = rules.select(F.explode("antecedent").alias("root")).groupBy("root").count()
    each = rules.select("antecedent", "confidence", "classes", F.inline(F.arrays_zip(F.col("antecedent").alias("root"), F.col("classes").alias("members")))).join(counts, "root")
    index = each.groupBy("antecedent").agg(F.first("confidence").alias("confidence"), F.first("classes").alias("classes"), F.min_by("members", F.struct("count", "root")).alias("members"))
    index = index.select("confidence", "classes", F.explode("members").alias("token"))
    met = sets.select(tokens, F.explode(tokens).alias("token")).join(index, "token")
    hits = met.filter(F.forall("classes", lambda c: F.arrays_overlap(c, F.col(tokens))))
    named = F.array_sort(F.transform("classes", lambda c: F.array_max(F.array_intersect(c, F.col(tokens)))))
    best = F.max(F.struct(F.col("confidence"), -F.size("classes"), named.alias("named"))).alias("m")
    return hits.groupBy(tokens).agg(best).select(tokens, "m.confidence", F.col("m.named").alias("antecedent"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url", **mining) -> DataFrame:
    """All rows of ``pages`` plus host, path, rule, verdict, confidence and antecedent (of the mined rule, if one fits).

    ``labelled`` has (url, bad boolean). A null URL or one without ``://`` has empty host and path, no rule and is
    allowed; repeated rows are judged alike. Columns of these names in ``pages`` are replaced.
    """
    made = ["host", "path", "rule", "verdict", "confidence", "antecedent"]
    kept = [c for c in pages.columns if c not in made]
    text = F.col(f"`{url}`").cast("string")
    base = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(host_of(text), F.lit("")).alias("host"), F.coalesce(path_of(text), F.lit("")).alias("path"))
    base = base.withColumn("__rule", stated_rule(F.col("host"), F.col("path"), rules)).withColumn("__tokens", tokens_of(F.col("host"), F.col("path")))
    if labelled is None:
        judged = base.withColumn("confidence", F.lit(None).cast("double")).withColumn("antecedent", F.lit(None).cast("array<string>"))
    else:
        u = F.col("url").cast("string")
        train = labelled.select(tokens_of(F.coalesce(host_of(u), F.lit("")), F.coalesce(path_of(u), F.lit(""))).alias("tokens"), F.col("bad"))
        mined = mine_rules(train, **mining)
        sets = base.filter("__rule is null").select(F.col("__tokens").alias("tokens")).distinct()
        hits = materialize(match_rules(sets, mined).withColumnRenamed("tokens", "__tokens"), "url_hits")
        judged = base.join(hits, "__tokens", "left")
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__rule.rule").alias("rule"),
                         F.coalesce("__rule.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence", "antecedent")
