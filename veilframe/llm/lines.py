"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (blanks collapsed, lower case) and hashed together with their host. A line found in more than
``limit`` distinct documents of one host is boilerplate there: it is removed, and a document that loses more than
half of its words is rejected.

Defined results: a null text has no words, so it fails the base rules; a null host is a host of its own; null and
repeated ids are rows like others (every row is a document); an empty table gives an empty result; columns of the
input never clash, since only ``key``, ``text`` and ``host`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.session import materialize

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A line in more documents of a host than this is removed there; a document keeps at least this share (percent) of its words.
LIMIT, KEEP = 30, 50
#: A line that makes up more than one part in so many of all lines is matched by broadcast: there are fewer than that.
HOT = 1000


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks."""
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * 5), " "), lambda w: w != "")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``rows``: the words of each line."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = docs.withColumn("raw_lines", lines).withColumn("rows", F.transform("raw_lines", words_of))
    df = df.withColumn("words", F.flatten("rows")).withColumn("n_words", F.size("words").cast("long"))
    starts = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    # windows of three words in order of their words: equal ones are neighbours
    part = lambda k: F.slice("words", F.lit(k), starts)
    windows = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.slice(F.sequence(F.lit(1), starts + 1), F.lit(1), starts).alias("at"))
    df = df.withColumn("windows", F.sort_array(windows))
    pairs = F.arrays_zip(F.col("windows").alias("p"), F.slice("windows", F.lit(2), F.greatest(F.size("windows"), F.lit(1))).alias("q"))
    same = F.filter(pairs, lambda x: (x["p"]["a"] == x["q"]["a"]) & (x["p"]["b"] == x["q"]["b"]) & (x["p"]["c"] == x["q"]["c"]))
    found = F.transform(same, lambda x: F.array(*[x[s]["at"] + k for s in ("p", "q") for k in range(3)]))
    return df.select(
        *docs.columns, "rows", "n_words", F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(found))).cast("long").alias("n_repeat_words"))


def line_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, keep: int = KEEP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, base statistics, base_failed, n_lines, removed_lines, removed_words, removed, kept) of every row.

    ``removed`` are the hashes of the removed lines, ``carry`` further columns to return. One scan of the texts; what is
    shuffled are hashes of lines, counted within each task first. Lines that are very frequent meet their mark by a
    broadcast of at most ``HOT`` hashes, the others by a join in which no hash has more than 1/``HOT`` of all rows.
    """
    mark = F.coalesce(F.concat(F.lit("h"), F.col("__host")), F.lit("n"))
    cols = [F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(host).cast("string").alias("__host"), *carry]
    base = with_base(docs.select(*cols), "__text")
    entry = lambda a: F.struct(F.md5(F.concat_ws("\n", mark, F.lower(F.array_join(a, " ")))).alias("h"), F.size(a).alias("n"))
    base = base.withColumn("lines", F.transform("rows", entry)).drop("rows", "__text", "__host").withColumn("__row", F.monotonically_increasing_id())
    base = materialize(base, "lines")  # row numbers are fixed once written
    counts = base.select(F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("h").count().filter(F.col("count") > limit)
    frequent = materialize(counts, "frequent")
    total = base.agg(F.sum(F.size("lines"))).first()[0] or 0
    hot, cold = (frequent.filter(c).select("h", F.lit(True).alias(n)) for c, n in (
        (F.col("count") > total / HOT, "__hot"), (F.col("count") <= total / HOT, "__cold")))
    lines = base.select("__row", F.inline("lines")).join(F.broadcast(hot), "h", "left")
    gone = lines.filter("__hot").select("__row", "h", "n").unionByName(lines.filter("__hot is null").join(cold, "h").select("__row", "h", "n"))
    gone = gone.groupBy("__row").agg(F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))
    out = base.join(gone, "__row", "left").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    words = F.coalesce("removed_words", F.lit(0))
    return out.select(
        F.col("__key").alias(key), *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.size("lines").cast("long").alias("n_lines"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), words.alias("removed_words"),
        F.coalesce("removed", F.array().cast("array<string>")).alias("removed"),
        (~F.col("base_failed") & (100 * (F.col("n_words") - words) >= keep * F.col("n_words"))).alias("kept"))


def strip_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, keep: int = KEEP) -> DataFrame:
    """(key, host, text_out, removed_lines, removed_words, kept): texts without the lines removed; a null text stays null."""
    held = docs.select(F.col(key), F.col(text), F.col(host), F.col(text).alias("carried_text"), F.col(host).cast("string").alias("carried_host"))
    done = line_verdicts(held, key, text, host, limit, keep, ("carried_text", "carried_host"))
    mark = F.coalesce(F.concat(F.lit("h"), F.col("carried_host")), F.lit("n"))
    hashed = lambda x: F.md5(F.concat_ws("\n", mark, F.lower(F.array_join(words_of(x), " "))))
    left = F.array_join(F.filter(F.split("carried_text", "\n"), lambda x: ~F.array_contains("removed", hashed(x))), "\n")
    return done.select(key, F.col("carried_host").alias(host), F.when(F.size("removed") == 0, F.col("carried_text")).otherwise(left).alias("text_out"), "removed_lines", "removed_words", "kept")
