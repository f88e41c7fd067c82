"""Canary tokens: traceable marks in texts that leave, and the search for them elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.operators.ranks import ordered_rank


def canary_tokens(docs: DataFrame, prefix: str, secret: str) -> DataFrame:
    """One token per text: (doc_id, token); a pure function of key, session and text id."""
    raw = F.concat(F.lit(secret), F.col("session"), F.lit(":"), F.col("doc_id").cast("string"))
    return docs.select("session", "doc_id", F.concat(F.lit(prefix + "-"), F.substring(F.sha2(raw, 256), 1, 16)).alias("token"))


def inject_canary(docs: DataFrame, prefix: str, secret: str, col: str = "text") -> DataFrame:
    """Append the token of each text (docs with session) as a comment."""
    raw = F.concat(F.lit(secret), F.col("session"), F.lit(":"), F.col("doc_id").cast("string"))
    token = F.concat(F.lit(prefix + "-"), F.substring(F.sha2(raw, 256), 1, 16))
    return docs.withColumn("text_out", F.concat(F.col(col), F.lit("\n<!-- "), token, F.lit(" -->")))


def session_canaries(tokens: DataFrame) -> DataFrame:
    """Number the tokens of each session in text order; sessions may have any length."""
    return ordered_rank(tokens, ["session"], [F.col("doc_id")], "message_index")


def leaked_canaries(corpus: DataFrame, tokens: DataFrame, prefix: str) -> DataFrame:
    """Which tokens stand in other texts: tokens are cut out by their shape and joined by equality."""
    shape = f"\\Q{prefix}\\E-[a-f0-9]{{16}}"
    seen = corpus.filter(F.col("text").contains(prefix + "-")).select(
        F.col("doc_id").alias("found_in"), F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(shape), F.lit(0)))).alias("token"))
    return seen.filter("token is not null").join(tokens, "token")
