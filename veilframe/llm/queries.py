"""Queries over the test tables: one per operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import chat, codes, langid, lines, minhash, mixing, packing, phrases, pivots, quality, threshold, toxicity, twins, urls
from veilframe.llm.common import remainder, table

THRESHOLD = 0.7
#: Stated rules of the URL filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Wanted shares of tokens by language.
MIX = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def labelled(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, label) of the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter((remainder("doc_id", modulus) != held) & F.col("label").isNotNull())
    return (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "text").join(labels, "doc_id")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = chat.turns_of_frame(chat.conversations(rows.unionByName(more)), ["messages"])
    done = chat.format_turns(turns).select("conv_id", "formatted", "loss_spans")
    read = done.withColumn("t", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad): pages whose path ends in the number of a labelled document; bad if that is of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("url").withColumn("doc_id", F.regexp_extract(urls.path_of(F.col("url")), r"(\d{1,18})(?:\.\w+)?/?$", 1).cast("long"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES, page_labels(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)))
    return langid.identify(docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(labelled(spark, sf_dir, "quality", 4, 2))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def mix_model(spark: SparkSession, sf_dir: str) -> mixing.Posteriors:
    return mixing.fit_posteriors(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, one posterior column per language, rate) of all documents."""
    model = mix_model(spark, sf_dir)
    out = mixing.mix_slim(table(spark, sf_dir, "documents").select("doc_id", "text"), model, MIX)
    return out.select("doc_id", "tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate")


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op8_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(labelled(spark, sf_dir, "toxic", 3, 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(book.digest() if book else "")
    return codes.with_group_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_verdicts(table(spark, sf_dir, "documents")).drop("removed")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_chat_format, op3_url_filter, op4_language_id, op5_quality_fm, op6_mixing, op7_permutation_index,
    op8_toxicity_ssk, op9_best_fit_packing, op10_threshold_topk, op11_orchard_codes, op12_line_frequency, op13_phrase_mining, pipeline)}
ORACLES: dict[str, str] = {"op11_orchard_codes": twins.codes_sql(), "op12_line_frequency": twins.LINES, "op13_phrase_mining": twins.PHRASES}
