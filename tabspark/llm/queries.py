"""The queries opN_<name>: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import chat, decontaminate, fingerprint, language, lm, mixing, ngram_join, tokens, toxicity, warc
from tabspark.llm.oracle import ORACLE_SQL  # noqa: F401
from tabspark.llm.store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def quality():
    """A document's weight in the mix: near 1 where its words have a usual mean length, less the further from it."""
    chars = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    return F.when(F.col("size") > 0, 1.0 / (1.0 + F.abs(chars / F.col("size") - 6.0) / 6.0))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), quality(), (5, 2, 1), 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), docs.where(language.learnable(F.col("doc_id"))))
    return found.select("doc_id", lm.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op4_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_by_offset(warc.archive_pages(spark, _table(spark, sf_dir, "pages"), new_path(spark, "warc")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lessons = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~lm.held_out(F.col("doc_id"), 5))
    found = toxicity.score(docs, toxicity.fit(docs, lessons))
    return found.select("doc_id", lm.held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat.PLANTED, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(turns.unionByName(planted)))


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm.held_out(F.col("doc_id"), 10)
    found = lm.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_mix_sources,
        op3_language_id,
        op4_warc_normalise,
        op5_decontaminate,
        op6_toxicity,
        op7_token_counts,
        op8_chat_format,
        op9_backoff_automaton,
        op10_order_minhash,
    )
}
