"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru, jaccard, langid, packing, pii, quality, quotes, spm, substring, topk
from .common import held_out, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, ~held_out("doc_id", 3, 1)))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "accepted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.likelihoods(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows_removed(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_packing, op3_exact_topk, op4_pii, op5_gru_lm, op6_quote_linking, op7_sentencepiece, op8_jaccard_join, op9_substring_dedup, op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": topk.SQL}
