"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm.common import crc_mod, table
from ragframe.llm.quality import quality_sql


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm import toxicity as t

    docs, s = table(spark, sf_dir, "documents").select("doc_id", "text"), t.Settings()
    model = t.train(t.training_sample(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2, "text", "toxic", "doc_id", s), s)
    found = t.toxicity(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.ngrams import language_model

    held_out = crc_mod(F.col("doc_id"), 10) == 0
    found = language_model(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.tokens import sentencepiece_codes

    return sentencepiece_codes(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.privacy import personal_data

    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm import language as g

    docs, s = table(spark, sf_dir, "documents"), g.Settings()
    model = g.train(g.training_sample(docs, crc_mod(F.col("doc_id"), 5) != 0, "text", "lang", "doc_id", s), s)
    found = g.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragframe.llm.warc import derivatives, responses

    found = derivatives(responses(table(spark, sf_dir, "pages")))
    # blocks of both kinds are text
    return found.withColumn("block", F.col("block").cast("string")).withColumnRenamed("block", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_language_model": op5_language_model,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_privacy": op8_privacy,
    "op9_language": op9_language,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op1_quality": quality_sql(),
}
