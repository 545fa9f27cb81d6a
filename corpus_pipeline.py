"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and but for the last returns the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.llm import toxicity as tox
from ragframe.llm.common import crc_mod, table
from ragframe.llm.neardup import near_duplicates
from ragframe.llm.packing import pack
from ragframe.llm.privacy import personal_data
from ragframe.llm.quality import quality
from ragframe.session import shared_folder, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text and its length."""
    t = F.col(text)
    return df.select("doc_id", t.alias("text"), "lang", "source", F.length(t).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and documents that the rules reject."""
    ship(spark)
    return _documents(quality(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic by a network that learned from labelled documents outside its held-out fold."""
    ship(spark)
    s = tox.Settings()
    sample = tox.training_sample(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2, "text", "toxic", "doc_id", s)
    scored = tox.toxicity(docs.select(*COLUMNS), tox.train(sample, s), "text", COLUMNS, TOXIC)
    return scored.filter("predicted = 0").select(*COLUMNS)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that of the smallest id, and one row of it where rows repeat the id; null ids stay."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    classes = near_duplicates(docs).filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(*COLUMNS[1:]))
    kept = docs.join(classes, "doc_id", "left_semi").select(*COLUMNS, one.alias("_n")).filter("_n = 1").select(*COLUMNS)
    return kept.unionByName(docs.filter("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; keeps every document."""
    ship(spark)
    return _documents(personal_data(docs.select(*COLUMNS)), "clean_text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    import public_tokenizers

    ship(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_documents),
    ("privacy", private_data),
    ("packing", packing),
]

#: SQL can't express the network, the sampling and the search; tests hold the stages' rules against plain Python.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
