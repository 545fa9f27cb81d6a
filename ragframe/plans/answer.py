"""The flagship plan: hybrid answers with their sources, behind the confidence gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators.embed import hashing_column
from ragframe.operators.retrieval import bm25, dense, gate, hybrid, sources
from ragframe.plans.registry import table


def answer_benchmark(spark: SparkSession, sf_dir: str, threshold: float = 0.25, buckets: int = 64) -> DataFrame:
    """query_id, refused, top_score and sources of every benchmark item: BM25 and hashing embeddings, fused by relative score."""
    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    vector = lambda df: df.withColumn("embedding", hashing_column(F.coalesce("text", F.lit("")), buckets))
    hits = hybrid(dense(vector(docs), vector(asked)), bm25(docs, asked))
    nodes = docs.select("doc_id", F.concat(F.lit("web/"), "source").alias("path"), F.lit(None).cast("int").alias("chunk_id"), F.col("text").alias("content"))
    return gate(asked, hits, threshold).join(sources(hits, nodes), "query_id", "left")
