"""Embeddings: a hashing embedder, and a slot for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import norm_match, tokens

Embedder = Callable[[list[str]], list[list[float]]]


def hashed(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bucket, weight: counts of tokens by hash, of length 1."""
    w = docs.select(key, F.explode(tokens(F.col(text))).alias("w"))
    b = w.groupBy(key, (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = b.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return b.join(n, key).select(key, "bucket", F.round(F.col("c") / F.col("n"), 6).alias("weight"))


def embed(docs: DataFrame, embedder: Embedder, text: str = "text", most: int = 3000, batch: int = 4) -> DataFrame:
    """docs with `embedding`, null where the embedder fails. Equal texts (in matching form) are embedded once.

    A failing batch is halved; a text that fails alone is tried once more and then given up.
    """

    def attempt(texts: list[str]) -> list[list[float] | None]:
        try:
            return list(embedder(texts))
        except Exception:
            if len(texts) > 1:
                return attempt(texts[: len(texts) // 2]) + attempt(texts[len(texts) // 2 :])
            try:
                return list(embedder(texts))
            except Exception:
                return [None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for i in range(0, len(pdf), batch):
                out += attempt(pdf["t"].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"k": pdf["k"], "embedding": out})

    k = norm_match(F.coalesce(F.col(text), F.lit("")))
    once = docs.groupBy(k.alias("k")).agg(F.min(F.substring(F.coalesce(F.col(text), F.lit("")), 1, most)).alias("t"))
    got = once.mapInPandas(run, "k string, embedding array<double>")
    return docs.withColumn("_k", k).join(got.withColumnRenamed("k", "_k"), "_k", "left").drop("_k")


def hashing_column(text: Column, buckets: int) -> Column:
    """The hashing embedding as an array of counts, for use within a row: each token is hashed once."""
    at = F.transform(tokens(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % buckets)
    counts = lambda h: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.size(F.filter(h, lambda x: x == i)).cast("double"))
    return F.get(F.transform(F.array(at), counts), F.lit(0))


def embed_or_drop(nodes: DataFrame, embedder: Embedder, text: str = "text", most: int = 3000, batch: int = 4) -> DataFrame:
    """nodes with `embedding`; those that can't be embedded are left out."""
    return embed(nodes, embedder, text, most, batch).filter(F.col("embedding").isNotNull())
