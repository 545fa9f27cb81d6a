"""Comparisons of what is expected with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import normalize_title


def compare(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, missing (expected alone) and extra (there alone)."""
    both = expected.select(key).withColumn("e", F.lit(1)).unionByName(actual.select(key).withColumn("e", F.lit(0)))
    s = both.groupBy(key).agg(F.max("e").alias("hi"), F.min("e").alias("lo"))
    return s.select(key, (F.col("lo") == 1).alias("missing"), (F.col("hi") == 0).alias("extra"))


def manifest(chunks: DataFrame, path: str, text: str) -> DataFrame:
    """Chunks and characters of each path, and whether any chunk lacks its text."""
    n, filled = F.count(F.lit(1)), F.count(text)
    return chunks.groupBy(F.col(path).alias("relative_path")).agg(n.alias("chunk_count"), F.sum(F.length(text)).cast("long").alias("total_chars"), F.when(n == filled, "match").otherwise("drift").alias("status"))


def not_ingested(docs: DataFrame, there: DataFrame, title: str, force: bool = False) -> DataFrame:
    """Documents whose normalised title isn't there yet; with force all."""
    if force:
        return docs
    known = there.select(normalize_title(F.col(title)).alias("_t")).distinct()
    return docs.join(known, normalize_title(F.col(title)) == F.col("_t"), "left_anti")


def stale(files: DataFrame, expected: DataFrame, path: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Files that aren't expected, of the given top folders alone if any are named."""
    f = files.filter(F.split(F.col(path), "/")[0].isin(*prefixes)) if prefixes else files
    return f.join(expected.select(path).distinct(), path, "left_anti")
