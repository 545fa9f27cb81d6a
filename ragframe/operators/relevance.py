"""Relevance of sources to a question, and answers' relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions.metrics import coverage
from ragframe.functions.text import norm_match, numbers


def bundle(label: Column, content: Column, metadata: Column) -> Column:
    """The matching form of a source: its label, content and metadata."""
    pairs = F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    return norm_match(F.concat_ws(" ", label, content, pairs))


def numeric_overlap(expected: Column, text: Column) -> Column:
    """Share of the expected numbers that occur in a text; 0 if none is expected."""
    n = F.size(expected)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_distinct(expected), numbers(text))) / F.size(F.array_distinct(expected)))


def source_relevance(reference: Column, question: Column, context: Column, answer: Column, numeric: Column, has_numbers: Column) -> Column:
    """Blend of similarities, 0 to 1; without expected numbers their weight goes to the others."""
    v = F.when(has_numbers, 0.30 * reference + 0.20 * question + 0.25 * context + 0.10 * answer + 0.15 * numeric).otherwise(0.40 * reference + 0.25 * question + 0.20 * context + 0.15 * answer)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def answer_relevance(question: Column, reference: Column, keywords: Column) -> Column:
    return 0.35 * question + 0.40 * reference + 0.25 * keywords


def context_relevance(scored: DataFrame, key: str, question: str, reference: str, keywords: str, best: int = 3) -> DataFrame:
    """key and the mean of its best sources' blends."""
    s = scored.withColumn("_s", 0.25 * F.col(question) + 0.40 * F.col(reference) + 0.35 * F.col(keywords))
    r = s.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s")))).filter(F.col("_r") <= best)
    return r.groupBy(key).agg(F.round(F.avg("_s"), 4).alias("context_relevance"))


def hint_hit(hints: Column, bundles: Column) -> Column:
    """1 if a hint occurs in a source; without hints 1 iff there is no source."""
    found = F.exists(hints, lambda h: F.exists(bundles, lambda b: F.contains(b, norm_match(h))))
    return F.when(F.size(hints) == 0, (F.size(bundles) == 0).cast("double")).otherwise(found.cast("double"))


def keyword_share(keywords: Column, bundles: Column) -> Column:
    """Share of keywords that occur in the sources; without keywords 1 iff there is no source."""
    return F.when(F.size(keywords) == 0, (F.size(bundles) == 0).cast("double")).otherwise(coverage(keywords, F.array_join(bundles, " ")))


def answer_quality(exact: Column, f1: Column, chars: Column, semantic: Column, keywords: Column, relevance: Column, refusal_expected: Column, refused: Column) -> Column:
    """Blend of answer measures: a wanted refusal is scored by whether it came, and an unwanted one keeps a quarter."""
    plain = 0.05 * exact + 0.10 * f1 + 0.10 * chars + 0.35 * semantic + 0.25 * keywords + 0.15 * relevance
    right = (refusal_expected == refused).cast("double")
    return F.when(refusal_expected, 0.6 * right + 0.4 * relevance).otherwise(plain * F.when(refused, 0.25).otherwise(1.0))
