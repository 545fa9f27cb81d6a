"""Answer and retrieval measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragframe.functions.text import norm_match, tokens

# Normalised phrases that mark a refusal.
REFUSALS = ("khong tim thay chac chan", "chua tim thay chac chan", "khong co thong tin", "chua co thong tin", "chua thay du thong tin", "khong tim thay trong tai lieu", "chua tim thay trong tai lieu")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 at least, and 0 for vectors that are empty, zero or of two lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), F.greatest(F.lit(0.0), dot / length)).otherwise(0.0)


def exact_match(reference: Column, answer: Column) -> Column:
    return (norm_match(reference) == norm_match(answer)).cast("double")


def coverage(keywords: Column, text: Column) -> Column:
    """Share of keywords whose matching form occurs in the text's; 1 without keywords."""
    found = F.size(F.filter(keywords, lambda k: F.contains(text, norm_match(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))


def is_refusal(answer: Column) -> Column:
    n = norm_match(answer)
    out = F.lit(False)
    for p in REFUSALS:
        out = out | F.contains(n, F.lit(p))
    return out


def claims(answer: Column) -> Column:
    """Statements of three tokens or more."""
    parts = F.transform(F.split(answer, r"[.!?\n;]+"), lambda x: F.btrim(x, F.lit(" -\t")))
    return F.filter(parts, lambda x: F.size(tokens(x)) >= 3)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def overall(recall3: Column, faithfulness: Column, relevance: Column, precision3: Column) -> Column:
    return 0.25 * recall3 + 0.35 * faithfulness + 0.25 * relevance + 0.15 * precision3


def retrieval_quality(context: Column, p3: Column, r3: Column, f3: Column, hit3: Column, mrr: Column, ap: Column, ndcg3: Column) -> Column:
    return 0.20 * context + 0.15 * p3 + 0.20 * r3 + 0.10 * f3 + 0.10 * hit3 + 0.10 * mrr + 0.05 * ap + 0.10 * ndcg3


def bar(v: Column, width: int = 24) -> Column:
    """A bar of # and dots; halves go to the even number."""
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))


def mean_of_scores(v: Column, places: int = 4) -> Column:
    """Mean of scores of few decimals, rounded. Summed exactly, so a mean half-way between two roundings has one result in any order of rows."""
    return F.round(F.avg(v.cast("decimal(28,14)")), places).cast("double")
