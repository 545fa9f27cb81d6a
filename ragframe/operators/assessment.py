"""Whole rows of an evaluation: every measure of a prediction, summaries of systems, alignment, and agreement of annotators.

A prediction has its retrieved sources as an array, which retrieval bounds; all that looks at sources stays within the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions import metrics as m
from ragframe.functions.text import norm_match, numbers, tokens
from ragframe.operators import relevance as rel
from ragframe.operators.evaluation import kappa, ranking_scores, token_prf
from ragframe.operators.similarity import char_ratio

Embed = Callable[[Column], Column]
SOURCES = "array<struct<label:string,content:string,metadata:map<string,string>>>"

#: The measures of a row, in order.
MEASURES = (
    "refusal_correct", "exact_match", "token_precision", "token_recall", "token_f1", "char_similarity", "semantic_similarity", "keyword_coverage",
    "answer_relevance", "context_relevance", "faithfulness", "hallucination_rate", "source_hint_hit", "source_keyword_coverage",
    "precision_at_1", "precision_at_3", "precision_at_5", "recall_at_1", "recall_at_3", "recall_at_5", "f1_at_1", "f1_at_3", "f1_at_5",
    "hit_rate_at_3", "mrr", "map", "ndcg_at_3", "ndcg_at_5", "answer_quality", "retrieval_quality", "recall_at_k", "context_precision", "overall_score",
)


def relevant_count(hints: Column, refusal_expected: Column) -> Column:
    """How many sources are relevant: one for each hint, else one unless a refusal is expected."""
    return F.when(F.size(hints) > 0, F.size(hints)).when(refusal_expected, 0).otherwise(1).cast("double")


def flattened_sources(sources: Column) -> Column:
    """Label, content and metadata (as JSON) of every source, a line each; empty ones are left out."""
    parts = F.flatten(F.transform(sources, lambda s: F.array(s["label"], s["content"], F.when(F.size(s["metadata"]) > 0, F.to_json(s["metadata"])))))
    return F.array_join(F.filter(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), "\n")


def source_text(s: Column) -> Column:
    """What a source is embedded by: its content, or its label where it has none."""
    return F.coalesce(F.nullif(F.trim(s["content"]), F.lit("")), s["label"], F.lit(""))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Cosine of two embeddings; 0 where either is missing."""
    return F.coalesce(m.cosine(a, b), F.lit(0.0))


def claim_support(claim: Column, texts: Column, vectors: Column, embed: Embed, least: float = 0.55) -> Column:
    """Whether one source supports a claim by meaning (0.6) and shared terms (0.4); of its numbers one must occur in some source."""
    own = F.array_distinct(tokens(claim))
    share = lambda t: F.size(F.array_intersect(own, tokens(t))) / F.greatest(F.size(own), F.lit(1))
    best = F.array_max(F.zip_with(texts, vectors, lambda t, v: 0.6 * semantic_similarity(embed(claim), v) + 0.4 * share(t)))
    n = numbers(claim)
    seen = (F.size(n) == 0) | F.exists(texts, lambda t: F.arrays_overlap(n, numbers(t)))
    return F.coalesce(best >= least, F.lit(False)) & F.coalesce(seen, F.lit(False))


def evaluated(predictions: DataFrame, embed: Embed, key: str = "example_id") -> DataFrame:
    """key, MEASURES (to four places), refusal_expected, refusal_predicted, latency_ms (to two), source_count and error of every prediction.

    predictions: key (unique), question, reference, answer, keywords, answer_keywords, hints (arrays), refusal_expected, sources
    (SOURCES), latency_ms, error. Where there is an error, every measure is 0 but the hallucination rate, which is 1. Null texts and
    arrays are empty ones.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    words = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    x = predictions.select(key, text("question"), text("reference"), text("answer"), words("keywords"), words("answer_keywords"), words("hints"), F.coalesce("refusal_expected", F.lit(False)).alias("refusal_expected"), F.coalesce(F.col("sources").cast(SOURCES), F.array().cast(SOURCES)).alias("sources"), "latency_ms", F.nullif(F.trim("error"), F.lit("")).alias("error"))
    x = x.withColumn("bundles", F.transform("sources", lambda s: rel.bundle(s["label"], s["content"], s["metadata"])))
    x = x.withColumn("texts", F.transform("sources", source_text)).withColumn("vectors", F.transform("texts", embed))
    for c, v in (("question", "q"), ("reference", "r"), ("answer", "a")):
        x = x.withColumn(v, embed(F.col(c)))
    x = x.withColumn("wanted", F.array_distinct(F.concat(numbers(F.col("reference")), F.flatten(F.transform("answer_keywords", numbers)))))
    kw = lambda c, b: F.when(F.size(c) == 0, 0.0).otherwise(m.coverage(F.col(c), b))
    graded = F.zip_with("bundles", "vectors", lambda b, v: rel.source_relevance(semantic_similarity(F.col("r"), v), semantic_similarity(F.col("q"), v), kw("keywords", b), kw("answer_keywords", b), rel.numeric_overlap(F.col("wanted"), b), F.size("wanted") > 0))
    context = F.zip_with("bundles", "vectors", lambda b, v: 0.25 * semantic_similarity(F.col("q"), v) + 0.40 * semantic_similarity(F.col("r"), v) + 0.35 * kw("keywords", b))
    x = x.withColumn("graded", graded).withColumn("best", F.slice(F.sort_array(context, False), 1, 3)).withColumn("claims", m.claims(F.col("answer")))
    supported = F.size(F.filter("claims", lambda c: claim_support(c, F.col("texts"), F.col("vectors"), embed)))
    none = F.when(F.trim("answer") == "", 1.0).otherwise(0.0)
    x = x.withColumn("faithfulness", F.when(F.size("claims") == 0, none).otherwise(supported / F.size("claims")))
    asked = F.when(F.size("answer_keywords") > 0, F.col("answer_keywords")).otherwise(F.col("keywords"))
    x = x.withColumn("keyword_coverage", m.coverage(asked, norm_match(F.col("answer")))).withColumn("semantic_similarity", semantic_similarity(F.col("r"), F.col("a")))
    x = x.withColumn("answer_relevance", rel.answer_relevance(semantic_similarity(F.col("q"), F.col("a")), F.col("semantic_similarity"), F.col("keyword_coverage")))
    x = x.withColumn("context_relevance", F.coalesce(F.aggregate("best", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("best"), F.lit(0)), F.lit(0.0)))
    x = x.withColumn("refusal_predicted", m.is_refusal(F.col("answer"))).withColumn("refusal_correct", (F.col("refusal_predicted") == F.col("refusal_expected")).cast("double"))
    x = x.withColumn("exact_match", m.exact_match(F.col("reference"), F.col("answer"))).withColumn("source_hint_hit", rel.hint_hit(F.col("hints"), F.col("bundles"))).withColumn("source_keyword_coverage", rel.keyword_share(F.col("keywords"), F.col("bundles")))
    hits = x.select(key, F.posexplode("graded").alias("p", "rel")).select(key, (F.col("p") + 1).cast("long").alias("rank"), "rel")
    ranked = ranking_scores(hits, x.select(key, relevant_count(F.col("hints"), F.col("refusal_expected")).alias("total")), key=key)
    bags = token_prf(x, key, "reference", "answer")
    chars = char_ratio(x.select(key, "reference", "answer"), "reference", "answer").select(key, F.col("ratio").alias("char_similarity"))
    y = x.join(ranked, key).join(bags, key).join(chars, key)
    c = F.col
    y = y.withColumn("answer_quality", rel.answer_quality(c("exact_match"), c("token_f1"), c("char_similarity"), c("semantic_similarity"), c("keyword_coverage"), c("answer_relevance"), c("refusal_expected"), c("refusal_predicted")))
    blend = m.retrieval_quality(c("context_relevance"), c("precision_at_3"), c("recall_at_3"), c("f1_at_3"), c("hit_rate_at_3"), c("mrr"), c("map"), c("ndcg_at_3"))
    y = y.withColumn("retrieval_quality", F.when(c("refusal_expected"), c("hit_rate_at_3")).otherwise(blend)).withColumn("hallucination_rate", 1 - c("faithfulness"))
    y = y.withColumn("recall_at_k", c("recall_at_3")).withColumn("context_precision", c("precision_at_3")).withColumn("overall_score", m.overall(c("recall_at_3"), c("faithfulness"), c("answer_relevance"), c("precision_at_3")))
    failed = c("error").isNotNull()
    shown = [F.when(failed, 1.0 if n == "hallucination_rate" else 0.0).otherwise(F.round(n, 4)).alias(n) for n in MEASURES]
    return y.select(key, "refusal_expected", (~failed & c("refusal_predicted")).alias("refusal_predicted"), *shown, F.round("latency_ms", 2).alias("latency_ms"), F.size("sources").alias("source_count"), "error")


def summarised(rows: DataFrame, by: tuple[str, ...], budget_ms: float = 0.0) -> DataFrame:
    """Means of all measures and of the latency to four places, rows, errors and the share of latencies over the budget (0: none set)."""
    over = F.when(F.lit(budget_ms > 0) & (F.col("latency_ms") > budget_ms), 1.0).otherwise(0.0)
    means = [F.round(F.avg(n), 4).alias(n) for n in (*MEASURES, "latency_ms")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means, F.count_if(F.col("error").isNotNull()).alias("error_count"), F.round(F.avg(over), 4).alias("latency_violation_rate"))


def aligned(examples: DataFrame, rows: DataFrame, key: str = "example_id", order: str = "position") -> DataFrame:
    """rows with the examples' order. A key that is missing, repeated or unknown raises, and the first five are named."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    faults = {
        "without an id": counted.filter(F.col(key).isNull()),
        "repeated": counted.filter(F.col("n") > 1),
        "missing": examples.join(counted, key, "left_anti"),
        "unknown": counted.filter(F.col(key).isNotNull()).join(examples, key, "left_anti"),
    }
    found = {k: [r[0] for r in df.select(key).orderBy(key).limit(5).collect()] for k, df in faults.items()}
    if any(found.values()):
        raise ValueError("; ".join(f"{k}: {', '.join(map(str, v))}" for k, v in found.items() if v))
    return rows.join(examples.select(key, order), key)


def resolved_split(rows: DataFrame, wanted: str = "auto", split: str = "split") -> str:
    """The split asked for; `auto` is the single one that rows name, else `all`."""
    if wanted != "auto":
        return wanted
    named = rows.select(F.trim(split).alias("s")).filter("s is not null and s <> ''").distinct().limit(2).collect()
    return named[0]["s"] if len(named) == 1 else "all"


def judged(a: DataFrame, b: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...] = ("example_id", "system")) -> DataFrame:
    """field, n, agreement and kappa of two annotators, over the rows that both have labelled."""
    out = None
    for f in fields:
        label = lambda df, n: df.select(*keys, F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(n))  # noqa: B023, E731
        one = kappa(label(a, "left").join(label(b, "right"), list(keys)), "left", "right").select(F.lit(f).alias("field"), "n", "agreement", "kappa")
        out = one if out is None else out.unionByName(one)
    return out
