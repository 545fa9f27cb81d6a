"""Scoring of answers and ranked lists, and statistics over the scores."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions.metrics import f1
from ragframe.functions.text import tokens


def token_prf(pairs: DataFrame, key: str, reference: str, answer: str) -> DataFrame:
    """key, precision, recall and F1 of the overlap of two bags of tokens; 1 if both are empty, 0 if one is."""
    bag = lambda c, n: pairs.select(key, F.explode(tokens(F.col(c))).alias("tok")).groupBy(key, "tok").agg(F.count(F.lit(1)).alias(n))
    both = bag(reference, "a").join(bag(answer, "b"), [key, "tok"], "full").fillna(0, ["a", "b"])
    s = both.groupBy(key).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.least("a", "b")).alias("both"))
    s = pairs.select(key).join(s, key, "left").fillna(0, ["na", "nb", "both"])
    none = (F.col("na") == 0) & (F.col("nb") == 0)
    p = F.when(none, 1.0).when(F.col("nb") > 0, F.col("both") / F.col("nb")).otherwise(0.0)
    r = F.when(none, 1.0).when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0)
    return s.select(key, F.round(p, 4).alias("token_precision"), F.round(r, 4).alias("token_recall"), F.round(f1(p, r), 4).alias("token_f1"))


def ranking_scores(hits: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "query_id") -> DataFrame:
    """Measures of each ranked list of graded relevance: hits (key, rank, rel), totals (key, total: the relevant count).

    A list without hits has 0 everywhere, but 1 where total is 0 too (recall, average precision, nDCG).
    """
    by_rank = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    by_rel = Window.partitionBy(key).orderBy(F.desc("rel"), "rank")
    h = hits.withColumn("p", F.sum("rel").over(by_rank) / F.col("rank")).withColumn("ideal", F.row_number().over(by_rel))
    at = lambda c, k: F.sum(F.when(F.col(c) <= k, F.col("rel")).otherwise(0.0))
    gain = lambda c, k: F.sum(F.when(F.col(c) <= k, F.col("rel") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("rel").alias("all_rel"), F.max(F.col("rel") / F.col("rank")).alias("mrr"), F.sum(F.when(F.col("rel") > 0, F.col("p") * F.col("rel")).otherwise(0.0)).alias("ap")]
    for k in ks:
        aggs += [at("rank", k).alias(f"s{k}"), F.max(F.when((F.col("rank") <= k) & (F.col("rel") >= 0.55), 1.0).otherwise(0.0)).alias(f"h{k}"), gain("rank", k).alias(f"d{k}"), gain("ideal", k).alias(f"i{k}")]
    s = totals.join(h.groupBy(key).agg(*aggs), key, "left")
    none = F.col("n").isNull()
    total = F.col("total")
    out: list[Column] = [F.col(key)]
    for k in ks:
        p = F.coalesce(F.col(f"s{k}") / k, F.lit(0.0))
        r = F.when(total <= 0, F.when(none, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / total))
        n = F.when(none, 0.0).when(F.col(f"i{k}") > 0, F.col(f"d{k}") / F.col(f"i{k}")).otherwise(F.when(F.col("all_rel") == 0, 1.0).otherwise(0.0))
        out += [F.round(p, 4).alias(f"precision_at_{k}"), F.round(r, 4).alias(f"recall_at_{k}"), F.round(f1(p, r), 4).alias(f"f1_at_{k}"), F.coalesce(F.col(f"h{k}"), F.lit(0.0)).alias(f"hit_rate_at_{k}"), F.round(n, 4).alias(f"ndcg_at_{k}")]
    ap = F.when(total <= 0, F.when(F.coalesce("all_rel", F.lit(0.0)) == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("ap"), F.lit(0.0)) / total))
    return s.select(*out, F.round(F.coalesce("mrr", F.lit(0.0)), 4).alias("mrr"), F.round(ap, 4).alias("map"))


@functools.lru_cache(maxsize=8)
def digests(n: int, rounds: int, seed: str) -> np.ndarray:
    """(round, place) of numbers by a digest of seed, round and place: the same in every engine."""
    out = np.empty((rounds, n), np.uint32)
    for r in range(rounds):
        out[r] = [int.from_bytes(hashlib.md5(f"{seed}-{r}-{i}".encode()).digest()[:4], "big") for i in range(n)]
    return out


def _half_away(x: float, places: int = 4) -> float:
    """x rounded as SQL engines round a double: scaled, halves away from 0."""
    y = abs(x) * 10.0**places
    whole = np.floor(y)
    return float(np.copysign((whole + (y - whole >= 0.5)) / 10.0**places, x))


def bootstrap_ci(scores: DataFrame, group: str, value: str, order: str, rounds: int = 2000, seed: str = "42") -> DataFrame:
    """group, mean, low and high: the 95 % interval of the mean over resamples with replacement, and whether it excludes 0.

    A group has a score for each example of an evaluation set; its rounds are drawn in one task, as numbers and not as rows.
    Scores have few decimals, so a mean can lie half-way between two roundings: sums go one by one in the order drawn, as SQL adds them.
    """

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("o", kind="stable")["x"].to_numpy(float)
        drawn, sums = digests(len(x), rounds, seed), np.zeros(rounds)
        for i in range(len(x)):
            sums += x[drawn[:, i] % len(x)]
        means = np.sort(sums / len(x))
        at = lambda q: _half_away(means[max(1, int(q * rounds)) - 1])
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "mean": _half_away(np.cumsum(x)[-1] / len(x)), "low": at(0.025), "high": at(0.975)})

    kind = scores.schema[group].dataType.simpleString()
    rows = scores.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("x")).filter("x is not null")
    out = rows.groupBy("g").applyInPandas(interval, f"g {kind}, mean double, low double, high double")
    out = out.select(F.col("g").alias(group), "mean", "low", "high")
    return out.withColumn("label", confidence(F.col("low"), F.col("high")))


def confidence(low: Column, high: Column, p: Column | None = None) -> Column:
    """`stable` where the interval excludes 0; with a p value too, that must be below 0.05, else it is `uncertain`."""
    apart = (low > 0) | (high < 0)
    if p is None:
        return F.when(apart, "stable").otherwise("overlap_zero")
    return F.when(apart & (p < 0.05), "stable").when(~apart, "overlap_zero").otherwise("uncertain")


def permutation_p(diffs: DataFrame, group: str, value: str, order: str, rounds: int = 5000, seed: str = "42") -> DataFrame:
    """group and p: how often random signs give a mean difference as far from 0. Groups as in bootstrap_ci."""

    def extreme(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("o", kind="stable")["x"].to_numpy(float)
        sign = (digests(len(x), rounds, seed) % 2).astype(float) * 2 - 1
        far = int((np.abs(sign @ x) / len(x) >= abs(x.mean()) - 1e-12).sum())
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "p": (far + 1) / (rounds + 1)})

    kind = diffs.schema[group].dataType.simpleString()
    rows = diffs.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("x")).filter("x is not null")
    return rows.groupBy("g").applyInPandas(extreme, f"g {kind}, p double").select(F.col("g").alias(group), F.round("p", 4).alias("p"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed agreement and Cohen's kappa of two label columns."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    table = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = table.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = table.groupBy("a").agg(F.sum("c").alias("ca")), table.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = left.join(right, left["a"] == right["b"]).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).cast("double").alias("x"))
    both = n.join(F.broadcast(chance), F.lit(True))  # one row each
    o, e = F.col("same") / F.col("n"), F.col("x") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", F.round(F.when(F.col("n") == 0, 0.0).otherwise(o), 4).alias("agreement"), F.round(F.when(F.col("n") == 0, 0.0).when(e >= 1, 1.0).otherwise((o - e) / (1 - e)), 4).alias("kappa"))


def extremes(scores: DataFrame, topic: str, value: str, n: int = 3) -> DataFrame:
    """topic, score, best and worst: the n best and worst topics by mean. The windows see a row for each topic."""
    s = scores.groupBy(topic).agg(F.round(F.avg(value), 4).alias("score"))
    best = F.row_number().over(Window.orderBy(F.desc("score"), topic)).cast("long")
    worst = F.row_number().over(Window.orderBy("score", topic)).cast("long")
    return s.select(topic, "score", best.alias("best"), worst.alias("worst")).filter((F.col("best") <= n) | (F.col("worst") <= n))


def best(candidates: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The candidate of the highest value in each group, ties to the first name."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), name))
    return candidates.withColumn("_r", rank).filter("_r = 1").drop("_r")
