"""Questions and answers: turns of conversations, and answers by extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions.text import tokens


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question and answer: each user turn with the turn after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.withColumn("answer", after).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def session_titles(conversations: DataFrame, most: int = 48) -> DataFrame:
    """conv_id and title: the first user message, shortened."""
    first = conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    t = F.trim(F.regexp_replace("t", r"\s+", " "))
    return first.select("conv_id", F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t).alias("title"))


def extract(pairs: DataFrame) -> DataFrame:
    """conv_id, turn and the sentence of the answer that shares most tokens with the question; the first of several."""
    asked = F.array_distinct(tokens(F.col("question")))
    parts = F.transform(F.regexp_extract_all("answer", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(s)), F.col("_q")))).alias("n"), i.alias("i"), F.trim(s).alias("s")))
    return pairs.withColumn("_q", asked).select("conv_id", "turn", F.array_min(parts)["s"].alias("answer")).filter("answer is not null")
