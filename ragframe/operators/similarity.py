"""Similarity of texts by characters, and support of claims."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.metrics import claims
from ragframe.functions.text import norm_match, tokens


def char_ratio(pairs: DataFrame, reference: str, answer: str) -> DataFrame:
    """pairs with ratio: matching blocks of characters of the two matching forms. No built-in function has this measure."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=x or "", b=y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn("ratio", ratio(norm_match(F.col(reference)), norm_match(F.col(answer))))


def supported_share(pairs: DataFrame, answer: str, source: str, share: float = 0.55) -> DataFrame:
    """pairs with faithfulness: the share of claims whose distinct tokens mostly occur in the source; without claims 1 for a blank answer, else 0."""
    x = pairs.withColumn("_c", claims(F.col(answer))).withColumn("_s", F.array_distinct(tokens(F.col(source))))
    ok = F.size(F.filter("_c", lambda c: F.size(F.array_intersect(F.array_distinct(tokens(c)), F.col("_s"))) / F.size(F.array_distinct(tokens(c))) >= share))
    return x.withColumn("faithfulness", F.when(F.size("_c") == 0, F.when(F.trim(answer) == "", 1.0).otherwise(0.0)).otherwise(F.round(ok / F.size("_c"), 4))).drop("_c", "_s")
