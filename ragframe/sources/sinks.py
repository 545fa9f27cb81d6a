"""Sinks: JSON lines, CSV, index tables, and the account of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_index(nodes: DataFrame, path: str, vector: str = "embedding") -> None:
    """Nodes with the length of their vectors, as Parquet."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    nodes.withColumn("norm", norm).write.mode("overwrite").parquet(path)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns)).alias("value"))


def csv_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of CSV as rows of strings."""
    return lines.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in columns)).alias("r")).select("r.*")


def accounted(results: DataFrame) -> DataFrame:
    """How many deliveries ended in each status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
