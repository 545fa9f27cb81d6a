"""The life of an index: a table of nodes with vectors, kept as long as its fingerprint holds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators.retrieval import fingerprint
from ragframe.sources.sinks import to_index


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The nodes at a path, or None where there is no index."""
    try:
        return spark.read.parquet(f"{path}/nodes")
    except AnalysisException:
        return None


def files(nodes: DataFrame) -> DataFrame:
    """Distinct files that an index holds: the relative path, or the source file where that is empty."""
    return nodes.select(F.coalesce(F.nullif("relative_path", F.lit("")), "source_file").alias("file")).filter("file is not null").distinct()


def _state(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.schema("fingerprint string").json(f"{path}/state").first()
    except AnalysisException:
        return None
    return row["fingerprint"] if row else None


def ensure(spark: SparkSession, path: str, nodes: DataFrame, model: str, hybrid: bool = True, key: str = "doc_id", vector: str = "embedding") -> tuple[DataFrame, bool]:
    """The index of the nodes at a path, and whether it was built anew.

    It is kept where its state names the nodes' fingerprint and it holds rows; a missing or broken state has it built. The state is
    written after the nodes, so that an index cut short is built again.
    """
    now = fingerprint(nodes.select(key, "text"), model, hybrid).first()["fingerprint"]
    there = read(spark, path)
    if there is not None and _state(spark, path) == now and not there.isEmpty():
        return there, False
    to_index(nodes, f"{path}/nodes", vector)
    spark.createDataFrame([(now,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
    return read(spark, path), True
