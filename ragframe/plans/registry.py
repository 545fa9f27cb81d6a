"""The queries of the reference operators, by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from ragframe.plans import document_queries, evaluation_queries, fact_queries, more_queries, page_queries, retrieval_queries, structure_queries, text_queries  # noqa: F401

    return QUERIES, ORACLES


def sql_norm(x: str) -> str:
    """DuckDB's matching form of an expression."""
    plain = f"lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D')))"
    return rf"trim(regexp_replace(regexp_replace({plain}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '')"
