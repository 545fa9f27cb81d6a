"""Chunk records as JSON lines, and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import infer_year, title_from_stem

CHUNK = "chunk_id INT, relative_path STRING, title STRING, source_url STRING, heading_path ARRAY<STRING>, text STRING, record_type STRING"


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """path and text of every .txt file below a folder, each file a row."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scoped(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Files below a folder named by a year or `web`."""
    rel = F.regexp_replace(F.substring_index(F.col(path), root.rstrip("/") + "/", -1), "^/+", "")
    return files.filter(rel.rlike(r"^(20\d{2}|(?i:web))/"))


def jsonl_files(spark: SparkSession, root: str, tolerant: bool = False) -> DataFrame:
    """Chunk rows of every .jsonl file below a folder; broken lines raise, or are left out if tolerant."""
    return spark.read.schema(CHUNK).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(root)


def write_jsonl(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON; to_path() writes such lines."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def parse_chunks(lines: DataFrame) -> DataFrame:
    """Lines of JSON as chunk records: blank texts go, and a chunk without a number is the first of its file."""
    r = lines.select(F.from_json("value", CHUNK, {"mode": "FAILFAST"}).alias("r")).select("r.*").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    number = F.when(F.coalesce("chunk_id", F.lit(0)) == 0, 1).otherwise(F.col("chunk_id"))
    stem = F.regexp_extract("relative_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    title = F.coalesce(F.nullif("title", F.lit("")), F.get("heading_path", F.lit(0)), title_from_stem(stem))
    return r.select(
        F.concat("relative_path", F.lit("::chunk-"), number.cast("string")).alias("doc_id"), number.alias("chunk_id"), "relative_path", title.alias("title"), "source_url", "heading_path", "text",
        F.coalesce("record_type", F.lit("section")).alias("record_type"), infer_year(F.col("relative_path")).alias("source_year"), F.length("text").cast("long").alias("char_count"),
        F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("line_count"),
    )


def tolerant_chunks(lines: DataFrame) -> DataFrame:
    """title, text and category of chunks to deliver: broken lines and blank texts are left out."""
    from ragframe.functions.text import slug_underscore

    r = lines.select(F.from_json("value", CHUNK + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    r = r.filter(F.col("_bad").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    top = F.split("relative_path", "/")[0]
    label = F.when(top.rlike(r"^20\d{2}$"), "pdf").otherwise("web")
    title = F.format_string("%s__chunk__%s__%04d", label, slug_underscore(F.col("title")), F.col("chunk_id"))
    return r.select(title.alias("title"), "text", label.alias("category"))
