"""Chunk records of JSON-lines files, with the numbers of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.functions import lines as L
from ragframe.functions.text import infer_year, title_from_stem

RAW = "chunk_id INT, source_txt STRING, title STRING, source_url STRING, heading_path STRING, text STRING, record_type STRING, table_heading STRING, char_count LONG, line_count LONG"


def numbered_lines(spark: SparkSession, root: str, scope: str | None = None, most: int | None = None, glob: str = "*.jsonl") -> DataFrame:
    """path, line_no (from 1) and value of every line of the files below a folder.

    Files are read in blocks: a block's lines are numbered from the counts of the blocks before it, so no line is shuffled. With a
    scope that is a folder of the root only that is read; with `most` only the first files by path.
    """
    j = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{scope}") if scope else None
    at = f"{root}/{scope}" if j is not None and j.getFileSystem(spark._jsc.hadoopConfiguration()).exists(j) else root
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(at)
    x = x.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = x.groupBy("path", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    if most is not None:
        blocks = blocks.join(blocks.select("path").distinct().orderBy("path").limit(most), "path", "left_semi")
    return x.join(blocks, ["path", "_at"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line_no"), "value")


def holds_table(text: Column) -> Column:
    """Two rows of a table or more, a header and another among them."""
    rows = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), L.is_table_row)
    headers = F.filter(rows, lambda x: L.is_header(L.cells(x)))
    return (F.size(headers) >= 1) & (F.size(rows) > F.size(headers))


def records(lines: DataFrame, root: str) -> DataFrame:
    """The 15 fields of each chunk of lines (path, line_no, value) below a folder.

    Blank lines and chunks of blank text go; broken JSON raises. A chunk without a number has its line's; one heading may stand for a
    path; titles, kinds and counts that are missing are inferred.
    """
    raw = lines.filter(F.trim("value") != "").select("path", "line_no", F.from_json("value", RAW, {"mode": "FAILFAST"}).alias("r")).select("path", "line_no", "r.*")
    r = raw.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).filter(F.coalesce("text", F.lit("")) != "")
    rel = F.regexp_replace(F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", ""), r"\.[^./]*$", ".txt")
    headings = F.col("heading_path")
    path = F.when(F.coalesce(headings, F.lit("")) == "", F.array().cast("array<string>")).when(headings.startswith("["), F.coalesce(F.from_json(headings, "array<string>"), F.array(headings))).otherwise(F.array(headings))
    r = r.withColumn("relative_path", rel).withColumn("heading_path", path).withColumn("_table", holds_table(F.col("text")))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    last = F.try_element_at("heading_path", F.lit(-1))
    number = F.coalesce(F.nullif(F.col("chunk_id"), F.lit(0)), F.col("line_no"))
    file = F.substring_index("relative_path", "/", -1)
    kind = F.when(F.col("_table") | F.lower(F.coalesce(last, F.lit(""))).startswith("bang "), "table_row").otherwise("section")
    return r.select(
        number.alias("chunk_id"), F.concat("relative_path", F.lit("::chunk-"), number.cast("string")).alias("doc_id"), F.coalesce(given("source_txt"), "path").alias("source_path"), "relative_path", file.alias("source_file"),
        F.substring_index("relative_path", "/", 1).alias("source_group"), infer_year(F.col("relative_path")).alias("source_year"),
        F.coalesce(given("title"), F.get("heading_path", F.lit(0)), title_from_stem(F.regexp_replace(file, r"\.txt$", ""))).alias("title"), F.coalesce("source_url", F.lit("")).alias("source_url"), "heading_path", "text",
        F.coalesce(given("record_type"), kind).alias("record_type"), F.coalesce(given("table_heading"), F.when(F.col("_table"), last), F.lit("")).alias("table_heading"),
        F.coalesce(F.nullif(F.col("char_count"), F.lit(0)), F.length("text").cast("long")).alias("char_count"),
        F.coalesce(F.nullif(F.col("line_count"), F.lit(0)), F.size(F.filter(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x) != "")).cast("long")).alias("line_count"),
    )


def by_file(chunks: DataFrame) -> DataFrame:
    """relative_path, n_chunks and chunk ids in order; a file without a valid chunk has no row."""
    return chunks.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
