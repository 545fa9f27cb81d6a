"""Pages of printed documents to lines of the light mark-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import lines as L
from ragframe.functions.text import normalize_line
from ragframe.operators.html import rendered, tidied
from ragframe.operators.structure import finalized, without_noise

# What a list of contents is called, and the sections that end it.
CONTENTS = ("MỤC LỤC", "MUC LUC")
ROMAN_SECTION = r"(?i)^(I|II|III|IV|V|VI|VII|VIII|IX|X)[.)]?\s+\S+"


def page_lines(rows: DataFrame, doc: str) -> DataFrame:
    """doc, page, ln and line, in the mark-up, of the lines of pages (doc, page, ln, line).

    Noise goes; so does a list of contents up to the next section with a roman number, and all before the first heading with a roman
    or other number. Bullets keep one form. Headings with a prefix have its level; a line in capitals is one level below the heading
    before it, 4 at most: the last prefixed heading's level and the count of capitals since.
    """
    w = Window.partitionBy(doc).orderBy("page", "ln").rowsBetween(Window.unboundedPreceding, 0)
    x = without_noise(rows, doc, "page").withColumn("line", normalize_line(F.col("line"))).filter("line <> ''")
    line = F.col("line")
    upper, at = F.upper(line), F.struct("page", "ln")
    contents = F.contains(upper, F.lit(CONTENTS[0])) | F.contains(upper, F.lit(CONTENTS[1]))
    x = x.withColumn("_c", F.max(F.when(contents, at)).over(w)).withColumn("_r", F.max(F.when(line.rlike(ROMAN_SECTION) & ~contents, at)).over(w))
    x = x.filter(~contents & (F.col("_c").isNull() | F.coalesce(F.col("_r") > F.col("_c"), F.lit(False))))
    bullet, kind = line.rlike("^[-*•]"), L.heading_kind(line)
    x = x.withColumn("_k", F.when(~bullet, kind)).withColumn("_s", F.max(F.coalesce(F.col("_k").isin("roman", "numeric"), F.lit(False))).over(w)).filter("_s")
    capitals = ~bullet & F.col("_k").isNull() & (F.coalesce(L.heading_level(line), F.lit(0)) == 2)
    x = x.withColumn("_l", F.when(F.col("_k").isNotNull(), L.prefix_level(line))).withColumn("_h", F.count("_l").over(w)).withColumn("_p", F.last("_l", True).over(w))
    below = F.count(F.when(capitals, 1)).over(Window.partitionBy(doc, "_h").orderBy("page", "ln").rowsBetween(Window.unboundedPreceding, 0))
    level = F.coalesce("_l", F.when(capitals, F.least(F.col("_p") + below, F.lit(4)))).cast("int")
    text = F.when(F.col("_k").isNotNull(), F.coalesce(L.heading_body(line), line)).otherwise(line)
    x = x.withColumn("_l", level).withColumn("_t", text)
    out = F.when(bullet, F.concat(F.lit("- "), F.regexp_replace(line, "^[-*• ]+", ""))).when(F.col("_l").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("_l")), F.lit(" "), "_t")).otherwise(line)
    return x.select(doc, "page", "ln", out.alias("line"))


def with_tables(lines: DataFrame, tables: DataFrame, doc: str) -> DataFrame:
    """doc, ln (from 0) and line: page_lines() with each page's tables after its text, numbered through the document.

    tables: doc, page, table, row, cells. Tables of pages before the first line are left out, and an empty table has a number only.
    """
    first = lines.groupBy(doc).agg(F.min("page").alias("_first"))
    own = tables.join(first, doc).filter(F.col("page") >= F.col("_first"))
    numbered = own.withColumn("_n", F.dense_rank().over(Window.partitionBy(doc).orderBy("page", "table")))
    place = F.struct(doc, "page", "_n").alias("table_id")
    r = rendered(tidied(numbered.select(place, "row", "cells"))).select(F.col(f"table_id.{doc}").alias(doc), F.col("table_id.page").alias("page"), F.col("table_id._n").alias("_n"), F.col("row").cast("long").alias("ln"), "line")
    heads = r.select(doc, "page", "_n").distinct().select(doc, "page", "_n", F.lit(-1).cast("long").alias("ln"), F.concat(F.lit("### Bang "), F.col("_n").cast("string")).alias("line"))
    all_lines = lines.select(doc, "page", F.lit(0).alias("_n"), F.col("ln").cast("long").alias("ln"), "line").unionByName(heads).unionByName(r)
    w = Window.partitionBy(doc).orderBy("page", "_n", "ln")
    return all_lines.select(doc, (F.row_number().over(w) - 1).alias("ln"), "line")


def built(rows: DataFrame, tables: DataFrame, titles: DataFrame, doc: str) -> DataFrame:
    """doc, text and reason of every document of titles (doc, title): the finished text, or null and why there is none."""
    body = with_tables(page_lines(rows, doc), tables, doc)
    pages = rows.select(doc, "page").unionByName(tables.select(doc, "page")).groupBy(doc).agg(F.count_distinct("page").alias("_pages"))
    some = body.filter(F.trim("line") != "").select(doc).distinct()
    done = finalized(body, titles.join(some, doc, "left_semi"), doc)
    reason = F.when(F.col("text").isNotNull(), "ok").when(F.col("_pages").isNull(), "zero_pages").otherwise("no_text")
    return titles.select(doc).join(done, doc, "left").join(pages, doc, "left").select(doc, "text", reason.alias("reason"))
