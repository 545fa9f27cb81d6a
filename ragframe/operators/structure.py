"""Documents as lines, headings and sections. Each operator keeps an explicit order column, ln."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import lines as L


def lines(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, ln (from 0) and line of every text."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("ln", "line"))


def without_noise(rows: DataFrame, doc: str, page: str, share: float = 0.6, least: int = 3, longest: int = 80) -> DataFrame:
    """Lines of a document of several pages without noise, running heads (short lines on most pages) and repeats of the line before."""
    pages = rows.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    seen = rows.select(doc, page, "line").distinct().groupBy(doc, "line").agg(F.count(F.lit(1)).alias("_n"))
    heads = seen.join(pages, doc).filter((F.col("_n") >= F.greatest(F.lit(least), F.floor(share * F.col("_pages")))) & (F.length("line") <= longest)).select(doc, "line")
    kept = rows.filter(~L.is_noise(F.col("line"))).join(heads, [doc, "line"], "left_anti")
    before = F.lag("line").over(Window.partitionBy(doc).orderBy(page, "ln"))
    return kept.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("line"))).select(doc, page, "ln", "line")


def collapse_blanks(rows: DataFrame, doc: str) -> DataFrame:
    """Runs of blank lines become one, and those at the end go; line ends are trimmed."""
    w = Window.partitionBy(doc)
    blank = F.trim("line") == ""
    x = rows.withColumn("_b", F.lag(blank).over(w.orderBy("ln"))).withColumn("_last", F.max(F.when(~blank, F.col("ln"))).over(w))
    return x.filter((F.col("ln") <= F.col("_last")) & ~(blank & F.coalesce("_b", F.lit(False)))).withColumn("line", F.rtrim("line")).drop("_b", "_last")


def heading_paths(rows: DataFrame, doc: str) -> DataFrame:
    """Each line that is no heading, with the path of the headings above it.

    A heading of level k stands until one of its level or above. A table's heading also ends with the first line after it that is
    neither blank nor a row.
    """
    w = Window.partitionBy(doc).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    level, line = L.mark_level(F.col("line")), F.col("line")
    x = rows.withColumn("_l", level)
    x = x.withColumn("_end", F.max(F.when((F.trim("line") != "") & F.col("_l").isNull() & ~L.is_table_row(line), F.col("ln"))).over(w))
    for k in range(1, 7):
        x = x.withColumn(f"_p{k}", F.max(F.when(F.col("_l") == k, F.struct("ln", L.mark_text(line).alias("text"), L.is_table_heading(line).alias("tab")))).over(w))
    keep = []
    for k in range(1, 7):
        p = F.col(f"_p{k}")
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_p{j}")["ln"], F.lit(-1)) for j in range(1, k)])
        stands = (p["ln"] > above) & ~(p["tab"] & (F.coalesce("_end", F.lit(-1)) > p["ln"]))
        keep.append(F.when(stands, p["text"]))
    path = F.array_join(F.filter(F.array(*keep), lambda v: v.isNotNull()), " > ")
    return x.filter("_l is null").select(doc, "ln", "line", path.alias("path"))


def rebalance(rows: DataFrame, doc: str) -> DataFrame:
    """Headings move up so that the highest (tables' apart) is of level 2."""
    line = F.col("line")
    x = rows.withColumn("_l", F.when(~L.is_table_heading(line), L.mark_level(line)))
    x = x.withColumn("_low", F.min("_l").over(Window.partitionBy(doc)))
    moved = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(2), F.col("_l") - (F.col("_low") - 2))), F.lit(" "), L.mark_text(line))
    return x.withColumn("line", F.when(F.col("_l").isNotNull() & (F.col("_low") > 2), moved).otherwise(line)).drop("_l", "_low")


def hierarchy(rows: DataFrame, doc: str) -> DataFrame:
    """No heading is more than one level below the one before it, and none but the first is of level 1.

    The k-th heading's new level is the least of b_j + k - j over the headings j up to it, where b_1 is 1 or 2 and b_j the level, 2 at
    least: a running minimum in place of a fold.
    """
    w = Window.partitionBy(doc).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    x = rows.withColumn("_l", L.mark_level(line)).withColumn("_k", F.count("_l").over(w))
    bound = F.when(F.col("_k") == 1, F.least(F.col("_l"), F.lit(2))).otherwise(F.greatest(F.col("_l"), F.lit(2)))
    x = x.withColumn("_n", F.col("_k") + F.min(F.when(F.col("_l").isNotNull(), bound - F.col("_k"))).over(w))
    new = F.concat(F.repeat(F.lit("#"), F.col("_n").cast("int")), F.lit(" "), L.mark_text(line))
    return x.select(doc, F.col("ln").cast("int").alias("ln"), F.when(F.col("_l").isNull(), line).otherwise(new).alias("line"))


def header_fields(rows: DataFrame, doc: str) -> DataFrame:
    """Title (the first heading of level 1), source address and all headings of each document."""
    line = F.col("line")
    level = L.mark_level(line)
    return rows.groupBy(doc).agg(
        F.min_by(L.mark_text(line), F.when(level == 1, F.col("ln"))).alias("title"),
        F.min_by(F.nullif(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), F.lit("")), F.when(F.lower(line).startswith("source:"), F.col("ln"))).alias("source_url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(level.isNotNull(), F.struct("ln", L.mark_text(line).alias("t"))))), lambda x: x["t"]), " > ").alias("headings"),
    )


def flat_sections(rows: DataFrame, doc: str) -> DataFrame:
    """doc, section and its lines: each heading begins one; sections without text go."""
    w = Window.partitionBy(doc).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("section", F.sum(F.col("line").startswith("#").cast("long")).over(w))
    s = x.groupBy(doc, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda y: y["line"]).alias("lines"))
    return s.filter(F.exists("lines", lambda y: F.trim(y) != ""))


def finalized(rows: DataFrame, titles: DataFrame, doc: str) -> DataFrame:
    """doc and text: `# title`, then the body with its headings in order and single blank lines, and a line feed at the end. titles: doc, title."""
    body = collapse_blanks(hierarchy(rows, doc), doc)
    one = body.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("body"))
    whole = F.trim(F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.nullif(F.btrim("body", F.lit("\n")), F.lit(""))))
    return titles.join(one, doc, "left").select(doc, F.concat(whole, F.lit("\n")).alias("text"))
