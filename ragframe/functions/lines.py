"""Line functions as Column expressions: noise, headings, table rows, facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragframe.functions.text import fold, normalize_line

# Forms of headings, table captions, page numbers and facts.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
TABLE_HEADING = r"(?i)^#{2,6}\s+Bang\s+\d+\s*$"
PREFIX = r"(?i)^(Q\d+|[IVXLCDM]+|\d+(?:\.\d+)*)[.)]?\s+(\S.*)$"
NOISE = r"(?i)^(?:\d{1,3}|trang\s+\d+(?:\s*/\s*\d+)?|page\s+\d+(?:\s*/\s*\d+)?|\d+\s*/\s*\d+)$"
ROMAN = r"(?i)^[IVXLCDM]+$"
URLS = r"https?://[^\s)>\"]+"


def is_noise(line: Column) -> Column:
    return (line == "") | line.rlike(NOISE)


def heading_kind(line: Column) -> Column:
    """question, roman or numeric, or null without a prefix."""
    token = F.regexp_extract(line, PREFIX, 1)
    return F.when(token == "", None).when(token.rlike(r"(?i)^Q\d+$"), "question").when(token.rlike(ROMAN), "roman").otherwise("numeric")


def heading_body(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, PREFIX, 2), F.lit(""))


def prefix_level(line: Column) -> Column:
    """Level by the prefix: 2, or for numbers three more than their dots, six at most."""
    token = F.regexp_extract(line, PREFIX, 1)
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    return F.when(heading_kind(line).isin("question", "roman"), 2).when(heading_kind(line) == "numeric", F.least(dots + 3, F.lit(6)))


def heading_level(line: Column) -> Column:
    """Level of a line that reads as a heading, else null: by its prefix, or short and in capitals."""
    words = F.size(F.split(F.trim(line), " "))
    capitals = (line != "") & words.between(1, 14) & (F.length(line) <= 100) & (line == F.upper(line)) & ~line.endswith(".")
    return F.coalesce(prefix_level(line), F.when(capitals, 2))


def classify(raw: Column) -> Column:
    """A line in the light mark-up: a bullet, a heading or text."""
    line = normalize_line(raw)
    bullet = F.concat(F.lit("- "), F.regexp_replace(line, r"^[-* ]+", ""))
    level = heading_level(line)
    text = F.coalesce(heading_body(line), line)
    return F.when(line == "", "").when(line.rlike(r"^[-*]"), bullet).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(line)


def mark_level(line: Column) -> Column:
    """Level of a marked heading, else null."""
    return F.nullif(F.length(F.regexp_extract(line, HEADING, 1)), F.lit(0))


def mark_text(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, HEADING, 2), F.lit(""))


def is_table_heading(line: Column) -> Column:
    return line.rlike(TABLE_HEADING)


def is_table_row(line: Column) -> Column:
    return line.startswith("- ") & line.contains(" | ")


def is_inline_fact(line: Column) -> Column:
    return line.contains(":") & (F.length(line) <= 120)


def cells(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "^- ", ""), r" \| ")


def first_meaningful(row: Column) -> Column:
    return F.try_element_at(F.filter(row, lambda x: ~x.isin("", "-")), F.lit(1))


def is_header(row: Column) -> Column:
    """No digit or roman number first, and enough cells of letters alone."""
    filled = F.size(F.filter(row, lambda x: ~x.isin("", "-")))
    informative = F.size(F.filter(row, lambda x: x.rlike(r"\p{L}") & ~x.rlike(r"\d")))
    first = first_meaningful(row)
    return F.coalesce(~first.rlike(r"\d") & ~first.rlike(ROMAN) & (informative >= F.greatest(F.lit(2), F.floor(filled / 2))), F.lit(False))


def is_group(row: Column) -> Column:
    """A row that heads those below it: a roman number first."""
    return F.coalesce(first_meaningful(row).rlike(ROMAN), F.lit(False))


def merged_header(upper: Column, lower: Column) -> Column:
    """Two header rows as one: either, or both with the lower in brackets."""
    u, w = lambda a: F.coalesce(a, F.lit("")), lambda b: F.coalesce(b, F.lit(""))
    return F.zip_with(upper, lower, lambda a, b: F.when(u(a) == "", w(b)).when((w(b) == "") | (u(a) == w(b)), u(a)).otherwise(F.concat(u(a), F.lit(" ("), w(b), F.lit(")"))))


def fact_alias(line: Column) -> Column:
    """A sentence for a `key: value` line, else null."""
    body = F.regexp_replace(line, "^- ", "")
    key, value = F.trim(F.regexp_extract(body, r"^([^:\n]{2,80}):\s*(.+)$", 1)), F.trim(F.regexp_extract(body, r"^([^:\n]{2,80}):\s*(.+)$", 2))
    ok = (key != "") & (value != "") & ~line.contains(" | ") & ~line.rlike("https?://") & (F.lower(key) != "source")
    return F.when(ok, F.concat(F.lit("Tra cứu nhanh: "), key, F.lit(" là "), value, F.lit(".")))


def block_lines(text: Column) -> Column:
    """The lines of a block in normal form, without empty ones."""
    return F.filter(F.transform(F.split(text, "\r\n|\r|\n"), normalize_line), lambda x: x != "")


def is_low_signal(header: Column) -> Column:
    """Whether a table's header (an array of cells) names the equipment."""
    return F.exists(header, lambda x: F.contains(fold(x), F.lit("cac trang thiet bi chinh")))
