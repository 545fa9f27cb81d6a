"""Queries of printed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators import pages, structure
from ragframe.plans.registry import query, table
from ragframe.plans.structure_queries import _CLASS, _NOISE

#: What stands before each document's text: a cover, a list of contents, numbered headings, capitals and bullets.
_FRONT = ["Cover", "- cover item", "MỤC LỤC", "1.1. entry", "page 1", "II. First part", "* item", "FIRST CAPS", "SECOND CAPS", "1.2. Sub part", "THIRD CAPS"]

_PAGES = rf"""d as (select doc_id, {" || chr(10) || ".join(f"'{x}'" for x in _FRONT)} || chr(10) || coalesce(text, '') as text from documents),
a as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 as ln from d),
n as (select *, ln // 20 as page from a), p as (select doc_id, count(distinct page) as pages from n group by 1), q as (select doc_id, line, count(distinct page) as n from n group by all),
k as (select n.* from n join p using (doc_id) join q using (doc_id, line) where not {_NOISE} and not (q.n >= greatest(3, floor(0.6 * pages)) and length(line) <= 80)),
x as (select *, lag(line) over (partition by doc_id order by page, ln) as before from k), l as (select doc_id, page, ln, line from x where before is null or before <> line), {_CLASS},
s as (select *, contains(upper(t), 'MỤC LỤC') or contains(upper(t), 'MUC LUC') as toc, regexp_matches(t, '^[-*•]') as bullet from g where t <> ''),
u as (select *, max(case when toc then ln end) over v as at_toc, max(case when not toc and regexp_matches(t, '^(I|II|III|IV|V|VI|VII|VIII|IX|X)[.)]?\s+\S+', 'i') then ln end) over v as at_roman from s window v as (partition by doc_id order by ln rows unbounded preceding)),
b as (select *, max(case when not bullet and tok <> '' and not regexp_matches(tok, '^Q\d+$', 'i') then 1 else 0 end) over (partition by doc_id order by ln rows unbounded preceding) as started from u where not toc and (at_toc is null or at_roman > at_toc)),
h as (select *, case when not bullet and tok <> '' then lvl end as own, count(case when not bullet and tok <> '' then 1 end) over v as run, last_value(case when not bullet and tok <> '' then lvl end ignore nulls) over v as above, not bullet and tok = '' and lvl is not null as caps from b where started = 1 window v as (partition by doc_id order by ln rows unbounded preceding)),
o as (select *, least(above + sum(case when caps then 1 else 0 end) over (partition by doc_id, run order by ln rows unbounded preceding), 4) as low from h)"""


def front(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document below the front matter, in pages of 20 lines."""
    d = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("\n".join(_FRONT) + "\n"), F.coalesce("text", F.lit(""))))
    return structure.lines(d).withColumn("page", F.floor(F.col("ln") / 20))


@query("pdf_lines", rf"""with {_PAGES} select doc_id, ln, case when bullet then '- ' || regexp_replace(t, '^[-*• ]+', '') when own is not null then repeat('#', own::int) || ' ' || body when caps then repeat('#', low::int) || ' ' || t else t end as line from o""")
def pdf_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_lines(front(spark, sf), "doc_id").select("doc_id", "ln", "line")


def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables for each document on its first pages: one of two rows, and one that is empty."""
    cells = F.array(F.array(F.lit(" a "), F.lit("b\nc"), F.lit("")), F.array(F.lit("---"), F.lit(":---:"), F.lit("")), F.array(F.lit(""), F.lit(""), F.col("doc_id").cast("string")), F.array(F.lit("x"), F.lit(None).cast("string"), F.lit("")))
    own = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("page"), F.lit(1).alias("table"), F.posexplode(cells).alias("row", "cells"))
    empty = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("page"), F.lit(0).alias("table"), F.lit(0).alias("row"), F.array(F.lit(""), F.lit("")).alias("cells"))
    return own.unionByName(empty)


@query("pdf_tables", """select doc_id, unnest(['### Bang 2', '- a | b c | ' || doc_id, '- x | - | -']) as line from documents""")
def pdf_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of tables alone."""
    lines = pages.page_lines(front(spark, sf), "doc_id").filter("line = '## First part'")
    return pages.with_tables(lines, page_tables(spark, sf), "doc_id").filter("line <> '## First part'").select("doc_id", "line")


@query("pdf_build")
def pdf_build(spark: SparkSession, sf: str) -> DataFrame:
    """Finished texts; every tenth document has no page."""
    titles = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    some = lambda df: df.filter("doc_id % 10 <> 3")
    return pages.built(some(front(spark, sf)), some(page_tables(spark, sf)), titles, "doc_id").select("doc_id", "reason", F.md5(F.col("text").cast("binary")).alias("digest"))
