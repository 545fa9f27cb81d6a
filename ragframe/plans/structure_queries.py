"""Queries of lines, headings, sections, chunks, pages and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.functions import lines as ln
from ragframe.operators import chunking, html, layout, structure
from ragframe.plans.registry import query, table

_LINES = r"l as (select doc_id, source, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 as ln from documents)"
_NOISE = r"(line = '' or regexp_matches(line, '^(?:\d{1,3}|trang\s+\d+(?:\s*/\s*\d+)?|page\s+\d+(?:\s*/\s*\d+)?|\d+\s*/\s*\d+)$', 'i'))"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return structure.lines(table(spark, sf, "documents"), ("doc_id", "source"))


@query("line_noise", f"with {_LINES} select doc_id, ln, {_NOISE} as noise from l")
def line_noise(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "ln", ln.is_noise(F.col("line")).alias("noise"))


@query("repeated_line_filter", f"""with {_LINES}, g as (select *, ln // 5 as page from l), p as (select doc_id, count(distinct page) as pages from g group by 1), r as (select doc_id, line, count(distinct page) as n from g group by all),
k as (select g.* from g join p using (doc_id) join r using (doc_id, line) where not {_NOISE} and not (n >= greatest(3, floor(0.6 * pages)) and length(line) <= 80)),
x as (select *, lag(line) over (partition by doc_id order by page, ln) as before from k)
select doc_id, page::bigint as page, ln, line from x where before is null or before <> line""")
def repeated_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    x = lines(spark, sf).withColumn("page", F.floor(F.col("ln") / 5))
    return structure.without_noise(x, "doc_id", "page")


@query("blank_collapse", f"""with {_LINES}, b as (select *, trim(line) = '' as blank, lag(trim(line) = '') over (partition by doc_id order by ln) as before, max(case when trim(line) <> '' then ln end) over (partition by doc_id) as last from l)
select doc_id, ln, rtrim(line) as line from b where ln <= last and not (blank and coalesce(before, false))""")
def blank_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return structure.collapse_blanks(lines(spark, sf), "doc_id").select("doc_id", "ln", "line")


_PREFIX = r"^(Q\d+|[IVXLCDM]+|\d+(?:\.\d+)*)[.)]?\s+(\S.*)$"
_NL = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
_CLASS = rf"""c as (select *, {_NL} as t, regexp_extract({_NL}, '{_PREFIX}', 1, 'i') as tok, regexp_extract({_NL}, '{_PREFIX}', 2, 'i') as body from l),
g as (select *, case when tok = '' then case when t <> '' and len(string_split(t, ' ')) between 1 and 14 and length(t) <= 100 and t = upper(t) and not ends_with(t, '.') then 2 end
  when regexp_matches(tok, '^(Q\d+|[IVXLCDM]+)$', 'i') then 2 else least(length(tok) - length(replace(tok, '.', '')) + 3, 6) end as lvl from c),
cl as (select *, case when t = '' then '' when regexp_matches(t, '^[-*]') then '- ' || regexp_replace(t, '^[-* ]+', '') when lvl is not null then repeat('#', lvl) || ' ' || case when body <> '' then body else t end else t end as kind_line from g)"""


@query("line_classify", f"with {_LINES}, {_CLASS} select doc_id, ln, kind_line as line, lvl::bigint as level from cl")
def line_classify(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.functions.text import normalize_line

    x = lines(spark, sf)
    return x.select("doc_id", "ln", ln.classify(F.col("line")).alias("line"), ln.heading_level(normalize_line(F.col("line"))).cast("long").alias("level"))


#: What stands around each document's text, in both engines: skipped levels, tables and facts. The levels of two headings go by doc_id.
_ABOVE = ["# Guide", "Source: https://example.org/a", "intro", "## I. Plan", "text one", "#### Deep", "deep text"]
_BELOW = ["### Fee: 100", "### Bang 1", "- code | name | quota", "- 1 | a | 5", "", "- 2 | b | 6", "after table", "## II. Next", "### Bang 2", "- x | y", "- II | z", "tail", "## Empty", "### Inner", "last"]
_MARKED = rf"""d as (select doc_id, {" || chr(10) || ".join(f"'{x}'" for x in _ABOVE)} || chr(10) || repeat('#', 1 + (doc_id % 6)::int) || ' Own' || chr(10) || coalesce(text, '') || chr(10) || {" || chr(10) || ".join(f"'{x}'" for x in _BELOW)} || chr(10) || repeat('#', 6 - (doc_id % 6)::int) || ' End' as text from documents),
f as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 as ln from d),
m as (select *, nullif(length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)), 0) as lvl, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2) as txt, regexp_matches(line, '^#{{2,6}}\s+Bang\s+\d+\s*$', 'i') as tab, starts_with(line, '- ') and contains(line, ' | ') as trow from f)"""


def marked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every whole document within the mark-up."""
    k = (F.col("doc_id") % 6).cast("int")
    own, end = F.concat(F.repeat(F.lit("#"), 1 + k), F.lit(" Own")), F.concat(F.repeat(F.lit("#"), 6 - k), F.lit(" End"))
    text = F.concat_ws("\n", F.lit("\n".join(_ABOVE)), own, F.coalesce("text", F.lit("")), F.lit("\n".join(_BELOW)), end)
    return structure.lines(table(spark, sf, "documents").withColumn("text", text))


def _path_sql() -> str:
    over = "over (partition by doc_id order by ln rows unbounded preceding)"
    p = ", ".join(f"max(case when lvl = {k} then ln end) {over} as p{k}, last_value(case when lvl = {k} then txt end ignore nulls) {over} as x{k}, last_value(case when lvl = {k} then tab end ignore nulls) {over} as t{k}" for k in range(1, 7))
    keep = [f"case when p{k} is not null and p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) and not (t{k} and coalesce(lb, -1) > p{k}) then x{k} end" for k in range(1, 7)]
    return f"""with {_MARKED}, w as (select *, {p}, max(case when trim(line) <> '' and not trow and lvl is null then ln end) {over} as lb from m)
select doc_id, ln::int as ln, array_to_string(list_filter([{', '.join(keep)}], lambda x: x is not null), ' > ') as path from w where lvl is null"""


@query("heading_paths", _path_sql())
def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    return structure.heading_paths(marked_lines(spark, sf), "doc_id").select("doc_id", "ln", "path")


@query("heading_rebalance", rf"with {_MARKED}, s as (select doc_id, min(lvl) filter (where not tab) as low from m where ln > 3 group by 1) select doc_id, ln::int as ln, case when lvl is null or tab or low <= 2 then line else repeat('#', greatest(2, lvl - (low - 2))) || ' ' || txt end as line from m join s using (doc_id) where ln > 3")
def heading_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """The lines after the first four, whose headings begin deeper than level 2 in many documents."""
    return structure.rebalance(marked_lines(spark, sf).filter("ln > 3"), "doc_id").select("doc_id", "ln", "line")


@query("heading_hierarchy", rf"""with recursive {_MARKED}, h as (select *, row_number() over (partition by doc_id order by ln) as k from m where lvl is not null),
r as (select doc_id, k, ln, txt, (case when lvl = 1 then 1 else 2 end)::bigint as out from h where k = 1 union all select h.doc_id, h.k, h.ln, h.txt, greatest(2, least(h.lvl, r.out + 1))::bigint from h join r on h.doc_id = r.doc_id and h.k = r.k + 1)
select doc_id, ln::int as ln, repeat('#', out::int) || ' ' || txt as line from r""")
def heading_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return structure.hierarchy(marked_lines(spark, sf), "doc_id").filter(ln.mark_level(F.col("line")).isNotNull()).select("doc_id", "ln", "line")


@query("doc_header_fields", rf"""with {_MARKED} select doc_id, arg_min(txt, ln) filter (where lvl = 1) as title, arg_min(trim(regexp_replace(line, '^[^:]*:', '')), ln) filter (where lower(line) like 'source:%') as source_url, string_agg(txt, ' > ' order by ln) filter (where lvl is not null) as headings from m group by 1""")
def doc_header_fields(spark: SparkSession, sf: str) -> DataFrame:
    return structure.header_fields(marked_lines(spark, sf), "doc_id")


@query("section_flat", f"""with {_LINES}, {_CLASS}, s as (select doc_id, ln, kind_line as line, sum(case when starts_with(kind_line, '#') then 1 else 0 end) over (partition by doc_id order by ln) as section from cl)
select doc_id, section::bigint as section, count(*)::bigint as n_lines, sum(length(line))::bigint as n_chars from s group by all having sum(length(trim(line))) > 0""")
def section_flat(spark: SparkSession, sf: str) -> DataFrame:
    x = lines(spark, sf).select("doc_id", "ln", ln.classify(F.col("line")).alias("line"))
    s = structure.flat_sections(x, "doc_id")
    return s.select("doc_id", "section", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0), lambda a, y: a + F.length(y)).cast("long").alias("n_chars"))


_PACK = "list_reduce(list_prepend([]::varchar[], list_transform(blocks, lambda x: [x])), lambda a, b: case when len(a) > 0 and length(a[-1]) + 1 + length(b[1]) <= {most} then list_append(a[1:len(a) - 1], a[-1] || '{sep}' || b[1]) else list_append(a, b[1]) end)"


@query("paragraph_pack", f"""with b as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as blocks from documents), p as (select doc_id, {_PACK.format(most=700, sep="' || chr(10) || '")} as parts from b)
select doc_id, unnest(range(len(parts)))::int as part, unnest(list_transform(parts, lambda x: length(x)))::bigint as n_chars, unnest(list_transform(parts, lambda x: md5(x))) as digest from p""")
def paragraph_pack(spark: SparkSession, sf: str) -> DataFrame:
    p = chunking.packed(table(spark, sf, "documents"), "text", "\n", 700)
    return p.select("doc_id", F.posexplode("parts").alias("part", "x")).select("doc_id", "part", F.length("x").cast("long").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("word_wrap", rf"""with b as (select doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') as blocks from documents), p as (select doc_id, {_PACK.format(most=200, sep=" ")} as parts from b)
select doc_id, unnest(range(len(parts)))::int as part, unnest(list_transform(parts, lambda x: length(x)))::bigint as n_chars from p""")
def word_wrap(spark: SparkSession, sf: str) -> DataFrame:
    p = chunking.wrapped(table(spark, sf, "documents"), "text", 200)
    return p.select("doc_id", F.posexplode("parts").alias("part", "x")).select("doc_id", "part", F.length("x").cast("long").alias("n_chars"))


@query("chunk_emit", f"""with b as (select doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as blocks from documents), p as (select doc_id, source, {_PACK.format(most=700, sep="' || chr(10) || '")} as parts from b),
c as (select doc_id, source, unnest(range(1, len(parts) + 1))::int as chunk_id, unnest(parts) as body from p)
select doc_id, chunk_id, md5('<document_context>' || chr(10) || 'Tài liệu: ' || source || chr(10) || '</document_context>' || chr(10) || body) as digest, length('<document_context>' || chr(10) || 'Tài liệu: ' || source || chr(10) || '</document_context>' || chr(10) || body)::bigint as char_count from c""")
def chunk_emit(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.emitted(table(spark, sf, "documents"), "text", "source", 700)
    return c.select("doc_id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"), "char_count")


@query("html_titles", r"select page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')) as title from pages")
def html_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_BLOCKS = r"""b as (select page_id, unnest(regexp_extract_all(html, '<(h[1-6]|p|li)[^>]*>([^<]*)', 1, 'i')) as tag, unnest(regexp_extract_all(html, '<(h[1-6]|p|li)[^>]*>([^<]*)', 2, 'i')) as raw, generate_subscripts(regexp_extract_all(html, '<(h[1-6]|p|li)[^>]*>([^<]*)', 1, 'i'), 1) - 1 as pos from pages),
t as (select page_id, pos, lower(tag) as tag, trim(regexp_replace(raw, '\s+', ' ', 'g')) as line from b), k as (select *, lag(line) over (partition by page_id order by pos) as before from t where line <> '')"""


@query("html_blocks", f"with {_BLOCKS} select page_id, pos::int as pos, tag, line from k where before is null or before <> line")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.blocks(table(spark, sf, "pages"))


@query("html_blocks_dom")
def html_blocks_dom(spark: SparkSession, sf: str) -> DataFrame:
    return html.dom_lines(table(spark, sf, "pages"))


@query("web_documents")
def web_documents(spark: SparkSession, sf: str) -> DataFrame:
    return html.web_documents(table(spark, sf, "pages")).select("page_id", "error", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("web_build_stats", "select count(*)::bigint as total, count(*) filter (where html is not null and page_id % 9 <> 0)::bigint as written from pages")
def web_build_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 9 != 0, F.col("html")))
    return html.built(p)


#: Line items have repeated numbers, so rows are numbered anew within their order.
_ITEMS = "li as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as n from lineitem)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w))


@query("table_render", f"""with {_ITEMS}, r as (select l_orderkey as table_id, n as row, [case when n % 3 = 0 then '' else l_returnflag end, case when n % 3 = 0 then '' else l_linestatus end, 'n' || n] as c from li),
g as (select *, sum(case when c[1] = '' and c[2] = '' then 0 else 1 end) over (partition by table_id order by row) as grp from r),
m as (select table_id, greatest(grp, 0) as grp, min(row) as row, arg_min(c[1], row) as a, arg_min(c[2], row) as b, string_agg(c[3], '; ' order by row) as c from g group by all),
t as (select *, '- ' || case when a = '' then '-' else a end || ' | ' || case when b = '' then '-' else b end || ' | ' || c as line from m)
select table_id, line, min(row)::int as row from t group by all""")
def table_render(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf)
    third = F.col("n") % 3 == 0
    grid = i.select(F.col("l_orderkey").alias("table_id"), F.col("n").alias("row"), F.array(F.when(third, "").otherwise(F.col("l_returnflag")), F.when(third, "").otherwise(F.col("l_linestatus")), F.concat(F.lit("n"), F.col("n").cast("string"))).alias("cells"))
    return html.rendered(grid)


@query("table_header_merge", "select p_partkey, array_to_string([p_brand || ' (' || p_type || ')', p_name, case when p_size % 2 = 0 then p_size::varchar else 'x' end], ' | ') as header from part")
def table_header_merge(spark: SparkSession, sf: str) -> DataFrame:
    up = F.array("p_brand", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""))
    low = F.array(F.col("p_type"), F.lit(""), F.when(F.col("p_size") % 2 == 0, "").otherwise("x"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(ln.merged_header(up, low), " | ").alias("header"))


@query("table_aliases", """select s_suppkey, 'Tra cứu bảng: key: ' || s_suppkey || '; name: ' || s_name as alias, 'Tra cứu nhanh: ' || s_name || ' là ' || s_nationkey || '.' as fact from supplier""")
def table_aliases(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    row = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"))
    return s.select("s_suppkey", html.row_alias(F.array(F.lit("key"), F.lit("name")), row).alias("alias"), ln.fact_alias(F.concat("s_name", F.lit(": "), F.col("s_nationkey").cast("string"))).alias("fact"))


@query("group_row_carry", f"with {_ITEMS} select l_orderkey, n, last_value(case when n % 3 = 1 then l_returnflag || n end ignore nulls) over (partition by l_orderkey order by n rows unbounded preceding) as carried from li")
def group_row_carry(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.facts import carried_group

    i = items(spark, sf).withColumn("g", F.when(F.col("n") % 3 == 1, F.concat("l_returnflag", F.col("n").cast("string"))))
    return carried_group(i, "l_orderkey", "n", "g").select("l_orderkey", "n", "carried")


_BOX = "b as (select p_partkey as id, (p_partkey % 50)::int as page, (p_partkey % 7 * 60)::double as x0, (p_size * 10)::double as y0, (p_partkey % 7 * 60 + 50)::double as x1, (p_size * 10 + 12)::double as y1 from part), t as (select s_suppkey % 50 as page, (s_suppkey % 5 * 70)::double as x0, 100::double as y0, (s_suppkey % 5 * 70 + 90)::double as x1, 200::double as y1 from supplier)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (k % 50).cast("int").alias("page"), (k % 7 * 60).cast("double").alias("x0"), (F.col("p_size") * 10).cast("double").alias("y0"), (k % 7 * 60 + 50).cast("double").alias("x1"), (F.col("p_size") * 10 + 12).cast("double").alias("y1"))


@query("bbox_anti", f"with {_BOX} select id from b where not exists (select 1 from t where t.page = b.page and b.x0 < t.x1 and b.x1 > t.x0 and b.y0 < t.y1 and b.y1 > t.y0)")
def bbox_anti(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    tables = table(spark, sf, "supplier").select((k % 50).cast("int").alias("page"), (k % 5 * 70).cast("double").alias("x0"), F.lit(100.0).alias("y0"), (k % 5 * 70 + 90).cast("double").alias("x1"), F.lit(200.0).alias("y1"))
    return layout.outside(boxes(spark, sf), tables, ("page",)).select("id")


@query("reading_order")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf).withColumn("width", F.lit(480.0)), ("page",)).select("page", "id", "pos")


@query("pdf_page_stats", "select o_custkey as doc, count(*)::bigint as page_count, count(*) filter (where o_orderstatus = 'O')::bigint as text_pages, count(*) filter (where o_orderstatus = 'P')::bigint as table_pages, bool_or(o_orderstatus in ('O', 'P')) as extractable, case when bool_or(o_orderstatus in ('O', 'P')) then 'ok' else 'no_extractable_text_or_tables' end as reason from orders group by 1")
def pdf_page_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderstatus") == "O").alias("has_text"), (F.col("o_orderstatus") == "P").alias("has_tables"), F.lit(False).alias("ocr"))
    return layout.extractability(o).select("doc", "page_count", "text_pages", "table_pages", "extractable", "reason")


@query("span_expand", f"""with {_ITEMS}, c as (select l_orderkey as table_id, n as row, l_returnflag || n as a, l_linestatus || n as b, lag(l_returnflag || n) over (partition by l_orderkey order by n) as up from li)
select table_id, row::int as row, 0 as col, case when row % 2 = 1 then a else up end as value from c union all select table_id, row::int, 1, b from c union all select table_id, row::int, 2, '' from c""")
def span_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables: each odd row's first cell covers two rows, each row's last cell two columns."""
    i = items(spark, sf).select(F.col("l_orderkey").alias("table_id"), F.col("n").alias("row"), "l_returnflag", "l_linestatus")
    cell = lambda k, v, down, over: F.struct(F.lit(k).alias("ord"), F.concat(v, F.col("row").cast("string")).alias("value"), F.lit(down).alias("rowspan"), F.lit(over).alias("colspan"))
    last = cell(1, "l_linestatus", 0, 2)
    both = F.when(F.col("row") % 2 == 1, F.array(cell(0, "l_returnflag", 2, 1), last)).otherwise(F.array(last))
    return html.spans(i.select("table_id", "row", F.explode(both).alias("c")).select("table_id", "row", "c.*"))


@query("fact_methods", r"""select doc_id, unnest([1, 2])::int as method, unnest(['desc ' || doc_id, 'other ' || source]) as description from documents""")
def fact_methods(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.facts import methods

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Phương thức 1: desc\n"), F.col("doc_id").cast("string"), F.lit(" - Phương thức 2: other "), "source").alias("t"))
    return methods(d, "doc_id", "t")
