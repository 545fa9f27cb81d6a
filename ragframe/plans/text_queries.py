"""Queries of text normal forms, slugs, years, tokens, audit and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import text as t
from ragframe.plans.registry import query, sql_norm, sql_tokens, table

_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
_SLUG = lambda x, m="-": f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '{m}', 'g'), '{m}')"


@query("norm_text", f"select doc_id, {sql_norm('text')} as norm from documents")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.norm_match(F.col("text")).alias("norm"))


@query("fold_text", "select doc_id, lower(regexp_replace(strip_accents(text), '[̀-ͯ]', '', 'g')) as folded from documents")
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.fold(F.col("text")).alias("folded"))


@query("line_norm", rf"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '^\s*[•➢][•➢\s]*', '- '), '[•➢]', ' ', 'g'), '\s+', ' ', 'g')) as line, {_SLUG("text", "_")} as slug, trim(regexp_replace(text, '\s+', ' ', 'g'), ' -;') as clean from documents""")
def line_norm(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", t.normalize_line(F.col("text")).alias("line"), t.slug_underscore(F.col("text")).alias("slug"), t.clean_name(F.col("text")).alias("clean"))


_BLOCK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\A\s+', ''), '\s+\z', '')"


@query("block_norm", rf"select doc_id, md5({_BLOCK}) as block, md5(regexp_replace({_BLOCK}, '\n(?:[ \t]*\n){{2,}}', chr(10) || chr(10), 'g')) as joined from documents")
def block_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalize_block(F.col("text")).cast("binary")).alias("block"), F.md5(t.normalize_block_joined(F.col("text")).cast("binary")).alias("joined"))


@query("token_counts", f"""select doc_id, len(tk)::bigint as n_tokens, len(list_distinct(list_filter(tk, lambda w: length(w) > 1 and w not in ({_STOP}))))::bigint as n_content
from (select doc_id, {sql_tokens("text")} as tk from documents)""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(t.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(t.content_tokens(F.col("text"))).cast("long").alias("n_content"))


@query("number_extract", r"select doc_id, array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), ';') as numbers from documents")
def number_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(t.numbers(F.col("text")), ";").alias("numbers"))


_PLACE = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("url_slugs", f"""select page_id, case when s <> '' then s else 'link-' || sha1(url)[1:12] end as slug
from (select page_id, url, ({_SLUG('url_decode(' + _PLACE + ')')})[1:120] as s from pages)""")
def url_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.slug_from_url(F.col("url")).alias("slug"))


@query("url_dedupe", """with l as (select page_id, unnest(regexp_extract_all(html, 'https?://[^\\s)>"]+')) as url, generate_subscripts(regexp_extract_all(html, 'https?://[^\\s)>"]+'), 1) as pos from pages
union all select page_id, url, 0 from pages)
select url, min(page_id) as first_page, count(*)::bigint as n from l group by url""")
def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    found = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"https?://[^\s)>\"]+"), F.lit(0))).alias("url")).unionByName(p.select("page_id", "url"))
    return found.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))


_YEARS = r"list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^20\d{2}$'))"
_STEM = r"nullif(regexp_extract(regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1), '(20\d{2})', 1), '')"


@query("year_infer", f"""select id, coalesce({_YEARS}[1], {_STEM}, 'unknown') as first_year, coalesce({_YEARS}[-1], {_STEM}, '2000') as last_year
from (select page_id as id, regexp_replace(url, '^[a-z]+://', '') || '/20' || lpad((page_id % 30)::varchar, 2, '0') || '/file-20' || lpad((page_id % 17)::varchar, 2, '0') || '.txt' as path from pages where page_id % 2 = 0
union all select page_id, regexp_replace(url, '^[a-z]+://', '') from pages where page_id % 2 = 1)""")
def year_infer(spark: SparkSession, sf: str) -> DataFrame:
    p, bare = table(spark, sf, "pages"), F.regexp_replace("url", "^[a-z]+://", "")
    two = lambda n: F.lpad((F.col("page_id") % n).cast("string"), 2, "0")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(bare, F.lit("/20"), two(30), F.lit("/file-20"), two(17), F.lit(".txt"))).otherwise(bare)
    return p.select(F.col("page_id").alias("id"), path.alias("path")).select("id", t.infer_year(F.col("path")).alias("first_year"), t.guess_year(F.col("path"), F.lit("2000")).alias("last_year"))


@query("title_norm", r"""select doc_id, regexp_replace(lower(trim(' ' || source || '-Part_' || doc_id || '.TXT ')), '\.txt$', '') as title,
array_to_string(list_transform(string_split(regexp_replace(source || '-part_' || (doc_id % 7), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as shown from documents""")
def title_norm(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "source", F.lit("-Part_"), F.col("doc_id").cast("string"), F.lit(".TXT "))
    stem = F.concat("source", F.lit("-part_"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf, "documents").select("doc_id", t.normalize_title(raw).alias("title"), t.title_from_stem(stem).alias("shown"))


@query("node_uuid5", """with h as (select doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('documents/' || doc_id || '.txt::chunk-1')) as h from documents)
select doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[1 + (('0x' || h[17])::int & 3)] || h[18:20] || '-' || h[21:32] as node_id from h""")
def node_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.retrieval import nodes_of

    return nodes_of(table(spark, sf, "documents"))


@query("doc_reconcile", """with e as (select distinct source from documents), a as (select distinct source from documents join labels using (doc_id) where quality = 0 union select 'src-extra')
select coalesce(e.source, a.source) as source, e.source is not null and a.source is null as missing, e.source is null as extra from e full join a on e.source = a.source""")
def doc_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.audit import compare

    d = table(spark, sf, "documents")
    actual = d.join(table(spark, sf, "labels").filter("quality = 0"), "doc_id").select("source").union(spark.range(1).select(F.lit("src-extra")))
    return compare(d.select("source"), actual, "source")


@query("chunk_manifest", """select source as relative_path, count(*)::bigint as chunk_count, sum(length(text))::bigint as total_chars, case when count(*) = count(*) filter (where text is not null) then 'match' else 'drift' end as status from documents group by source""")
def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.audit import manifest

    return manifest(table(spark, sf, "documents"), "source", "text")


@query("ingest_antijoin", r"""select doc_id from documents d where not exists (select 1 from labels l where regexp_replace(lower(trim('Doc ' || l.doc_id || '.txt')), '\.txt$', '') = lower('doc ' || d.doc_id))""")
def ingest_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.audit import not_ingested

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    there = table(spark, sf, "labels").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"))
    return not_ingested(d, there, "title").select("doc_id")


@query("chunk_records", r"""select ('documents/' || doc_id || '.txt::chunk-' || case when doc_id % 5 = 0 then 1 else doc_id % 5 end) as doc_id, (case when doc_id % 5 = 0 then 1 else doc_id % 5 end)::bigint as chunk_id, source as title, length(text)::bigint as char_count from documents where trim(text) <> ''""")
def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.sources.jsonl import parse_chunks, write_jsonl

    d = table(spark, sf, "documents")
    raw = d.select((F.col("doc_id") % 5).cast("int").alias("chunk_id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("source").alias("title"), "text")
    return parse_chunks(write_jsonl(raw)).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "title", "char_count")


@query("sink_accounting", "select case when doc_id % 11 = 0 then 'timeout' when doc_id % 7 = 0 then 'http' else 'ok' end as status, count(*)::bigint as n from documents group by 1")
def sink_accounting(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.sources.sinks import accounted

    status = F.when(F.col("doc_id") % 11 == 0, "timeout").when(F.col("doc_id") % 7 == 0, "http").otherwise("ok")
    return accounted(table(spark, sf, "documents").select(status.alias("status")))


@query("csv_roundtrip", "select event_id, coalesce(try_cast(value::varchar as double), 0) as v from events where value is not null")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.sources.sinks import csv_lines, csv_rows

    e = table(spark, sf, "events").filter("value is not null").select("event_id", "value")
    return csv_rows(csv_lines(e), ["event_id", "value"]).select(F.col("event_id").cast("long").alias("event_id"), t.safe_float(F.col("value")).alias("v"))


@query("remote_titles", r"""select distinct j as title from (select unnest(regexp_extract_all(props, '"([^"]+)"\s*:', 1)) as j from events)""")
def remote_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("title")).distinct()


@query("embed_hash", f"""with tk as (select doc_id, unnest({sql_tokens("text")}) as w from documents), b as (select doc_id, ('0x' || md5(w)[1:8])::bigint % 64 as bucket, count(*)::double as c from tk group by all),
n as (select doc_id, sqrt(sum(c * c)) as n from b group by doc_id) select doc_id, bucket::bigint as bucket, round(c / n.n, 6) as weight from b join n using (doc_id)""")
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.embed import hashed

    return hashed(table(spark, sf, "documents"), 64)
