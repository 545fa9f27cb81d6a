"""Queries of relevance, sources, round trips, section flags and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import lines as ln
from ragframe.functions import metrics as m
from ragframe.functions import text as t
from ragframe.operators import chunking, relevance
from ragframe.plans.registry import query, sql_norm, sql_tokens, table
from ragframe.plans.retrieval_queries import _DVEC, dense_hits, dvec


#: Each hit with its cosine to the query and to the reference, which is the query's first hit.
_PAIRS = """cs as (select d.query_id, d.doc_id, d.rank, d.score, round(greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as ref_score
from dense d join dense f on f.query_id = d.query_id and f.rank = 1 join v a on a.doc_id = d.doc_id join v b on b.doc_id = f.doc_id)"""
_KEYS = f"list_filter({sql_tokens('q.text')}, lambda x: length(x) > 5)"
_KW = "case when len(k) = 0 then 1.0 else len(list_filter(k, lambda x: contains(n, x))) / len(k)::double end"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, rank, score (cosine with the query) and ref_score (with the query's first hit)."""
    hits, v = dense_hits(spark, sf), dvec(spark, sf).select("doc_id", "embedding")
    first = hits.filter("rank = 1").select("query_id", F.col("doc_id").alias("ref_id")).join(v.select(F.col("doc_id").alias("ref_id"), F.col("embedding").alias("ref")), "ref_id")
    return hits.join(v, "doc_id").join(first, "query_id").select("query_id", "doc_id", "rank", "score", F.round(m.cosine(F.col("embedding"), F.col("ref")), 6).alias("ref_score"))


def pair_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = dvec(spark, sf).select("doc_id", "text", "label")
    return pairs(spark, sf).join(v, "doc_id").join(v.select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"), F.col("label").alias("q_label")), "query_id")


def keyword_share_of(x: DataFrame) -> DataFrame:
    """x with k and kw: the query's long words and the share of them in the text."""
    x = x.withColumn("k", F.filter(t.tokens(F.col("q")), lambda w: F.length(w) > 5)).withColumn("n", t.norm_match(F.col("text")))
    return x.withColumn("kw", m.coverage(F.col("k"), F.col("n")))


@query("context_relevance", f"""with {_DVEC}, {_PAIRS}, s as (select *, {_KW} as kw from (select c.*, {_KEYS} as k, {sql_norm("v.text")} as n from cs c join v on v.doc_id = c.doc_id join v q on q.doc_id = c.query_id)),
z as (select query_id, 0.25 * score + 0.40 * ref_score + 0.35 * kw as b from s)
select query_id, round(avg(b), 4) as context_relevance from (select *, row_number() over (partition by query_id order by b desc) as r from z) where r <= 3 group by 1""")
def context_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.context_relevance(keyword_share_of(pair_texts(spark, sf)), "query_id", "score", "ref_score", "kw")


@query("source_relevance", f"""with {_DVEC}, {_PAIRS}, y as (select c.*, {_KEYS} as k, {sql_norm("v.text")} as n, (v.label = q.label)::int::double as same, list_distinct(regexp_extract_all(q.text, '\\d+(?:[.,]\\d+)?')) as nums, regexp_extract_all(v.text, '\\d+(?:[.,]\\d+)?') as have from cs c join v on v.doc_id = c.doc_id join v q on q.doc_id = c.query_id),
x as (select *, {_KW} as kw from y)
select query_id, doc_id, round(greatest(0, least(1, case when len(nums) > 0 then 0.30 * ref_score + 0.20 * score + 0.25 * kw + 0.10 * same + 0.15 * (len(list_intersect(nums, have)) / len(nums)::double) else 0.40 * ref_score + 0.25 * score + 0.20 * kw + 0.15 * same end)), 4) as relevance from x""")
def source_relevance(spark: SparkSession, sf: str) -> DataFrame:
    x = keyword_share_of(pair_texts(spark, sf)).withColumn("nums", t.numbers(F.col("q"))).withColumn("num", relevance.numeric_overlap(F.col("nums"), F.col("text")))
    same = (F.col("label") == F.col("q_label")).cast("double")
    return x.select("query_id", "doc_id", F.round(relevance.source_relevance(F.col("ref_score"), F.col("score"), F.col("kw"), same, F.col("num"), F.size("nums") > 0), 4).alias("relevance"))


@query("semantic_blend", f"""with {_DVEC}, {_PAIRS}, s as (select *, {_KW} as kw from (select c.*, {_KEYS} as k, {sql_norm("v.text")} as n from cs c join v on v.doc_id = c.doc_id join v q on q.doc_id = c.query_id))
select query_id, doc_id, ref_score as semantic_similarity, round(0.35 * score + 0.40 * ref_score + 0.25 * kw, 4) as answer_relevance from s""")
def semantic_blend(spark: SparkSession, sf: str) -> DataFrame:
    x = keyword_share_of(pair_texts(spark, sf))
    return x.select("query_id", "doc_id", F.col("ref_score").alias("semantic_similarity"), F.round(relevance.answer_relevance(F.col("score"), F.col("ref_score"), F.col("kw")), 4).alias("answer_relevance"))


@query("source_hints", f"""with b as (select doc_id, doc_id % 10 = 0 as none, {sql_norm("source || ' ' || text || ' lang ' || lang")} as b, case when doc_id % 7 = 0 then []::varchar[] when doc_id % 3 = 0 then ['src' || (doc_id % 20)] else ['no-such-hint'] end as h from documents)
select doc_id, case when len(h) = 0 then none::int::double else (not none and len(list_filter(h, lambda x: contains(b, {sql_norm("x")}))) > 0)::int::double end as hit from b""")
def source_hints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents").withColumn("b", relevance.bundle(F.col("source"), F.col("text"), F.create_map(F.lit("lang"), F.col("lang"))))
    none = F.array().cast("array<string>")
    hints = F.when(k % 7 == 0, none).when(k % 3 == 0, F.array(F.concat(F.lit("src"), (k % 20).cast("string")))).otherwise(F.array(F.lit("no-such-hint")))
    d = d.withColumn("h", hints).withColumn("bs", F.when(k % 10 == 0, none).otherwise(F.array("b")))
    return d.select("doc_id", relevance.hint_hit(F.col("h"), F.col("bs")).alias("hit"))


_L = r"l as (select doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) as line from documents)"


@query("section_flags", rf"with {_L} select doc_id, count(*) filter (where starts_with(line, '- ') and contains(line, ' | '))::bigint as n_rows, count(*) filter (where contains(line, ':') and length(line) <= 120)::bigint as n_facts, count(*) filter (where regexp_matches(line, '^#{{2,6}}\s+Bang\s+\d+\s*$', 'i'))::bigint as n_tables from l group by 1")
def section_flags(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    c = F.col("line")
    return x.groupBy("doc_id").agg(F.count_if(ln.is_table_row(c)).alias("n_rows"), F.count_if(ln.is_inline_fact(c)).alias("n_facts"), F.count_if(ln.is_table_heading(c)).alias("n_tables"))


@query("section_merge_a", rf"""with recursive p as (select doc_id, length(line) as n, k from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)),
r as (select doc_id, k, n as len, 0 as used, 1 as grp from p where k = 1 union all
select p.doc_id, p.k, case when r.len < 120 and r.used < 2 then r.len + 2 + p.n else p.n end, case when r.len < 120 and r.used < 2 then r.used + 1 else 0 end, case when r.len < 120 and r.used < 2 then r.grp else r.grp + 1 end from p join r on p.doc_id = r.doc_id and p.k = r.k + 1)
select doc_id, grp::int as grp, max(len)::bigint as n_chars from r group by all""")
def section_merge_a(spark: SparkSession, sf: str) -> DataFrame:
    s = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit("").alias("anchor"), F.lit(False).alias("is_table")))
    d = table(spark, sf, "documents").withColumn("s", s)
    done = d.select("doc_id", F.posexplode(chunking.merged(F.col("s"), chunking.PROFILES["balanced"])).alias("i", "x"))
    return done.select("doc_id", (F.col("i") + 1).alias("grp"), F.length("x.text").cast("long").alias("n_chars"))


@query("record_types", rf"""with {_L}, c as (select doc_id, count(*) filter (where contains(line, ' | ')) as n from l group by 1) select doc_id, case when n >= 2 then 'table_row' else 'section' end as record_type from c""")
def record_types(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    n = F.count_if(F.contains("line", F.lit(" | ")))
    return x.groupBy("doc_id").agg(F.when(n >= 2, "table_row").otherwise("section").alias("record_type"))


@query("vector_roundtrip", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm from embeddings")
def vector_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(n, 5).alias("norm"))


@query("ingest_docs", r"""select printf('%s__chunk__%s__%04d', 'web', trim(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '_'), doc_id::int) as title, 'web' as category from documents where doc_id % 13 <> 0""")
def ingest_docs(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.sources.jsonl import tolerant_chunks

    d = table(spark, sf, "documents")
    line = F.when(F.col("doc_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("doc_id").cast("int").alias("chunk_id"), F.concat(F.lit("web/"), "source").alias("relative_path"), F.col("source").alias("title"), "text")))
    return tolerant_chunks(d.select(line.alias("value"))).select("title", "category")
