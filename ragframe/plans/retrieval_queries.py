"""Queries of search, fusion, the gate, sources, facts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import text as t
from ragframe.operators import facts, generation
from ragframe.operators import retrieval as r
from ragframe.plans.registry import query, sql_norm, sql_tokens, table

_BM25 = f"""post as (select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens("text")}) as term from documents) group by all),
len as (select doc_id, sum(tf) as dl from post group by 1), st as (select (select count(*) from documents) as n, avg(dl) as avgdl from len),
df as (select term, count(*) as df from post group by 1),
q as (select item_id as query_id, unnest(list_distinct({sql_tokens("text")})) as term from benchmark),
bm as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) as score from q join df using (term) join post using (term) join len using (doc_id), st group by all),
sparse as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm qualify rank <= 6)"""
_DVEC = """v as (select doc_id, text, embedding, label from documents join embeddings on doc_id = vec_id),
dd as (select q.doc_id as query_id, v.doc_id, round(greatest(0, list_cosine_similarity(v.embedding::double[], q.embedding::double[])), 6) as score from v, v q where q.doc_id % 50 = 0 and q.doc_id <> v.doc_id),
dense as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from dd qualify rank <= 6)"""
#: The sparse list of the same queries: BM25 over the same nodes.
_WORDS = f"""post as (select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens("text")}) as term from v) group by all),
len as (select doc_id, sum(tf) as dl from post group by 1), st as (select (select count(*) from v) as n, avg(dl) as avgdl from len), df as (select term, count(*) as df from post group by 1),
q as (select doc_id as query_id, unnest(list_distinct({sql_tokens("text")})) as term from v where doc_id % 50 = 0),
ww as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) as score from q join df using (term) join post using (term) join len using (doc_id), st where query_id <> doc_id group by all),
sparse as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ww qualify rank <= 6)"""
_LISTS = "l as (select 'd' as list, * from dense union all select 's', * from sparse)"


def dvec(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their vectors. Texts without one are not moved, but for the few that r.likely() lets through."""
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return r.likely(table(spark, sf, "documents").select("doc_id", "text"), v, "doc_id").join(v, "doc_id")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


def dense_hits(spark: SparkSession, sf: str) -> DataFrame:
    v = dvec(spark, sf).select("doc_id", "embedding")
    return r.dense(v, v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def word_hits(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    v = r.held(table(spark, sf, "documents").select("doc_id", "text"), vectors, "doc_id")  # read where they lie for lengths, for counts, for the queries and by each block of these
    return r.bm25(v, v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), same=False)


def both_lists(spark: SparkSession, sf: str) -> DataFrame:
    # rebalanced: a union of two frames partitioned alike zips their partitions, whose numbers adaptive execution changes
    return dense_hits(spark, sf).withColumn("list", F.lit("d")).unionByName(word_hits(spark, sf).withColumn("list", F.lit("s")).hint("rebalance"))


@query("dense_topk", f"with {_DVEC} select query_id, doc_id, score, rank from dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense_hits(spark, sf)


@query("bm25_topk", f"with {_BM25} select query_id, doc_id, score, rank from sparse")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return r.bm25(table(spark, sf, "documents"), benchmark(spark, sf))


_VALUE = {
    "reciprocal_rank": ("1 / (60.0 + rank)::double", "sum(v)"),
    "relative_score": ("case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end", "sum(v / 2)"),
    "dist_based_score": ("case when stddev_pop(score) over w = 0 then 1.0 else greatest(0, least(1, (score - (avg(score) over w - 3 * stddev_pop(score) over w)) / (6 * stddev_pop(score) over w))) end", "sum(v / 2)"),
    "simple": ("score", "max(v)"),
}


def _fusion(mode: str, name: str) -> None:
    value, total = _VALUE[mode]
    sql = f"""with {_DVEC}, {_WORDS}, {_LISTS}, f as (select query_id, doc_id, {value} as v from l window w as (partition by query_id, list)),
s as (select query_id, doc_id, round({total}, 6) as score from f group by all)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 6"""
    query(name, sql)(lambda spark, sf: r.fuse(both_lists(spark, sf), mode, 2))


for _mode, _name in (("reciprocal_rank", "fuse_rrf"), ("relative_score", "fuse_relative"), ("dist_based_score", "fuse_dist"), ("simple", "fuse_simple")):
    _fusion(_mode, _name)

_HYBRID = f"""h as (select query_id, doc_id, (case when list = 'd' then 0.5 else 0.5 end) * {_VALUE["relative_score"][0]} as v from l window w as (partition by query_id, list)),
hs as (select query_id, doc_id, round(sum(v), 6) as score from h group by all),
hybrid as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from hs qualify rank <= 6)"""


def hybrid_hits(spark: SparkSession, sf: str) -> DataFrame:
    return r.hybrid(dense_hits(spark, sf), word_hits(spark, sf))


@query("hybrid_topk", f"with {_DVEC}, {_WORDS}, {_LISTS}, {_HYBRID} select * from hybrid")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_hits(spark, sf)


@query("confidence_gate", f"""with {_DVEC}, q as (select doc_id as query_id from documents where doc_id % 50 = 0)
select q.query_id, count(dense.doc_id)::bigint as n_hits, max(score) as top_score, count(dense.doc_id) = 0 or coalesce(max(score) < 0.5, false) as refused from q left join dense using (query_id) group by 1""")
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return r.gate(table(spark, sf, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id")), dense_hits(spark, sf), 0.5)


@query("top_sources", f"""with {_DVEC} select query_id, string_agg(rank || ':' || source || '#' || md5(text), '|' order by rank) as shown from dense join documents using (doc_id) where rank <= 3 group by 1""")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("web/"), "source").alias("path"), F.lit(None).cast("int").alias("chunk_id"), F.md5(F.col("text").cast("binary")).alias("content"))
    s = r.sources(dense_hits(spark, sf), d, 3)
    return s.select("query_id", F.array_join(F.transform("sources", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["source"], F.lit("#"), x["content"])), "|").alias("shown"))


_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)


@query("variant_expand", f"""with b as (select item_id as query_id, text, list_filter({sql_tokens("text")}, lambda x: length(x) > 1 and x not in ({_STOP})) as c0 from benchmark),
o as (select query_id, text, list_filter(c0, lambda x, i: list_position(c0, x) = i) as c from b)
select query_id, unnest([0, 1, 2, 3]) as variant_no, unnest([text, {sql_norm("text")}, array_to_string(c, ' '), array_to_string(c[1:greatest(1, ceil(len(c) / 2.0)::int)], ' ')]) as text from o""")
def variant_expand(spark: SparkSession, sf: str) -> DataFrame:
    return r.variants(benchmark(spark, sf))


@query("prompt_context", f"""with {_BM25}, c as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as c from sparse join documents using (doc_id) group by 1)
select item_id as query_id, 'Answer from the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Question: ' || text as prompt from benchmark left join c on item_id = query_id""")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25_topk(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return r.prompt(benchmark(spark, sf), hits)


@query("index_fingerprint", """with h as (select sha256(doc_id || chr(1) || text) as h from documents), g as (select substr(h, 1, 3) as r, sha256(string_agg(h, '' order by h)) as h, count(*) as n from h group by 1)
select sha256('model' || chr(1) || 'true' || chr(1) || string_agg(h, '' order by r)) as fingerprint, sum(n)::bigint as n_nodes from g""")
def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return r.fingerprint(table(spark, sf, "documents"), "model", True)


_TURNS = "turns as (select conv_id, turn, text as question, answer from (select *, lead(text) over (partition by conv_id order by turn) as answer from conversations) where role = 'user')"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return generation.turns(table(spark, sf, "conversations"))


@query("session_titles", r"""select conv_id, case when length(t) > 48 then t[1:48] || '...' else t end as title from (select conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) as t from conversations where role = 'user' group by 1)""")
def session_titles(spark: SparkSession, sf: str) -> DataFrame:
    return generation.session_titles(table(spark, sf, "conversations"))


@query("extractive_answer", rf"""with {_TURNS}, s as (select conv_id, turn, question, unnest(regexp_extract_all(answer, '[^.!?\n]+[.!?]?')) as s, generate_subscripts(regexp_extract_all(answer, '[^.!?\n]+[.!?]?'), 1) as n from turns where answer is not null),
o as (select *, len(list_intersect(list_distinct({sql_tokens("s")}), list_distinct({sql_tokens("question")}))) as hit from s)
select conv_id, turn, trim(s) as answer from o qualify row_number() over (partition by conv_id, turn order by hit desc, n) = 1""")
def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return generation.extract(turns(spark, sf).filter("answer is not null"))


_FACTS = r"""f as (select doc_id, 'HAS_PHONE' as relation, unnest(list_distinct(regexp_extract_all(text, '\+?\d[\d ().-]{7,}\d'))) as target from documents
union all select doc_id, 'HAS_EMAIL', unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+'))) from documents
union all select doc_id, 'HAS_YEAR', unnest(list_distinct(regexp_extract_all(text, '\b20\d{2}\b'))) from documents)"""


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return facts.relations(table(spark, sf, "documents"))


@query("fact_rules", rf"with {_FACTS} select doc_id, relation, trim(regexp_replace(target, '\s+', ' ', 'g'), ' -;') as target from f where trim(target, ' -;') <> '' group by all")
def fact_rules(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).select("doc_id", "relation", "target")


@query("fact_entities", rf"""with {_FACTS}, c as (select doc_id, relation, trim(regexp_replace(target, '\s+', ' ', 'g'), ' -;') as target from f)
select doc_id, target as name, min(relation)[5:] as label from c where target <> '' group by doc_id, target union all select doc_id, source, 'SOURCE' from documents where doc_id in (select doc_id from c where target <> '')""")
def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    return facts.entities(relations(spark, sf))


@query("fact_sentences", rf"""with {_FACTS}, c as (select distinct doc_id, relation, trim(regexp_replace(target, '\s+', ' ', 'g'), ' -;') as target from f)
select doc_id, source || ' ' || (case relation when 'HAS_PHONE' then 'có số điện thoại' when 'HAS_EMAIL' then 'has email' else 'áp dụng cho năm' end) || ' ' || target || '. Bối cảnh: ' || source as text from c join documents using (doc_id) where target <> ''""")
def fact_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return facts.sentences(relations(spark, sf)).select("doc_id", "text")


@query("fact_fallback", f"with {_FACTS} select doc_id, 'FALLBACK_CHUNK' as relation_label, length(text)::bigint as n_chars from documents where doc_id not in (select doc_id from f) and trim(text) <> ''")
def fact_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return facts.fallback(table(spark, sf, "documents"), relations(spark, sf)).select("doc_id", "relation_label", F.length("text").cast("long").alias("n_chars"))


@query("score_unpivot", """select p_partkey as id, unnest(['size', 'price']) as metric, unnest([p_size::double, p_retailprice]) as value from part""")
def score_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("id", ["size", "price"], "metric", "value").filter("value is not null")
