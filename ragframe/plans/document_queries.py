"""Queries of sections and chunks of marked-up documents, whole evaluation rows, file round trips and the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators import assessment, index, retrieval, sections, structure
from ragframe.operators.chunking import PROFILES, Profile
from ragframe.operators.embed import hashing_column
from ragframe.plans.registry import query, table
from ragframe.session import shared_folder
from ragframe.sources import jsonl, records, sinks


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the light mark-up: title, source, the text by lines below nested headings, and a table."""
    text = F.concat(
        F.lit("# "), "source", F.lit("\nSource: https://example.org/"), F.col("doc_id").cast("string"), F.lit("\n\n## I. Body\n### Text\n"), F.coalesce("text", F.lit("")),
        F.lit("\n### Code: "), F.col("doc_id").cast("string"), F.lit("\n### Note\nshort\n### Bang 1\n- code | name | items\n- I | first group\n- 1 | a | 1. "), F.coalesce("lang", F.lit("")), F.lit(" 2. "), "source", F.lit("\n- 2 | b | none\n\nafter the table\n"),
    )
    return table(spark, sf, "documents").filter("doc_id is not null").withColumn("text", text)


def _digest(c: str):
    return F.md5(F.col(c).cast("binary")).alias("digest")


@query("sections_nested")
def sections_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Every section as one chunk, whatever its length: nothing merges, nothing is cut."""
    c = sections.chunked(marked(spark, sf), Profile(0, 1 << 30, 1))
    return c.select("doc_id", "chunk_id", F.array_join("heading_path", " > ").alias("path"), _digest("text"))


@query("chunk_emit_a")
def chunk_emit_a(spark: SparkSession, sf: str) -> DataFrame:
    return sections.chunked(marked(spark, sf), PROFILES["balanced"]).withColumn("digest", _digest("text")).drop("text", "heading_path")


@query("chunk_emit_b")
def chunk_emit_b(spark: SparkSession, sf: str) -> DataFrame:
    return sections.chunked(marked(spark, sf), PROFILES["graph"], "b").withColumn("digest", _digest("text")).drop("text", "heading_path")


@query("section_merge_b")
def section_merge_b(spark: SparkSession, sf: str) -> DataFrame:
    """Merged sections of variant B, not cut: rows of tables stand alone."""
    c = sections.chunked(marked(spark, sf), Profile(900, 1 << 30, 5), "b")
    return c.select("doc_id", "chunk_id", "record_type", "char_count")


@query("long_split")
def long_split(spark: SparkSession, sf: str) -> DataFrame:
    """How the table rows and over-long lines of each document are cut at 200 characters."""
    return sections.chunked(marked(spark, sf), Profile(0, 200, 1)).select("doc_id", "chunk_id", "char_count", _digest("text"))


@query("record_summary")
def record_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sections.record_summary(sections.chunked(marked(spark, sf), PROFILES["balanced"]))


@query("node_metadata")
def node_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = marked(spark, sf)
    info = docs.select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("source_url"), F.lit("2024").alias("year"), F.lit("web").alias("source_group"), F.concat(F.lit("web/"), "source", F.lit(".txt")).alias("relative_path")).dropDuplicates(["doc_id"])
    return sections.node_metadata(sections.chunked(docs, PROFILES["max"]), info).select("doc_id", "chunk_id", F.to_json("metadata").alias("metadata"))


@query("finalize_document")
def finalize_document(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("doc_id is not null")
    done = structure.finalized(structure.lines(docs), docs.select("doc_id", F.col("source").alias("title")), "doc_id")
    return done.select("doc_id", _digest("text"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("txt_roundtrip", "select 'web/' || doc_id || '.txt' as path, doc_id, md5(text) as digest, length(text)::bigint as n_chars from documents where text is not null")
def txt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and read back as chunk records."""
    docs = table(spark, sf, "documents").filter("text is not null")
    at = _place(spark, "roundtrip")
    sinks.to_jsonl(docs.select(F.col("doc_id").cast("int").alias("chunk_id"), F.concat(F.lit("web/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("source").alias("title"), "text"), at)
    back = spark.read.schema(jsonl.CHUNK).json(at)
    return back.select(F.col("relative_path").alias("path"), F.col("chunk_id").cast("long").alias("doc_id"), _digest("text"), F.length("text").cast("long").alias("n_chars"))


@query("index_lifecycle", "select count(*)::bigint as n_nodes, count(distinct source)::bigint as n_files, true as built, true as kept, true as rebuilt from documents join embeddings on doc_id = vec_id")
def index_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """An index built, found again, and built anew when its nodes change."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    nodes = table(spark, sf, "documents").join(v, "doc_id").select("doc_id", "text", "embedding", F.lit("").alias("relative_path"), F.col("source").alias("source_file"))
    at = _place(spark, "index")
    first, built = index.ensure(spark, at, nodes, "model")
    n, n_files = first.count(), index.files(first).count()
    kept = not index.ensure(spark, at, nodes, "model")[1]
    rebuilt = index.ensure(spark, at, nodes, "other")[1]
    return spark.createDataFrame([(n, n_files, built, kept, rebuilt)], "n_nodes long, n_files long, built boolean, kept boolean, rebuilt boolean")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions: the answer is the first sentence of the best hit, the reference that of the question."""
    asked = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    hits = retrieval.bm25(docs, asked, 5).join(docs, "doc_id")
    source = F.struct("rank", F.col("source").alias("label"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("doc"))
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("s"))
    sentence = lambda c: F.regexp_extract(c, r"^([^.!?\n]*[.!?]?)", 1)
    sources = F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["content"].alias("content"), F.create_map(F.lit("doc"), x["doc"]).alias("metadata")))
    words = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 5), 1, 4)
    x = asked.join(own, "query_id", "left")
    return x.select(F.col("query_id").alias("example_id"), F.col("text").alias("question"), sentence(F.col("text")).alias("reference"), F.coalesce(sentence(F.get("s", F.lit(0))["content"]), F.lit("")).alias("answer"), words.alias("keywords"), F.slice(words, 1, 2).alias("answer_keywords"),
                    F.array(F.get("s", F.lit(0))["label"]).alias("hints"), F.lit(False).alias("refusal_expected"), sources.alias("sources"), (F.col("query_id") % 7 * 5000.0).alias("latency_ms"), F.when(F.col("query_id") % 11 == 0, "timeout").alias("error"))


@query("evaluate_rows")
def evaluate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return assessment.evaluated(predictions(spark, sf), lambda c: hashing_column(c, 32))


@query("measure_summary")
def measure_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate_rows(spark, sf).withColumn("bucket", (F.col("example_id") % 3).cast("string"))
    return assessment.summarised(rows, ("bucket",), 25_000.0)


@query("judgment_report", """with x as (select 'quality' as field, a.quality as l, case when doc_id % 5 = 0 then 0 else quality end as r from labels a union all select 'toxic', toxic, case when doc_id % 3 = 0 then 1 else toxic end from labels),
t as (select field, l, r, count(*) as c from x where l is not null and r is not null group by all), n as (select field, sum(c) as n, sum(case when l = r then c else 0 end) as same from t group by 1),
e as (select p.field, sum(p.c * q.c)::double as x from (select field, l, sum(c) as c from t group by all) p join (select field, r, sum(c) as c from t group by all) q on p.field = q.field and p.l = q.r group by 1)
select field, n::bigint as n, round(same / n::double, 4) as agreement, round((same / n::double - x / (n::double * n)) / (1 - x / (n::double * n)), 4) as kappa from n join e using (field)""")
def judgment_report(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "labels").withColumn("system", F.lit("s")).withColumnRenamed("doc_id", "example_id")
    b = a.withColumn("quality", F.when(F.col("example_id") % 5 == 0, 0).otherwise(F.col("quality"))).withColumn("toxic", F.when(F.col("example_id") % 3 == 0, 1).otherwise(F.col("toxic")))
    return assessment.judged(a, b, ("quality", "toxic"))


def _written_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines in the folders of two groups, read back as records."""
    at = _place(spark, "chunks")
    d = table(spark, sf, "documents").select((F.col("doc_id") + 1).cast("int").alias("chunk_id"), F.col("source").alias("title"), F.lit("Bang 1").alias("heading_path"), "text")
    for group, rest in (("web", 0), ("2024", 1)):
        sinks.to_jsonl(d.filter((F.col("chunk_id") - 1) % 2 == rest), f"{at}/{group}")
    return records.records(records.numbered_lines(spark, at, glob="*.json"), at)


@query("chunk_files", "select case when doc_id % 2 = 0 then 'web' else '2024' end as source_group, doc_id, source as title, 'table_row' as record_type, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))::bigint as char_count from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    x = _written_chunks(spark, sf)
    return x.select("source_group", (F.col("chunk_id") - 1).cast("long").alias("doc_id"), "title", "record_type", "char_count")


@query("chunk_group_by_file", "select case when doc_id % 2 = 0 then 'web' else '2024' end as source_group, count(*)::bigint as n_chunks from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1")
def chunk_group_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the files of each group."""
    files = records.by_file(_written_chunks(spark, sf))
    return files.groupBy(F.substring_index("relative_path", "/", 1).alias("source_group")).agg(F.sum("n_chunks").alias("n_chunks"))
