"""Facts by rules: relations, entities, sentences, and chunks that no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions.text import clean_name, uuid5_url

# Rules as (relation, pattern) and the phrases of relations.
RULES = (("HAS_PHONE", r"\+?\d[\d ().-]{7,}\d"), ("HAS_EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"), ("HAS_YEAR", r"\b20\d{2}\b"))
PHRASES = {
    "HAS_PHONE": "có số điện thoại",
    "HAS_YEAR": "áp dụng cho năm",
    "HAS_SOURCE_FILE": "có nguồn tài liệu",
    "HAS_ADMISSION_CODE": "có mã tuyển sinh là",
    "LOCATED_AT": "đặt tại",
    "HAS_CONTACT_PHONE": "có số điện thoại liên hệ",
    "HAS_WEBSITE": "có website",
    "USES_METHOD": "sử dụng phương thức tuyển sinh",
    "HAS_ADMISSION_YEAR": "có thông tin tuyển sinh năm",
    "APPLIES_TO_YEAR": "áp dụng cho năm",
    "HAS_MAJOR_CODE": "có mã ngành",
    "HAS_QUOTA": "có thông tin chỉ tiêu",
    "HAS_SUBJECT_COMBINATION": "có tổ hợp xét tuyển",
    "HAS_ENGLISH_REQUIREMENT": "có điều kiện tiếng Anh",
    "HAS_SCORE_FACT": "có thông tin điểm chuẩn",
}
METHOD = r"(?s)Phương thức (\d+):\s*(.*?)(?=\s*-?\s*Phương thức \d+:|\z)"


def relations(chunks: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, relation, target and ord: each relation of a chunk once, in the order of the rules."""

    def named(relation: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(relation).alias("relation"), clean_name(x).alias("target")))

    found = F.concat(*[named(*r) for r in rules])
    rows = chunks.select(key, F.col(source).alias("source"), F.posexplode(F.array_distinct(found)).alias("ord", "x"))
    return rows.select(key, "source", "x.relation", "x.target", "ord").filter("target <> ''")


def entities(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name and label of what a chunk's relations name; the first writer's label stays."""
    targets = found.groupBy(key, F.col("target").alias("name")).agg(F.min("relation").alias("label")).select(key, "name", F.substring("label", 5, 100).alias("label"))
    return targets.unionByName(found.select(key, F.col("source").alias("name"), F.lit("SOURCE").alias("label")).distinct())


def sentences(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, id and text: a sentence for each relation."""
    phrase = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv]), F.col("relation")), F.lower(F.replace("relation", F.lit("_"), F.lit(" "))))
    text = F.concat("source", F.lit(" "), phrase, F.lit(" "), "target", F.lit(". Bối cảnh: "), "source")
    node = F.concat_ws(":", F.col(key).cast("string"), "source", "relation", "target")
    return found.select(key, uuid5_url(node).alias("id"), text.alias("text"), F.col("relation").alias("relation_label"), F.lit("relation").alias("fact_type"))


def fallback(chunks: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks without a relation, as facts of their own."""
    rest = chunks.join(found.select(key).distinct(), key, "left_anti").filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return rest.select(key, text, F.lit("FALLBACK_CHUNK").alias("relation_label"), F.lit("chunk_fallback").alias("fact_type"))


def methods(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, number and description of each `Phương thức N: ...`."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(METHOD), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(METHOD), F.lit(2)).alias("d"))
    return df.select(key, F.explode(both).alias("x")).select(key, F.col("x.n").cast("int").alias("method"), clean_name(F.col("x.d")).alias("description"))


def carried_group(rows: DataFrame, doc: str, order: str, group: str) -> DataFrame:
    """Each row with the last group row at or before it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(group, True).over(w))
