"""Queries of the fact rules: prose and table rows to relations, entities and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators import fact_rules
from ragframe.plans.registry import query, table

RULES = fact_rules.Rules("School", ("Địa chỉ",))

_CLEAN = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' -;')"
_ALL = lambda pattern: f"list_distinct(regexp_extract_all(text, '{pattern}'))"
_PROSE = rf"""d as (select doc_id, source, lang, text, case when doc_id % 2 = 0 then '2024' else 'unknown' end as year from documents),
r as (select doc_id, 'School' as source, 'HAS_SOURCE_FILE' as relation, source || '.txt' as target from d
union all select doc_id, 'School', 'HAS_ADMISSION_CODE', 'TS' || doc_id from d
union all select doc_id, 'School', 'LOCATED_AT', {_CLEAN("source")} from d
union all select doc_id, 'School', 'HAS_CONTACT_PHONE', unnest(list_transform({_ALL(r"0\d[\d.\s]{7,}\d")}, lambda p: {_CLEAN("replace(p, ' ', '')")})) from d
union all select doc_id, 'School', 'HAS_WEBSITE', unnest(list_transform({_ALL(r"https?://[^\s)]+")}, lambda p: {_CLEAN("p")})) from d
union all select doc_id, 'School', 'HAS_ADMISSION_YEAR', year from d where year <> 'unknown'
union all select doc_id, 'School', 'USES_METHOD', unnest(['Phương thức 1: ' || lang, 'Phương thức 2: hai']) from d
union all select doc_id, unnest(['Phương thức 1: ' || lang, 'Phương thức 2: hai']), 'APPLIES_TO_YEAR', year from d where year <> 'unknown')"""


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document below a code and an address and above two methods."""
    text = F.concat(F.lit("Mã trường: TS"), F.col("doc_id").cast("string"), F.lit("\nĐịa chỉ trụ sở: "), "source", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n- Phương thức 1: "), "lang", F.lit("\n- Phương thức 2: hai X"))
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"), F.lit("section").alias("record_type"), F.when(F.col("doc_id") % 2 == 0, "2024").otherwise("unknown").alias("source_year"), F.concat("source", F.lit(".txt")).alias("source_file"))
    return fact_rules.extracted(d, RULES)


@query("graph_relations", f"with {_PROSE} select distinct * from r")
def graph_relations(spark: SparkSession, sf: str) -> DataFrame:
    return fact_rules.graph_relations(prose(spark, sf)).select("doc_id", "source", "relation", "target")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rows of quota, subject and score tables in turn."""
    k = F.col("p_partkey")
    code = F.concat((k + 7000000).cast("string"), F.lit("A"))
    name, size = F.concat(F.lit("P"), k.cast("string")), F.col("p_size").cast("string")
    quota = F.concat(F.lit("- TT | Mã | Tên | Mã ngành | Chỉ tiêu | x | Phương thức\n- I | Nhóm\n- 1 | "), code, F.lit(" | "), name, F.lit(" | 7480201 | "), size, F.lit(" | x | Phương thức 1: a - Phương thức 2: b X"))
    subject = F.concat(F.lit("- STT | Mã | Tên | Tổ hợp xét tuyển | TA\n- 1 | "), code, F.lit(" | "), name, F.lit(" | Toán, Lý | X"))
    score = F.concat(F.lit("- TT | Mã | Tên | Điểm thi | Điểm thi | ĐGNL | ĐGNL | TA\n- 1 | "), code, F.lit(" | "), name, F.lit(" | "), size, F.lit(" | - | 800 |  | 6"))
    text = F.when(k % 3 == 0, quota).when(k % 3 == 1, subject).otherwise(score)
    p = table(spark, sf, "part").select(k.alias("doc_id"), text.alias("text"), F.lit("table_row").alias("record_type"), F.lit("2025").alias("source_year"), F.lit("f.txt").alias("source_file"))
    return fact_rules.extracted(p, RULES)


_ROWS = """x as (select p_partkey as doc_id, 'P' || p_partkey as p, (p_partkey + 7000000) || 'A' as code, p_size::varchar as size from part),
r as (select doc_id, p as source, unnest(['HAS_ADMISSION_CODE', 'APPLIES_TO_YEAR']) as relation, unnest([code, '2025']) as target from x
union all select doc_id, p, unnest(['HAS_MAJOR_CODE', 'HAS_QUOTA', 'USES_METHOD', 'USES_METHOD']), unnest(['7480201', 'Chỉ tiêu ' || p || ' năm 2025: ' || size, 'Phương thức 1: a', 'Phương thức 2: b']) from x where doc_id % 3 = 0
union all select doc_id, unnest(['Phương thức 1: a', 'Phương thức 2: b']), 'APPLIES_TO_YEAR', '2025' from x where doc_id % 3 = 0
union all select doc_id, p, unnest(['HAS_SUBJECT_COMBINATION', 'HAS_ENGLISH_REQUIREMENT']), unnest(['Tổ hợp xét tuyển ' || p || ' năm 2025: Toán, Lý', 'Điều kiện tiếng Anh ' || p || ' năm 2025: X']) from x where doc_id % 3 = 1
union all select doc_id, p, 'HAS_SCORE_FACT', p || ' - ' || unnest(['Điểm thi THPT 2025 (hệ số 1): ' || size, 'Điểm ĐGNL ĐHQG-HCM 2025: 800', 'Điều kiện tiếng Anh 2025: 6']) from x where doc_id % 3 = 2)"""


@query("table_row_facts", f"with {_ROWS} select distinct * from r")
def table_row_facts(spark: SparkSession, sf: str) -> DataFrame:
    return fact_rules.graph_relations(rows(spark, sf)).select("doc_id", "source", "relation", "target")


@query("graph_entities", f"""with {_ROWS} select distinct doc_id, target as name, case relation when 'HAS_ADMISSION_CODE' then 'PROGRAM_CODE' when 'APPLIES_TO_YEAR' then 'YEAR' when 'HAS_MAJOR_CODE' then 'MAJOR_CODE' when 'HAS_QUOTA' then 'QUOTA_FACT' when 'USES_METHOD' then 'ADMISSION_METHOD'
when 'HAS_SUBJECT_COMBINATION' then 'SUBJECT_COMBINATION' when 'HAS_ENGLISH_REQUIREMENT' then 'ENGLISH_REQUIREMENT' else 'SCORE_FACT' end as label from r union select doc_id, p, 'PROGRAM' from x""")
def graph_entities(spark: SparkSession, sf: str) -> DataFrame:
    return fact_rules.graph_entities(rows(spark, sf))


@query("graph_facts", f"""with {_PROSE} select distinct doc_id, r.source || ' ' || (case relation when 'HAS_SOURCE_FILE' then 'có nguồn tài liệu' when 'HAS_ADMISSION_CODE' then 'có mã tuyển sinh là' when 'LOCATED_AT' then 'đặt tại' when 'HAS_CONTACT_PHONE' then 'có số điện thoại liên hệ'
when 'HAS_WEBSITE' then 'có website' when 'HAS_ADMISSION_YEAR' then 'có thông tin tuyển sinh năm' when 'USES_METHOD' then 'sử dụng phương thức tuyển sinh' else 'áp dụng cho năm' end) || ' ' || target || '. Bối cảnh: ' || d.source || '.txt' as text, 'relation' as fact_type from r join d using (doc_id)""")
def graph_facts(spark: SparkSession, sf: str) -> DataFrame:
    return fact_rules.graph_facts(prose(spark, sf)).select("doc_id", "text", "fact_type")
