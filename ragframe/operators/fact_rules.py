"""Facts of chunks by rules: of prose in general, and of quota, subject and score rows of tables. All are expressions of one row.

A chunk has a key, text, record_type, source_year and source_file, and may have heading_path and title.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import clean_name, uuid5_url
from ragframe.operators.facts import PHRASES

# Patterns, the words that tell kinds of rows apart, and the names of scores with their cells.
SCHOOL_CODE = r"(?iU)(?:Mã cơ sở đào tạo trong tuyển sinh|Mã trường)\s*:\s*([A-Z0-9]+)"
ADDRESS = r"(?iU)Địa chỉ trụ sở:\s*(.+)"
PHONE = r"(0\d[\d.\s]{7,}\d)"
WEBSITE = r"https?://[^\s)]+"
METHOD = r"(?isU)Phương thức\s*(\d)\s*:\s*(.*?)(?=-\s*Phương thức\s*\d\s*:|\z)"
CODE, VALUE, YEAR = r"^[0-9]{6,}[A-Z]*$", r"^[0-9]+(?:[.,][0-9]+)?$", r"20\d{2}"
HEADER_CELLS = ("TT", "STT", "(1)", "(2)")
GROUP, SUBGROUP = r"^[IVX]+$", r"^\d+\.\d+$"
SUBJECTS = ("Toán", "Ngữ văn", "Tiếng Anh")
ENGLISH = ("X", "X; X")
SCORE_FILE = "diem-trung-tuyen"
SCORES = {
    "2025": (8, (("Điểm thi THPT 2025 (hệ số 1)", 3), ("Điểm thi THPT 2025 (hệ số 2 hoặc tiếng Anh hệ số 2)", 4), ("Điểm ĐGNL ĐHQG-HCM 2025", 5), ("Điểm ĐGNL ĐHQG-HN 2025", 6), ("Điều kiện tiếng Anh 2025", 7))),
    "2024": (11, (("Điểm thi THPT 2024", 4), ("Điểm tiếng Anh thi THPT 2024", 5), ("Điểm học bạ THPT 2024", 7), ("Điểm tiếng Anh học bạ 2024", 8), ("Điểm ĐGNL 2024", 9), ("Điểm tiếng Anh ĐGNL 2024", 10))),
}

_NONE = "array<struct<source:string,source_label:string,relation:string,target:string,target_label:string>>"


@dataclass(frozen=True)
class Rules:
    """Whom general facts are about, and words that show that a text is about it."""

    institution: str = "Institution"
    markers: tuple[str, ...] = ()


def _fact(source: Column, kind: str, relation: str, target: Column, target_kind: str) -> Column:
    return F.struct(clean_name(source).alias("source"), F.lit(kind).alias("source_label"), F.lit(relation).alias("relation"), clean_name(target).alias("target"), F.lit(target_kind).alias("target_label"))


def _if(condition: Column, *facts: Column) -> Column:
    return F.when(condition, F.array(*facts)).otherwise(F.array().cast(_NONE))


def _named(prefix: str, name: Column, year: Column, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix} "), name, F.when(_known(year), F.concat(F.lit(" năm "), year)).otherwise(""), F.lit(": "), value)


def _known(year: Column) -> Column:
    return F.coalesce(~year.isin("", "unknown"), F.lit(False))


def methods(text: Column) -> Column:
    """`Phương thức N: description` for each method that a text describes."""
    flat = F.translate(text, "\n", " ")
    both = F.zip_with(F.regexp_extract_all(flat, F.lit(METHOD), F.lit(1)), F.regexp_extract_all(flat, F.lit(METHOD), F.lit(2)), lambda n, d: F.struct(n.alias("n"), F.trim(F.regexp_replace(clean_name(d), r"\s+X$", "")).alias("d")))
    return F.transform(F.filter(both, lambda m: m["d"] != ""), lambda m: F.concat(F.lit("Phương thức "), m["n"], F.lit(": "), m["d"]))


def _method_facts(found: Column, source: Column, kind: str, year: Column) -> Column:
    each = lambda m: F.concat(_if(F.lit(True), _fact(source, kind, "USES_METHOD", m, "ADMISSION_METHOD")), _if(_known(year), _fact(m, "ADMISSION_METHOD", "APPLIES_TO_YEAR", year, "YEAR")))
    return F.flatten(F.transform(found, each))


def general(text: Column, year: Column, file: Column, rules: Rules) -> Column:
    """What prose tells of the institution: its file, code, address, phones, sites and methods."""
    who, kind = F.lit(rules.institution), "INSTITUTION"
    about = F.lit(False)
    for word in rules.markers:
        about = about | F.contains(text, F.lit(word))
    one = lambda pattern: F.regexp_extract(text, pattern, 1)
    each = lambda values, relation, label: F.transform(values, lambda v: _fact(who, kind, relation, v, label))
    phones = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(1)), lambda p: F.replace(F.trim(p), F.lit(" "), F.lit(""))))
    found = methods(text)
    return F.concat(
        _if(about, _fact(who, kind, "HAS_SOURCE_FILE", F.coalesce(F.nullif(file, F.lit("")), who), "SOURCE")),
        _if(one(SCHOOL_CODE) != "", _fact(who, kind, "HAS_ADMISSION_CODE", one(SCHOOL_CODE), "ADMISSION_CODE")),
        _if(one(ADDRESS) != "", _fact(who, kind, "LOCATED_AT", one(ADDRESS), "ADDRESS")),
        each(phones, "HAS_CONTACT_PHONE", "CONTACT_PHONE"),
        each(F.regexp_extract_all(text, F.lit(WEBSITE), F.lit(0)), "HAS_WEBSITE", "WEBSITE"),
        _if((F.size(found) > 0) & _known(year), _fact(who, kind, "HAS_ADMISSION_YEAR", year, "YEAR")),
        _method_facts(found, who, kind, year),
    )


def _first(values: Column, test) -> Column:
    return F.coalesce(F.get(F.filter(values, test), F.lit(0)), F.lit(""))


def _program(c: Column, code: Column) -> Column:
    """The name after the code; without one the first cell with a letter that is neither a method nor a subject."""
    at = F.array_position(c, code).cast("int")
    after = F.filter(F.slice(c, at + 1, F.size(c)), lambda v: (v != "") & (v != code) & ~v.rlike(CODE) & ~v.rlike(VALUE))
    any_name = F.filter(c, lambda v: v.rlike(r"\p{L}") & ~v.contains("Phương thức") & ~v.contains("Toán"))
    return F.coalesce(F.when(at > 0, F.get(after, F.lit(0))), F.get(any_name, F.lit(0)), F.lit(""))


def quota_row(c: Column, code: Column, name: Column, year: Column) -> Column:
    """A row of seven cells or more with a code: its codes, year, quota (the first number after the last of two codes) and methods."""
    codes = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.get(c, i).rlike(CODE))
    second = F.get(codes, F.lit(1))
    major = F.coalesce(F.get(c, second), F.lit(""))
    start = F.coalesce(second, F.array_position(c, code).cast("int") - 1) + 2
    quota = _first(F.slice(c, start, F.size(c)), lambda v: v.rlike(VALUE))
    facts = F.concat(
        _if(F.lit(True), _fact(name, "PROGRAM", "HAS_ADMISSION_CODE", code, "PROGRAM_CODE")),
        _if(_known(year), _fact(name, "PROGRAM", "APPLIES_TO_YEAR", year, "YEAR")),
        _if((major != "") & (major != code), _fact(name, "PROGRAM", "HAS_MAJOR_CODE", major, "MAJOR_CODE")),
        _if(quota != "", _fact(name, "PROGRAM", "HAS_QUOTA", _named("Chỉ tiêu", name, year, quota), "QUOTA_FACT")),
        _method_facts(methods(F.array_join(c, " ")), name, "PROGRAM", year),
    )
    return F.when((F.size(c) >= 7) & (code != "") & (name != ""), facts)


def subject_row(c: Column, code: Column, name: Column, year: Column) -> Column:
    """A row's code, year, subjects (the first cell that names one) and English requirement (the last mark or number)."""
    subjects = _first(c, lambda v: v.contains(SUBJECTS[0]) | v.contains(SUBJECTS[1]) | v.contains(SUBJECTS[2]))
    english = _first(F.reverse(c), lambda v: v.isin(*ENGLISH) | v.rlike(VALUE))
    facts = F.concat(
        _if(code != "", _fact(name, "PROGRAM", "HAS_ADMISSION_CODE", code, "PROGRAM_CODE")),
        _if(_known(year), _fact(name, "PROGRAM", "APPLIES_TO_YEAR", year, "YEAR")),
        _if(subjects != "", _fact(name, "PROGRAM", "HAS_SUBJECT_COMBINATION", _named("Tổ hợp xét tuyển", name, year, subjects), "SUBJECT_COMBINATION")),
        _if(english != "", _fact(name, "PROGRAM", "HAS_ENGLISH_REQUIREMENT", _named("Điều kiện tiếng Anh", name, year, english), "ENGLISH_REQUIREMENT")),
    )
    return F.when(name != "", facts)


def score_row(c: Column, header: Column, year: Column, file: Column) -> Column:
    """A row of four cells or more: its code, year and the scores that tables of that year have. The year is the chunk's, else the
    first in the header, the cells or the file's name."""
    in_file = F.when(file.contains("2025"), "2025").when(file.contains("2024"), "2024").when(file.contains(SCORE_FILE), "2025").otherwise("")
    found = lambda x: F.nullif(F.regexp_extract(x, YEAR, 0), F.lit(""))
    when = F.coalesce(F.when(_known(year), year), found(header), found(F.array_join(c, " ")), in_file)
    name, code = F.coalesce(F.get(c, F.lit(2)), F.lit("")), F.coalesce(F.get(c, F.lit(1)), F.lit(""))
    scores = []
    for y, (least, metrics) in SCORES.items():
        for label, i in metrics:
            v = F.coalesce(F.get(c, F.lit(i)), F.lit(""))
            scores.append(_if((when == y) & (F.size(c) >= least) & (v != ""), _fact(name, "PROGRAM", "HAS_SCORE_FACT", F.concat(name, F.lit(f" - {label}: "), v), "SCORE_FACT")))
    facts = F.concat(
        _if(code.rlike(CODE), _fact(name, "PROGRAM", "HAS_ADMISSION_CODE", code, "PROGRAM_CODE")),
        _if(when != "", _fact(name, "PROGRAM", "APPLIES_TO_YEAR", when, "YEAR")),
        *scores,
    )
    return F.when((F.size(c) >= 4) & (name != ""), facts)


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^- ", ""), r"\|"), clean_name)


def table_rows(text: Column, year: Column, file: Column) -> Column:
    """Facts of the rows of a table: each data row is a score, quota or subject row by its header, or gives nothing."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.startswith("- ") & x.contains(" | "))
    is_header = lambda x: F.upper(F.get(_cells(x), F.lit(0))).isin(*HEADER_CELLS) | x.startswith("- (")
    header = F.array_join(F.filter(lines, is_header), " ")
    data = F.transform(F.filter(lines, lambda x: ~is_header(x)), _cells)
    filled = lambda c: F.size(F.filter(c, lambda v: v != ""))
    data = F.filter(data, lambda c: ~F.get(c, F.lit(0)).rlike(GROUP) & ~(F.get(c, F.lit(0)).rlike(SUBGROUP) & (filled(c) <= 3)))
    coded = F.transform(data, lambda c: F.struct(c.alias("c"), _first(c, lambda v: v.rlike(CODE)).alias("code")))
    named = F.transform(coded, lambda x: F.struct(x["c"].alias("c"), x["code"].alias("code"), _program(x["c"], x["code"]).alias("name")))
    is_score = F.coalesce(file.contains(SCORE_FILE), F.lit(False)) | (header.contains("ĐGNL") & (header.contains("Điểm thi") | header.contains("Điểm chuẩn")))
    is_quota = lambda c: header.contains("Chỉ tiêu") & F.exists(c, lambda v: v.contains("Phương thức"))
    is_subject = lambda c: header.contains("Tổ hợp xét tuyển") & (F.size(c) >= 5)
    facts = lambda x: (
        F.when(is_score, score_row(x["c"], header, year, file))
        .when(is_quota(x["c"]), quota_row(x["c"], x["code"], x["name"], year))
        .when(is_subject(x["c"]), subject_row(x["c"], x["code"], x["name"], year))
    )
    return F.flatten(F.filter(F.transform(named, facts), lambda f: f.isNotNull()))


def extracted(chunks: DataFrame, rules: Rules = Rules(), key: str = "doc_id") -> DataFrame:
    """chunks with found, the facts of each in the order of the rules.

    Rows of tables (record_type `table_row`) follow their own rules. A fact with an empty name ends its chunk's facts; those before
    it stay. A null text has none, null years and files are unknown.
    """
    text, year, file = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "source_year", "source_file"))
    of_table = F.coalesce(F.col("record_type") == "table_row", F.lit(False))
    x = chunks.withColumn("found", F.when(of_table, table_rows(text, year, file)).otherwise(general(text, year, file, rules)))
    bad = F.array_position(F.transform("found", lambda f: (f["source"] == "") | (f["target"] == "")), True).cast("int")
    return x.withColumn("found", F.when(bad > 0, F.slice("found", 1, bad - 1)).otherwise(F.col("found")))


def graph_relations(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, source, relation and target of extracted(): each once for a chunk."""
    triples = F.array_distinct(F.transform("found", lambda f: F.struct(f["source"].alias("source"), f["relation"].alias("relation"), f["target"].alias("target"))))
    return found.select(key, F.posexplode(triples).alias("ord", "x")).select(key, "ord", "x.*")


def graph_entities(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name and label of all that a chunk's facts name; the label is that of the first fact to name it."""
    both = F.flatten(F.transform("found", lambda f: F.array(F.struct(f["source"].alias("name"), f["source_label"].alias("label")), F.struct(f["target"].alias("name"), f["target_label"].alias("label")))))
    return found.select(key, F.posexplode(both).alias("ord", "x")).groupBy(key, "x.name").agg(F.min_by("x.label", "ord").alias("label"))


def graph_facts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, id, text, relation_label, source_entity, target_entity and fact_type: a sentence for each relation, and the whole text of
    a chunk without any. Blank texts without relations give nothing."""
    phrases = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    context = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("heading_path", "title", "source_file") if c in found.columns], F.lit(""))
    triples = F.transform("found", lambda f: F.struct(f["source"].alias("source_entity"), f["relation"].alias("relation_label"), f["target"].alias("target_entity"), F.lit("relation").alias("fact_type")))
    whole = F.array(F.struct(F.lit("").alias("source_entity"), F.lit("FALLBACK_CHUNK").alias("relation_label"), F.lit("").alias("target_entity"), F.lit("chunk_fallback").alias("fact_type")))
    own = F.trim(F.coalesce(F.col("text"), F.lit("")))
    each = F.when(F.size("found") > 0, F.array_distinct(triples)).when(own != "", whole)
    x = found.select(key, own.alias("_own"), context.alias("_context"), F.explode(each).alias("x")).select(key, "_own", "_context", "x.*")
    phrase = F.coalesce(F.try_element_at(phrases, F.col("relation_label")), F.lower(F.translate("relation_label", "_", " ")))
    told = F.trim(F.concat("source_entity", F.lit(" "), phrase, F.lit(" "), "target_entity", F.lit(". Bối cảnh: "), "_context"))
    related = F.col("fact_type") == "relation"
    node = F.when(related, F.concat_ws(":", F.col(key).cast("string"), "source_entity", "relation_label", "target_entity")).otherwise(F.concat(F.col(key).cast("string"), F.lit(":fallback")))
    return x.select(key, uuid5_url(node).alias("id"), F.when(related, told).otherwise(F.col("_own")).alias("text"), "relation_label", "source_entity", "target_entity", "fact_type")
