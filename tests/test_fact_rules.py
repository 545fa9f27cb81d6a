"""Fact rules on worked examples."""

from ragframe.operators import fact_rules

SCHEMA = "doc_id long, text string, record_type string, source_year string, source_file string"


def found(spark, *rows):
    return fact_rules.extracted(spark.createDataFrame(list(rows), SCHEMA), fact_rules.Rules("S", ("about",)))


def triples(spark, *rows):
    return [(r.source, r.relation, r.target) for r in sorted(fact_rules.graph_relations(found(spark, *rows)).collect(), key=lambda r: (r.doc_id, r.ord))]


def test_prose(spark):
    text = "about us\nMÃ TRƯỜNG : TSN\nĐịa chỉ trụ sở:  02 Main;\nTel 0258 3831149, 0258 3831149 https://a.b/c)\nPhương thức 1: x y X - Phương thức 2: z"
    want = [("S", "HAS_SOURCE_FILE", "f"), ("S", "HAS_ADMISSION_CODE", "TSN"), ("S", "LOCATED_AT", "02 Main"), ("S", "HAS_CONTACT_PHONE", "02583831149"), ("S", "HAS_WEBSITE", "https://a.b/c")]
    methods = [("S", "USES_METHOD", "Phương thức 1: x y"), ("S", "USES_METHOD", "Phương thức 2: z")]
    assert triples(spark, (1, text, "section", "unknown", "f")) == want + methods
    year = [("S", "HAS_ADMISSION_YEAR", "2024"), methods[0], ("Phương thức 1: x y", "APPLIES_TO_YEAR", "2024"), methods[1], ("Phương thức 2: z", "APPLIES_TO_YEAR", "2024")]
    assert triples(spark, (1, text, None, "2024", "f")) == want + year
    # an empty name ends the facts of its chunk
    assert triples(spark, (1, "Mã trường: A\nĐịa chỉ trụ sở: -;\nhttps://a.b", "section", None, None)) == [("S", "HAS_ADMISSION_CODE", "A")]
    assert triples(spark, (1, None, None, None, None), (2, "", "table_row", None, None)) == []


def test_quota_rows(spark):
    head = "- TT | Mã | Ngành | Mã ngành | Chỉ tiêu | PT | x\n- I | Nhóm | a | b | c | Phương thức 1: no | 5\n"
    row = "- 1 | 7480201A | CNTT | 7480201 | 120 | Phương thức 1: a | 9"
    got = triples(spark, (1, head + row, "table_row", "unknown", ""))
    assert got == [("CNTT", "HAS_ADMISSION_CODE", "7480201A"), ("CNTT", "HAS_MAJOR_CODE", "7480201"), ("CNTT", "HAS_QUOTA", "Chỉ tiêu CNTT: 120"), ("CNTT", "USES_METHOD", "Phương thức 1: a 9")]
    # six cells are too few; a header alone gives nothing; rows of a section are no table's
    assert triples(spark, (1, head + "- 1 | 7480201 | B | 5 | Phương thức 1: a | 9", "table_row", None, None), (2, head.split("\n")[0], "table_row", None, None), (3, head.split("\n")[0] + row.replace("Phương", "x"), "section", None, None)) == []


def test_subject_rows(spark):
    head = "- STT | Mã | Ngành | Tổ hợp xét tuyển | TA\n"
    got = triples(spark, (1, head + "- 1 | 7480201 | CNTT | Toán; Lý | 6,5\n- 2 | - | Luật | Ngữ văn | -\n- 1.1 | nhóm |  |  | ", "table_row", "2024", ""))
    assert got == [
        ("CNTT", "HAS_ADMISSION_CODE", "7480201"), ("CNTT", "APPLIES_TO_YEAR", "2024"), ("CNTT", "HAS_SUBJECT_COMBINATION", "Tổ hợp xét tuyển CNTT năm 2024: Toán; Lý"), ("CNTT", "HAS_ENGLISH_REQUIREMENT", "Điều kiện tiếng Anh CNTT năm 2024: 6,5"),
        ("Luật", "APPLIES_TO_YEAR", "2024"), ("Luật", "HAS_SUBJECT_COMBINATION", "Tổ hợp xét tuyển Luật năm 2024: Ngữ văn"), ("Luật", "HAS_ENGLISH_REQUIREMENT", "Điều kiện tiếng Anh Luật năm 2024: 2"),
    ]


def test_score_rows(spark):
    row = "- 1 | 7480201 | CNTT | 20 | 21 | 700 | - | 5 | 8 | 9 | 10"
    by_file = triples(spark, (1, row, "table_row", None, "diem-trung-tuyen-2024.txt"))
    assert by_file[:2] == [("CNTT", "HAS_ADMISSION_CODE", "7480201"), ("CNTT", "APPLIES_TO_YEAR", "2024")]
    assert [t for _, _, t in by_file[2:]] == [f"CNTT - {m}" for m in ("Điểm thi THPT 2024: 21", "Điểm tiếng Anh thi THPT 2024: 700", "Điểm học bạ THPT 2024: 5", "Điểm tiếng Anh học bạ 2024: 8", "Điểm ĐGNL 2024: 9", "Điểm tiếng Anh ĐGNL 2024: 10")]
    by_header = triples(spark, (1, "- TT | Mã | Tên | Điểm thi 2025 | ĐGNL\n" + row, "table_row", "unknown", ""))
    assert by_header[1] == ("CNTT", "APPLIES_TO_YEAR", "2025") and len(by_header) == 6
    assert triples(spark, (1, "- 1 | 2 | CNTT | 4", "table_row", None, "diem-trung-tuyen.txt")) == [("CNTT", "APPLIES_TO_YEAR", "2025")]


def test_entities_and_sentences(spark):
    f = found(spark, (1, "Mã trường: TSN", "section", None, "f"), (2, " nothing ", "section", None, "f"), (3, "  ", None, None, None))
    assert {(r.doc_id, r["name"], r.label) for r in fact_rules.graph_entities(f).collect()} == {(1, "S", "INSTITUTION"), (1, "TSN", "ADMISSION_CODE")}
    got = {r.doc_id: (r.text, r.relation_label, r.fact_type) for r in fact_rules.graph_facts(f).collect()}
    assert got == {1: ("S có mã tuyển sinh là TSN. Bối cảnh: f", "HAS_ADMISSION_CODE", "relation"), 2: ("nothing", "FALLBACK_CHUNK", "chunk_fallback")}
