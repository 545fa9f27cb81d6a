"""Chunk records read from files."""

import json

import pytest

from ragframe.sources import records


def write(root, name, rows):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows) + "\n", encoding="utf-8")


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for f in ("a", "b"):
        write(tmp_path, f"{f}.jsonl", [f"{f}{i}" for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(r.path[-7], r.line_no): r.value for r in records.numbered_lines(spark, str(tmp_path)).collect()}
        first = {r.path[-7] for r in records.numbered_lines(spark, str(tmp_path), most=1).select("path").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f, i + 1): f"{f}{i}" for f in "ab" for i in range(3000)} and first == {"a"}


def test_fields_of_records(spark, tmp_path):
    table = "- code | name\n- 1 | a"
    write(tmp_path, "2024/bao-cao_x.jsonl", [{"text": " a\n\nb "}, "", {"text": "  "}, {"chunk_id": 0, "text": table, "heading_path": ["T", "Bang 2"]}, {"chunk_id": 9, "text": "x", "heading_path": "One", "title": ""}])
    write(tmp_path, "web/y.jsonl", [{"chunk_id": 2, "text": "t", "title": "Own", "record_type": "kind", "source_url": "u", "char_count": 7, "heading_path": ["Bang 1"]}])
    write(tmp_path, "web/none.jsonl", [{"text": ""}])
    root = str(tmp_path)
    got = {r.doc_id: r for r in records.records(records.numbered_lines(spark, root), root).collect()}
    one = got["2024/bao-cao_x.txt::chunk-1"]
    assert (one.text, one.title, one.source_group, one.source_year, one.source_file, one.record_type, one.char_count, one.line_count, one.heading_path) == ("a\n\nb", "Bao Cao X", "2024", "2024", "bao-cao_x.txt", "section", 4, 2, [])
    four = got["2024/bao-cao_x.txt::chunk-4"]
    assert (four.record_type, four.table_heading, four.title) == ("table_row", "Bang 2", "T")
    assert got["2024/bao-cao_x.txt::chunk-9"].heading_path == ["One"] and got["2024/bao-cao_x.txt::chunk-9"].title == "One"
    y = got["web/y.txt::chunk-2"]
    assert (y.title, y.record_type, y.table_heading, y.source_url, y.char_count) == ("Own", "kind", "", "u", 7) and len(got) == 4
    scoped = records.records(records.numbered_lines(spark, root, "web"), root)
    assert {r.relative_path: (r.n_chunks, r.chunk_ids) for r in records.by_file(scoped).collect()} == {"web/y.txt": (1, [2])}
    assert records.numbered_lines(spark, root, "all").select("path").distinct().count() == 3


def test_broken_lines_raise(spark, tmp_path):
    write(tmp_path, "x.jsonl", ["{broken"])
    with pytest.raises(Exception, match="(?i)malformed"):
        records.records(records.numbered_lines(spark, str(tmp_path)), str(tmp_path)).collect()
