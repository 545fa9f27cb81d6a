import json

import pytest
from pyspark.sql import functions as F

from ragframe import config as c
from ragframe.sources import jsonl, sinks
from ragframe.streaming import ingest


def test_overrides():
    s = c.overridden(c.Settings(), {"retrieval_top_n": "3", "query_fusion_enabled": "off", "llm_seed": None, "other": 1})
    assert s.retrieval_top_n == 3 and s.query_fusion_enabled is False and s.llm_seed is None
    assert c.signature({"b": 1, "llm_seed": 2}) == '{"llm_seed": 2}'
    with pytest.raises(ValueError):
        c.overridden(c.Settings(), {"query_fusion_enabled": "maybe"})
    with pytest.raises(ValueError):
        c.Policy({"dev": {}}).mode("other")


def test_config_files(tmp_path):
    p = tmp_path / "c.json"
    assert c.read_config(str(p)) == {}
    p.write_text("[1]")
    with pytest.raises(ValueError):
        c.read_config(str(p))
    assert c.read_env(["# x", "", "A=b=c", "no"]) == {"A": "b=c"}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "20aa/x.txt", "", "t1"), (2, "2024/y.txt", "T", " "), (3, "web/z-b.txt", None, "t3")], "chunk_id int, relative_path string, title string, text string")
    sinks.to_jsonl(df, str(tmp_path / "j"))
    rows = spark.read.text(str(tmp_path / "j")).select("value")
    assert {(r.doc_id, r.title, r.source_year) for r in jsonl.parse_chunks(rows).collect()} == {("20aa/x.txt::chunk-1", "X", "unknown"), ("web/z-b.txt::chunk-3", "Z B", "unknown")}
    (tmp_path / "t" / "2024").mkdir(parents=True)
    (tmp_path / "t" / "2024" / "a.txt").write_text("one\ntwo")
    (tmp_path / "t" / "b.txt").write_text("no")
    files = jsonl.text_files(spark, str(tmp_path / "t"))
    assert files.count() == 2 and [r.text for r in jsonl.scoped(files, str(tmp_path / "t")).collect()] == ["one\ntwo"]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in range(2):
        (src / f"{n}.jsonl").write_text(json.dumps({"chunk_id": n, "relative_path": "a.txt", "text": f"t{n}"}))
        ingest.to_table(ingest.chunk_stream(spark, str(src)), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == n + 1


def test_windowed_rate_plans(spark):
    rate = spark.readStream.format("rate").load().withColumn("v", F.col("value").cast("double"))
    assert ingest.windowed_rate(rate, "timestamp", "1 minute", "5 minutes", "v", 50.0).isStreaming
