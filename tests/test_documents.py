"""Sections, chunks, evaluation rows, the index and settings, on worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe import config
from ragframe.operators import assessment, chunking, embed, evaluation, index, layout, retrieval, sections, structure
from ragframe.session import shared_folder

DOC = """# Guide
Source: https://example.org/a

intro
## I. Plan
text one

### Fee: 100
### Deep
deep text
### Bang 1
- code | name | quota

- 1 | a | 5
- 2 | b | 6
after table
## II. Next
## Empty
### Inner
last"""


def paths(ss):
    return [(" > ".join(s.names), list(s.lines)) for s in ss]


def test_nested_sections():
    assert paths(sections.nested_sections(DOC)) == [
        ("Guide", ["Source: https://example.org/a", "", "intro"]),
        ("Guide > I. Plan", ["text one"]),
        ("Guide > I. Plan", ["Fee: 100"]),  # a heading alone that is a fact
        ("Guide > I. Plan > Deep", ["deep text"]),
        ("Guide > I. Plan > Bang 1", ["- code | name | quota", "- 1 | a | 5", "- 2 | b | 6"]),
        ("Guide > I. Plan", ["after table"]),  # the table's heading has ended
        ("Guide > Empty > Inner", ["last"]),
    ]
    assert sections.nested_sections("") == [] and sections.flat_sections(" \n") == []


def test_flat_sections():
    got = paths(sections.flat_sections(DOC))
    assert got[0] == ("Guide", ["Source: https://example.org/a", "", "intro"]) and ("Fee: 100", []) in got and ("II. Next", []) in got
    assert got[got.index(("Bang 1", ["- code | name | quota", "- 1 | a | 5", "- 2 | b | 6"])) + 1] == ("", ["after table"])


def test_sparse_sections_merge_under_one_anchor():
    s = sections.nested_sections("# T\n## A\n### x\none\n### y\ntwo\n### z\nthree\n## B\n### w\nfour")
    assert paths(sections.merged_nested(s, 100, 2)) == [("T > A > x", ["one", "", "### y", "two"]), ("T > A > z", ["three"]), ("T > B > w", ["four"])]
    assert sections.merged_nested(s, 0, 9) == s
    f = sections.flat_sections("# T\na\n## U\nb\n## V\nc")
    assert [x.body() for x in sections.merged_flat(f, 8, 9)] == ["# T\na\n\n## U\nb", "## V\nc"]


def test_every_packing_stays_within_its_room():
    rng = random.Random(2)
    for _ in range(200):
        items = ["x" * rng.randint(1, 30) for _ in range(rng.randint(1, 20))]
        parts = sections.packed(items, "; ", 40, "head")
        assert [i for p in parts for i in p.split("; ")[1:]] == items and all(len(p) <= 40 for p in parts)
        # no part could have taken the next one's first item
        assert all(len(a) + 2 + len(b.split("; ")[1]) > 40 for a, b in zip(parts, parts[1:], strict=False))


def test_words_and_rows_are_cut():
    assert sections.wrapped_words("aa bb cc", 5) == ["aa bb", "cc"]
    assert sections.wrapped_words("x" * 12, 5) == ["xxxxx", "xxxxx", "xx"]
    assert sections.wrapped_words("aa " + "x" * 12, 5) == ["aa", "x" * 12]  # after a full part a long word stays whole
    row = "- 1 | name | " + " ".join(f"{i}. {'item' * 20};" for i in range(1, 5))
    got = sections.cut_line(row, 200)
    assert len(got) == 2 and all(x.startswith("- 1 | name | ") and len(x) <= 200 for x in got) and got[1].startswith("- 1 | name | 3. ")
    assert sections.numbered_row("- 1 | name | 1. alone", 10) == []


def test_tables_repeat_their_header_and_group():
    s = sections.Section(((2, "H"), (3, "Bang 1")), ("- code | name", "- I | first", "- 1 | aaaa", "- 2 | bbbb", "- II | next", "- 3 | cccc"))
    assert sections.is_table(s) and sections.is_header_row("- code | name") and sections.is_group_row("- II | next")
    top = "## H\n### Bang 1\n- code | name\n"
    assert sections.cut_table(s, 50) == [top + "- I | first\n- 1 | aaaa", top + "- I | first\n- 2 | bbbb", top + "- II | next\n- 3 | cccc"]
    assert sections.table_records(s)[1] == ("table_row", top + "- I | first\n- 2 | bbbb")
    assert sections.is_low_value(sections.Section(((3, "Bang 2"),), ("- Các trang thiết bị chính | b",)), (), sections.folded)


def test_chunks_of_documents(spark):
    long = "# T\n## A\n" + "\n\n".join("word " * 60 for _ in range(6)) + "\n## B\nName: value"
    df = spark.createDataFrame([(0, DOC, 1), (1, long, 2), (2, None, 3), (3, " \n ", 4), (4, "plain", 5)], "doc_id long, text string, chunk_id int")
    got = {}
    for r in sections.chunked(df, chunking.PROFILES["balanced"]).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {0, 1, 4} and [r.chunk_id for r in got[1]] == list(range(1, len(got[1]) + 1))
    assert all(r.char_count == len(r.text) for rs in got.values() for r in rs) and len(got[1]) >= 4
    assert got[1][-1].text.endswith("Name: value\nTra cứu nhanh: Name là value.") and got[1][0].text.startswith("<document_context>\nTài liệu: T\nMục: T > A\n</document_context>\n")
    b = sections.chunked(df, chunking.PROFILES["max"], "b").collect()
    assert [r.text for r in b if r.record_type == "table_row"] == ["### Bang 1\n- code | name | quota\n- 1 | a | 5", "### Bang 1\n- code | name | quota\n- 2 | b | 6"]
    s = {r.doc_id: (r.chunk_count, r.table_chunks) for r in sections.record_summary(sections.chunked(df, chunking.PROFILES["max"])).collect()}
    assert s[0][1] == 1 and s[4] == (1, 0)
    assert sections.chunked(df.filter("doc_id < 0"), chunking.PROFILES["max"]).count() == 0


def test_finalized_documents(spark):
    rows = structure.lines(spark.createDataFrame([(0, "\n## a\n\n\n#### b\nx  \n\n"), (1, "")], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in structure.finalized(rows, spark.createDataFrame([(0, "T"), (1, "U")], "doc_id long, title string"), "doc_id").collect()}
    assert got == {0: "# T\n\n## a\n\n### b\nx\n", 1: "# U\n"}


def test_pages_are_read_by_column():
    box = np.array([[0, 0, 100, 10], *[[0, 20 + 10 * i, 45, 28 + 10 * i] for i in range(3)], *[[55, 15 + 10 * i, 100, 23 + 10 * i] for i in range(3)], [0, 90, 100, 99]], float) * 5
    assert layout.page_order(box, 500).tolist() == list(range(8))
    assert layout.page_order(box[::-1], 500).tolist() == list(range(8))[::-1]
    assert layout.page_order(box[:4], 500).tolist() == [0, 1, 2, 3]


def test_evaluated_rows(spark):
    src = [("fees", "the fee is 26 euro a year", {"k": "v"}), ("sports", "the hall is open", {})]
    rows = [
        (1, "what is the fee", "the fee is 26 euro", "The fee is 26 euro. The fee is 99 euro.", ["fee"], ["euro"], ["fees"], False, src, 100.0, None),
        (2, "what is the fee", "the fee is 26 euro", "the fee is 26 euro", ["fee"], [], [], False, src, 30_000.126, None),
        (3, "who", "nobody", "", None, None, None, True, None, 5.0, None),
        (4, "what", "x", "y", ["a"], ["b"], ["c"], False, src, 1.0, "timeout"),
    ]
    df = spark.createDataFrame(rows, f"example_id long, question string, reference string, answer string, keywords array<string>, answer_keywords array<string>, hints array<string>, refusal_expected boolean, sources {assessment.SOURCES}, latency_ms double, error string")
    out = assessment.evaluated(df, lambda c: embed.hashing_column(c, 64))
    got = {r.example_id: r.asDict() for r in out.collect()}
    assert got[1]["faithfulness"] == 0.5 and got[1]["hallucination_rate"] == 0.5 and got[1]["source_hint_hit"] == 1.0  # 99 stands in no source
    assert got[2]["exact_match"] == got[2]["semantic_similarity"] == got[2]["token_f1"] == got[2]["char_similarity"] == got[2]["faithfulness"] == 1.0
    assert got[2]["latency_ms"] == 30_000.13 and got[2]["mrr"] > 0.7 and got[2]["precision_at_1"] > got[2]["precision_at_5"] and got[2]["recall_at_k"] == got[2]["recall_at_3"]
    assert got[3]["faithfulness"] == 1.0 and got[3]["source_count"] == 0 and got[3]["context_relevance"] == 0.0
    assert got[4]["error"] == "timeout" and got[4]["hallucination_rate"] == 1.0 and all(got[4][m] == 0 for m in assessment.MEASURES if m != "hallucination_rate")
    s = assessment.summarised(out.withColumn("g", F.lit("x")), ("g",), 25_000.0).first()
    assert (s.n, s.error_count, s.latency_violation_rate) == (4, 1, 0.25) and s.faithfulness == round((0.5 + 1 + 1 + 0) / 4, 4)


def test_alignment_split_and_judgments(spark):
    e = spark.createDataFrame([(i, 10 - i) for i in range(3)], "example_id long, position int")
    assert assessment.aligned(e, spark.createDataFrame([(i, "x") for i in range(3)], "example_id long, v string")).orderBy("position").first().example_id == 2
    with pytest.raises(ValueError, match="repeated: 1; missing: 0, 2; unknown: 7"):
        assessment.aligned(e, spark.createDataFrame([(1,), (1,), (7,)], "example_id long"))
    one = spark.createDataFrame([("dev",), (" ",), (None,)], "split string")
    assert assessment.resolved_split(one) == "dev" and assessment.resolved_split(one, "x") == "x"
    assert assessment.resolved_split(spark.createDataFrame([("a",), ("b",)], "split string")) == "all"
    a = spark.createDataFrame([(1, "s", "good"), (2, "s", "bad"), (3, "s", " ")], "example_id long, system string, label string")
    b = spark.createDataFrame([(1, "s", "good"), (2, "s", "good"), (3, "s", "bad"), (4, "s", "bad")], "example_id long, system string, label string")
    r = assessment.judged(a, b, ("label",)).first()
    assert (r.field, r.n, r.agreement, r.kappa) == ("label", 2, 0.5, 0.0)


def test_claims_need_a_source_and_its_numbers(spark):
    df = spark.createDataFrame([("the fee is 26 euro", ["the fee is 26 euro now"]), ("the fee is 99 euro", ["the fee is 26 euro now"]), ("cats like warm milk", ["the fee is 26 euro now"]), ("a b c", [])], "c string, t array<string>")
    e = lambda c: embed.hashing_column(c, 64)
    assert [r[0] for r in df.select(assessment.claim_support(F.col("c"), F.col("t"), F.transform("t", e), e)).collect()] == [True, False, False, False]


def test_index_is_kept_while_its_nodes_stay(spark):
    at = f"{shared_folder(spark)}/index-{random.random()}"
    nodes = spark.createDataFrame([(1, "a", [1.0], "web/x.txt", "y"), (2, "b", [2.0], "", "z")], "doc_id long, text string, embedding array<double>, relative_path string, source_file string")
    assert index.read(spark, at) is None
    first, built = index.ensure(spark, at, nodes, "m")
    assert built and sorted(r.file for r in index.files(first).collect()) == ["web/x.txt", "z"]
    assert not index.ensure(spark, at, nodes, "m")[1] and index.ensure(spark, at, nodes.withColumn("text", F.lit("c")), "m")[1]


def test_search_in_blocks_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 6))
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_id long, embedding array<double>")
    q = df.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.dense(df, q, block=7).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in range(0, 90, 3):
        s = np.round(np.maximum(0, u @ u[i]), 6)
        want = [j for j in np.lexsort((np.arange(90), -s)).tolist() if j != i][:6]
        assert [got[i, k][0] for k in range(1, 7)] == want and all(abs(got[i, k][1] - s[j]) < 2e-6 for k, j in enumerate(want, 1))


def test_intervals_of_whole_rounds(spark):
    rng = random.Random(3)
    x = [rng.gauss(0.5, 0.2) for _ in range(30)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 0.0)], "g string, o int, x double")
    got = {r.g: r for r in evaluation.bootstrap_ci(df, "g", "x", "o").collect()}
    assert got["a"].low < got["a"].mean < got["a"].high and abs((got["a"].high - got["a"].low) / 2 - 1.96 * np.std(x) / 30**0.5) < 0.02
    assert got["a"].label == "stable" and got["b"].label == "overlap_zero"
    p = {r.g: r.p for r in evaluation.permutation_p(df, "g", "x", "o").collect()}
    assert p["a"] == round(1 / 5001, 4) and p["b"] == 1.0
    c = spark.range(1).select(evaluation.confidence(F.lit(0.1), F.lit(0.2), F.lit(0.2)).alias("a"), evaluation.confidence(F.lit(0.1), F.lit(0.2), F.lit(0.01)).alias("b")).first()
    assert (c.a, c.b) == ("uncertain", "stable")


def test_settings_merge():
    got = config.merged({"k": 6, "t": 0.1, "name": "x", "on": False}, {"k": 3, "t": 0, "name": ""}, {"NAME": "y", "ON": "true"}, {"k": 9, "t": None})
    assert got == {"k": 9, "t": 0.1, "name": "y", "on": True}
