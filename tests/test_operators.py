import difflib
import uuid

import pytest
from pyspark.sql import functions as F

from ragframe.functions import lines as ln
from ragframe.functions import metrics as m
from ragframe.functions import text as t
from ragframe.operators import chunking, evaluation, facts, html, layout, retrieval, structure
from ragframe.operators.embed import embed
from ragframe.operators.similarity import char_ratio


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text_forms(spark):
    assert one(spark, "  Điểm—Chuẩn, 26.5! ", t.norm_match) == "diem chuan 26 5"
    assert one(spark, "Điểm", t.fold) == "điem"
    assert one(spark, "•  • a •b​", t.normalize_line) == "- a b"
    assert one(spark, "Điểm X", t.slugify) == "i-m-x"
    assert one(spark, "https://a.b/c+d%20e?q=1", t.slug_from_url) == "a-b-c-d-e"
    assert one(spark, "https://?x", t.slug_from_url).startswith("link-")
    assert one(spark, "x/2023/2024/a-2022.txt", t.infer_year) == "2023"
    assert one(spark, "x/a.txt", t.infer_year) == "unknown"
    assert one(spark, "abc", t.uuid5_url) == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert one(spark, "1,5 và 2.75 x3", t.numbers) == ["1,5", "2.75", "3"]
    assert one(spark, "x", t.safe_float) == 0.0


def test_line_forms(spark):
    assert one(spark, "II. Plan", ln.classify) == "## Plan"
    assert one(spark, "1.2.3 Deep", ln.classify) == "##### Deep"
    assert one(spark, "ALL CAPS", ln.classify) == "## ALL CAPS"
    assert one(spark, "* -item", ln.classify) == "- item"
    assert one(spark, "trang 3/10", ln.is_noise) is True
    assert one(spark, "Fee: 100", ln.fact_alias) == "Tra cứu nhanh: Fee là 100."
    assert one(spark, "source: x", ln.fact_alias) is None


def test_packing_matches_a_loop(spark):
    text = "\n".join("x" * n for n in (5, 3, 9, 1, 1, 1, 30, 2))
    want, acc = [], None
    for b in text.split("\n"):
        if acc is not None and len(acc) + 1 + len(b) <= 10:
            acc += "\n" + b
        else:
            want += [acc] if acc is not None else []
            acc = b
    want.append(acc)
    got = chunking.packed(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), "text", "\n", 10).orderBy("doc_id").collect()
    assert got[0]["parts"] == want and got[1]["parts"] == []


def test_merging(spark):
    df = spark.sql("select from_json('[{\"text\":\"a\",\"anchor\":\"h\",\"is_table\":false},{\"text\":\"b\",\"anchor\":\"h\",\"is_table\":false},{\"text\":\"c\",\"anchor\":\"g\",\"is_table\":false},{\"text\":\"- t\",\"anchor\":\"g\",\"is_table\":true}]', 'array<struct<text:string,anchor:string,is_table:boolean>>') as s")
    got = df.select(chunking.merged(F.col("s"), chunking.Profile(5, 10, 2)).alias("m")).first()["m"]
    assert [x["text"] for x in got] == ["a\n\nb", "c", "- t"]


def test_spans(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", 2, 1), (1, 0, 1, "b", 1, 2), (1, 1, 0, "c", 1, 1)], "table_id int, row int, ord int, value string, rowspan int, colspan int")
    assert {(r.row, r.col): r.value for r in html.spans(cells).collect()} == {(0, 0): "a", (0, 1): "b", (0, 2): "", (1, 0): "a", (1, 1): "c"}


def test_reading_order_by_column(spark):
    rows = [(i, 10.0 + 300 * (i % 2), 100.0 + 20 * i, 200.0 + 300 * (i % 2), 110.0 + 20 * i) for i in range(8)] + [(8, 0.0, 10.0, 590.0, 30.0), (9, 0.0, 400.0, 590.0, 420.0)]
    df = spark.createDataFrame([(1, *r, 600.0) for r in rows], "page int, id long, x0 double, y0 double, x1 double, y1 double, width double")
    got = [r.id for r in layout.reading_order(df, ("page",)).orderBy("pos").collect()]
    assert got == [8, 0, 2, 4, 6, 1, 3, 5, 7, 9]


def test_ranking_edges(spark):
    hits = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 0.0)], "query_id string, rank long, rel double")
    totals = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0)], "query_id string, total double")
    r = {x.query_id: x for x in evaluation.ranking_scores(hits, totals).collect()}
    assert r["a"]["mrr"] == 0.5 and r["a"]["map"] == 0.5 and r["a"]["recall_at_1"] == 0.0 and r["a"]["ndcg_at_3"] == round(1 / 1.584962500721156, 4)
    assert r["b"]["recall_at_3"] == 0.0 and r["b"]["ndcg_at_3"] == 1.0 and r["c"]["recall_at_3"] == 1.0 and r["d"]["recall_at_3"] == 0.0


def test_prf_edges(spark):
    df = spark.createDataFrame([(1, "a a b", "a b c"), (2, "", ""), (3, "x", "")], "k long, r string, a string")
    got = {x.k: (x.token_precision, x.token_recall) for x in evaluation.token_prf(df, "k", "r", "a").collect()}
    assert got == {1: (round(2 / 3, 4), round(2 / 3, 4)), 2: (1.0, 1.0), 3: (0.0, 0.0)}


def test_kappa_of_one_label(spark):
    assert evaluation.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()["kappa"] == 1.0
    assert evaluation.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first()["kappa"] == 0.0


def test_ratio(spark):
    got = char_ratio(spark.createDataFrame([("Hello world", "hello word")], "a string, b string"), "a", "b").first()["ratio"]
    assert got == difflib.SequenceMatcher(a="hello world", b="hello word").ratio()


def test_fusion_names_and_gate(spark):
    with pytest.raises(ValueError, match="reciprocal_rank"):
        retrieval.list_value("other")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    h = spark.createDataFrame([(1, 0.2), (2, 0.9)], "query_id long, score double")
    assert {r.query_id: r.refused for r in retrieval.gate(q, h, 0.25).collect()} == {1: True, 2: False, 3: True}


def test_embedder_gives_up_on_one_text(spark):
    def model(texts):
        if any("bad" in x for x in texts):
            raise ValueError
        return [[float(len(x))] for x in texts]

    df = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "ONE"), (4, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed(df, model).collect()}
    assert got[1] == [3.0] and got[2] is None and got[3] == [3.0] and got[4] == [0.0]


def test_facts_of_methods(spark):
    df = spark.createDataFrame([(1, "Phương thức 1: a b\n- Phương thức 2: c")], "id long, t string")
    assert [(r.method, r.description) for r in facts.methods(df, "id", "t").orderBy("method").collect()] == [(1, "a b"), (2, "c")]


def test_lines_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert structure.lines(none).count() == 0
    assert m.bar and retrieval.bm25(none, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_bootstrap_rounds_halves_as_sql(spark):
    import duckdb

    from ragframe.plans.evaluation_queries import _ci

    rows = [("a", i, v) for i, v in enumerate([0.8702, 0.2868, 0.6031, 0.7775, 0.7161, 0.9154, 0.8604, 0.9182, 0.0266, 0.4372])]
    con = duckdb.connect()
    con.execute("create table s (g varchar, o bigint, x double)")
    con.executemany("insert into s values (?, ?, ?)", rows)
    want = con.execute("with " + _ci("select g, o, x from s")).fetchall()
    got = evaluation.bootstrap_ci(spark.createDataFrame(rows, "g string, o long, x double"), "g", "x", "o").collect()
    assert [tuple(r) for r in got] == want


def test_bm25_moves_no_pairs(spark):
    import math
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["ba", "be", "bi", "bo"], k=9) + [f"w{rng.randrange(9000)}" for _ in range(60)]) for _ in range(120)]
    texts[7:30] = [texts[7]] * 23  # copies tie
    docs = [(i, x) for i, x in enumerate(texts)] + [(500, None), (501, ""), (None, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = retrieval.bm25(df, df.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id"), 5, same=False, block=25)
    words = [(d, (x or "").split()) for d, x in docs]
    count = lambda w: sum(w in x for _, x in words)
    avg = sum(len(x) for _, x in words if x) / sum(bool(x) for _, x in words)
    idf = {w: math.log(1 + (len(words) - count(w) + 0.5) / (count(w) + 0.5)) for w in {w for _, x in words for w in x}}
    want = []
    for q, asked in words:
        if q is not None and q % 2 == 0:
            hits = [(-round(sum(idf[w] * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for w in set(asked) & set(x)), 4), d) for d, x in words if d not in (None, q) and set(asked) & set(x)]
            want += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(hits)[:5], 1)]
    assert len(idf) > 3000  # more than the columns of the matrix product
    assert sorted(tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_mean_of_scores_rounds_halves(spark):
    rows = spark.createDataFrame([(x,) for x in [0.1068, 0.7026, 0.652, 0.9404, 0.2711, 0.2558, 0.7341, 0.6585, 0.303, 0.6842]], "x double").coalesce(1)
    got = rows.agg(m.mean_of_scores(F.col("x")).alias("new"), F.round(F.avg("x"), 4).alias("old")).first()
    assert (got["new"], got["old"]) == (0.5309, 0.5308)  # the exact mean ends in 5


def test_texts_without_a_vector_are_not_moved_wherever_their_ids_lie(spark, tmp_path):
    from ragframe.plans import retrieval_queries as rq

    # copies with shifted keys: the vectors' ids have gaps, and nearly all texts lie within their range
    have = [0, 1, 2, 100_000, 100_001, 100_001, 199_999, None]
    spark.range(200_000).selectExpr("id as doc_id", "'t' || id as text").unionByName(spark.sql("select null as doc_id, 'none' as text union all select 2L, 'again'")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0], 0) for i in have], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((x.doc_id, x.text) for x in rq.dvec(spark, str(tmp_path)).collect())
    assert got == sorted([(i, f"t{i}") for i in have if i is not None] + [(2, "again")])
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([(i,) for i in have], "doc_id int")
    assert {x.doc_id for x in retrieval.likely(docs, ids, "doc_id").collect()} >= {i for i in have if i is not None}
    assert retrieval.likely(docs, ids, "doc_id").count() < 30
    assert retrieval.likely(docs, ids, "doc_id", 4).count() >= 8  # few bits let more through, and lose none
    assert retrieval.likely(docs, ids.filter("doc_id < 0"), "doc_id").count() == 0


def test_word_list_moves_no_text(spark, tmp_path):
    import os
    import random

    from ragframe.plans import retrieval_queries as rq

    rng, root = random.Random(5), spark.sparkContext._jsc.sc().getCheckpointDir
    texts = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(4000))) for i in range(120)] + [(None, "w1 w2"), (130, None)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    have = [i for i in range(0, 120, 2)] + [130, 900, None]
    spark.createDataFrame([(i, [1.0, float(i or 0)], 0) for i in have], "vec_id int, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root().get().removeprefix("file:")) for f in names) if root().isDefined() else 0
    before = size()
    got = rq.word_hits(spark, str(tmp_path))
    rows = got.collect()
    assert {x.query_id for x in rows} == {0, 50, 100}
    assert {x.doc_id for x in rows} <= set(have)
    assert size() - before < sum(len(x or "") for i, x in texts if i in have) / 8  # texts, if kept, would be there
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([(i,) for i in have], "doc_id int")
    want = sorted(i for i in have if i is not None and i != 900)
    for bits, most in ((1 << 25, 500_000), (64, 500_000), (4, 500_000), (4, 0)):  # few bits let all through; none is left in or out for that
        assert sorted(x.doc_id for x in retrieval.held(docs, ids, "doc_id", bits, most).collect()) == want
    assert "hashpartitioning" not in retrieval.held(docs, ids, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert retrieval.held(docs, ids.filter("doc_id < 0"), "doc_id").count() == 0


def test_dense_products_are_bounded():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(10_000, 8))
    x[7000:7010] = x[100]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(0, 10_000, 5))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + n)), pa.array(list(x[lo : lo + n]))], ["id", "v"]) for lo, n in ((0, 9990), (9990, 10))]
    tracemalloc.start()
    found = retrieval._nearest(iter(batches), ids, unit[ids], 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all queries by all nodes are 160 MB
    score = np.round(np.maximum(0, unit[ids] @ unit.T), 6)
    for i in (0, 20, 1402, 1999):
        best = sorted((-s, j) for j, s in enumerate(score[i].tolist()) if j != ids[i])[:6]
        assert [(j, s) for own, j, s in found if own == ids[i]] == [(j, -s) for s, j in best]
