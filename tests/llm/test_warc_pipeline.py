import gzip

from pyspark.sql import functions as F

from ragframe.llm.warc import derivatives, digest, from_bytes, record_id, responses, to_bytes, warc_files

PAGE = "<!DOCTYPE html><html lang='fr'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- x --><h1>Head</h1><p>one<br>two &eacute;<p>three <a href='/x?a=1&amp;b=2'>link</a></body></html>"


def test_derivatives_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", PAGE, 5), (2, None, None, 6), (3, "http://a.b/", "", 7)], "page_id long, url string, html string, block int")
    r = responses(pages)
    by = {(x.page_id, x.warc_type): x for x in r.unionByName(derivatives(r)).collect()}
    assert len(by) == 9
    res, meta, conv = (by[1, k] for k in ("response", "metadata", "conversion"))
    assert conv.refers_to == meta.refers_to == res.record_id and res.refers_to is None
    assert bytes(conv.block).decode() == "A & B\nHead\none\ntwo é\nthree link"
    assert conv.block_digest == digest(bytes(conv.block)) and conv.payload_digest == res.payload_digest == digest(PAGE.encode())
    assert '"content-type": "text/html; charset=utf-8"' in conv.source_headers
    assert b"outlink: /x?a=1&b=2\r\n" in bytes(meta.block) and conv.record_id.encode() in bytes(meta.block) and b"lang: fr" in bytes(meta.block)
    assert bytes(by[2, "conversion"].block) == b"" and derivatives(r.filter("page_id < 0")).count() == 0


def test_records_survive_a_round_trip(spark):
    r = responses(spark.createDataFrame([(1, "http://a.b/", PAGE)], "page_id long, url string, html string"))
    rows = [x.asDict() for x in r.unionByName(derivatives(r)).collect()]
    data = b"".join(map(to_bytes, rows))
    for form in (data, b"".join(gzip.compress(to_bytes(x)) for x in rows)):
        back = list(from_bytes(form))
        assert [(b["record_id"], b["refers_to"], bytes(b["block"]), b["source_headers"]) for b in back] == [(x["record_id"], x["refers_to"], bytes(x["block"]), x["source_headers"]) for x in rows]
    assert len(list(from_bytes(data[:-10]))) == 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for i, (_name, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if i < len(c.STAGES) - 1:
            assert tuple(docs.columns) == c.COLUMNS and docs.count() == len(ids)
        if i >= 3:
            assert ids == before
        before = ids


def test_one_row_of_a_class_stays_and_null_ids_too(spark, prose):
    import corpus_pipeline as c

    a, b, d = prose(60), prose(60), prose(60)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in c.near_duplicate_documents(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (3, b), (None, d), (None, d)], key=str)


def test_files_are_read_as_records(spark, tmp_path):
    r = responses(spark.createDataFrame([(i, f"http://a.b/{i}", PAGE) for i in range(3)], "page_id long, url string, html string"))
    rows = [x.asDict() for x in r.unionByName(derivatives(r)).orderBy("page_id", "seq").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(map(to_bytes, rows[:4])))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(to_bytes(x)) for x in rows[4:]))
    (tmp_path / "c.warc").write_bytes(b"no record")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b"x" * 999)[:20])
    back = warc_files(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [(b.record_id, bytes(b.block)) for b in back] == [(x["record_id"], bytes(x["block"])) for x in rows]
    again = derivatives(warc_files(spark, str(tmp_path)), key="file")
    assert {x.record_id for x in again.collect()} == {x["record_id"] for x in rows if x["warc_type"] != "response"}


def test_coded_bodies_and_odd_responses(spark):
    body = PAGE.encode("latin-1", "xmlcharrefreplace").replace(b"one", b"on\xe9")
    packed = gzip.compress(body)
    chunks = b"".join(f"{len(packed[i : i + 50]):x}\r\n".encode() + packed[i : i + 50] + b"\r\n" for i in range(0, len(packed), 50)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    blocks = [head + chunks, b"no header", b"", None, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nbroken", b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>word " * 100_000]
    rows = [(None if i == 1 else 7, "response", record_id("x", str(i)), None, None, None, bytearray(b) if b is not None else None, "clash") for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "page_id long, warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, block binary, seq string")
    got = {(x.refers_to, x.warc_type): bytes(x.block).decode() for x in derivatives(df.unionByName(df.filter("page_id is null"))).collect()}
    assert len(got) == 12 and got[rows[0][2], "conversion"].split("\n")[2] == "oné" and got[rows[1][2], "conversion"] == "no header"
    assert got[rows[2][2], "conversion"] == got[rows[3][2], "conversion"] == "" and got[rows[5][2], "conversion"].count("word") == 100_000


def test_stages_take_odd_rows(spark, odd_docs, prose):
    import corpus_pipeline as c

    empty = odd_docs.filter("doc_id < 0")
    good = ". ".join(prose(9) for _ in range(12)) + "."
    rows = [(None, good, None, None, None), (5, good, "en", "s", 1), (5, good, "en", "s", 1), (6, None, None, None, None), (7, good + "\nmail me@x.org", "en", "s", 9)]
    docs = odd_docs.select(*c.COLUMNS).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("text2", F.lit(1)).withColumn("id", F.lit("x"))
    kept = c.quality_rules(spark, docs, "")
    assert sorted((r.doc_id, r.n_chars) for r in kept.filter("doc_id is not null").collect())[:2] == [(5, len(good))] * 2 and kept.count() == 4
    assert c.near_duplicate_documents(spark, docs, "").filter("doc_id is null").count() == 1
    private = {(r.doc_id, r.text) for r in c.private_data(spark, docs, "").collect()}
    assert (6, "") in private and any(i == 7 and "[EMAIL]" in t for i, t in private)
    assert c.packing(spark, docs, "").filter("doc_id = 5").count() == 3
    for stage in (c.quality_rules, c.near_duplicate_documents, c.private_data):
        out = stage(spark, empty, "")
        assert out.count() == 0 and tuple(out.columns) == c.COLUMNS
    assert c.packing(spark, empty, "").count() == 0
