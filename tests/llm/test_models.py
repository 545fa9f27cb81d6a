import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.llm import language as g
from ragframe.llm import toxicity as t
from ragframe.llm.gru import backward, direction, forward
from ragframe.llm.ngrams import Filter, Model, build_segment, language_model, level_value, levels


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in direction(rng, 3, 2).items()}
    x, d, mask = rng.standard_normal((5, 9, 4)), rng.standard_normal((5, 3, 4)), np.ones((5, 4))
    mask[3:, 1] = 0
    out, held = forward(p, x, mask, keep=True)
    dx, du = backward(p, held, d, mask)
    for at in ((0, 0, 0), (2, 4, 1), (4, 8, 3), (1, 7, 2)):
        y = x.copy()
        y[at] += 1e-3
        assert abs(((forward(p, y, mask) - out) * d).sum() / 1e-3 - dx[at]) < 0.02
    q = {**p, "U": p["U"].copy()}
    q["U"][4, 1] += 1e-3
    assert abs(((forward(q, x, mask) - out) * d).sum() / 1e-3 - du[4, 1]) < 0.03


def test_language_held_out(spark, sf):
    from ragframe.llm.queries import op9_language

    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in op9_language(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.9


def test_language_sample_is_bounded_whatever_the_rows(spark):
    rows = [(1, "same text", "en", 7, "x")] * 50 + [(i, f"text {i}", "en" if i % 2 else "de", 7, "x") for i in range(2, 40)] + [(None, "none", "en", 7, "x"), (3, None, "en", 7, "x"), (4, "t", None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _k int, k string")
    got = g.training_sample(df, F.lit(True), "text", "lang", "doc_id", g.Settings(sample=12))
    assert len(got) == 24 and sum(x[1] == "en" for x in got) == 12 and len(set(got)) == 24
    with pytest.raises(ValueError, match="more than 1 languages"):
        g.training_sample(df, F.lit(True), "text", "lang", "doc_id", g.Settings(languages=1))


def test_language_edges(spark, odd_docs):
    s = g.Settings(epochs=1)
    m = g.train([("the and of to in " * 20, "en"), ("der die und das ist " * 20, "de")], s)
    got = {r.doc_id: r for r in g.identify(odd_docs, m).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert got[5].score == got[6].score and 0 <= got[4].score <= 1
    assert g.identify(odd_docs.filter("doc_id < 0"), m).count() == 0
    assert {r.lang_pred for r in g.identify(odd_docs, g.train([], s)).collect()} == {"und"}


def test_toxicity_learns_words(spark, prose, odd_docs):
    s = t.Settings(epochs=6)
    sample = [(prose(60) + (" vilekind " if i % 3 == 0 else " ") + prose(60), int(i % 3 == 0)) for i in range(300)]
    m = t.train(sample, s)
    df = spark.createDataFrame([(i, prose(700) + (" vilekind " if i % 2 else " ") + prose(30)) for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in t.toxicity(df, m).collect()}
    assert sum(got[i] == i % 2 for i in got) >= 28
    odd = {r.doc_id: r for r in t.toxicity(odd_docs, m).collect()}
    assert odd[0].score == odd[1].score == odd[2].score == 0 and odd[5].score == odd[6].score
    assert t.toxicity(odd_docs.filter("doc_id < 0"), m).count() == 0
    assert all(r.score == 0 for r in t.toxicity(odd_docs, t.train([], s)).collect())


def test_toxicity_on_the_held_out_rows_of_the_table(spark):
    from ragframe.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    got = [r for r in op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == (r.score >= 0.3) for r in got)
    found = [r.predicted for r in got if toxic[r.doc_id]]
    flagged = [r.predicted for r in got if not toxic[r.doc_id]]
    assert len(found) > 30 and sum(found) / len(found) >= 0.9 and sum(flagged) / len(flagged) <= 0.05


def test_windows_cover_every_word():
    s = t.Settings()
    for n in (1, 5, 24, 25, 36, 37, 100):
        raw = " ".join(f"w{i}" for i in range(n)).encode()
        w = t.Words(s, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert set(w.windows(s)[1].reshape(-1).tolist()) - {-1} == set(range(n))


def test_every_byte_of_a_long_word_is_read():
    s = t.Settings()
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 124, 125, 500):
        raw = rng.integers(97, 123, n).astype(np.uint8)
        w = t.Words(s, raw, np.array([0, n]))
        for g in s.grams:
            for i in range(n - g + 1):
                # as one word of its own the n-gram is the same bytes between spaces
                alone = t.Words(s, raw[i : i + g].copy(), np.array([0, g]))
                assert set(alone.gram.tolist()) & set(w.gram.tolist()), (n, g, i)
        assert set(w.windows(s)[1].reshape(-1).tolist()) - {-1} == set(range(len(w.bucket)))


def test_toxicity_reads_text_without_spaces(spark, prose):
    s = t.Settings(epochs=12)
    joined = lambda n: prose(n).replace(" ", "")
    sample = [(joined(40) + ("vilekind" if i % 3 == 0 else "") + joined(40), int(i % 3 == 0)) for i in range(1200)]
    m = t.train(sample, s)
    df = spark.createDataFrame([(i, joined(60) + ("vilekind" if i % 2 else "") + joined(30)) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in t.toxicity(df, m).collect()}
    assert sum(got[i] == i % 2 for i in got) >= 34


def test_filter_reads_quantised_counts():
    m = Model()
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    counts = rng.integers(1, 5000, 4000)
    f = Filter({0: build_segment(keys, counts, m, 1)}, 1, m)
    got = f.level(keys)
    assert (got >= levels(counts, m.base)).all() and (got == levels(counts, m.base)).mean() > 0.95
    assert (f.level(rng.integers(0, 2**63, 4000).astype(np.uint64)) > 0).mean() < 0.05


def test_filter_has_as_many_bits_among_many_parts():
    m, parts = Model(), 100_000
    rng = np.random.default_rng(1)
    keys, absent = (rng.integers(0, 2**47 // parts, (2, 4000)) << 16).astype(np.uint64)  # all of part 0
    counts = rng.integers(1, 5000, 4000)
    f = Filter({0: build_segment(keys, counts, m, parts)}, parts, m)
    assert 8 * len(f.bits) > 0.99 * m.bits * levels(counts, m.base).sum()
    assert (f.level(absent) > 0).mean() < 0.05


def test_scores_of_many_parts_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = Model(block_mb=0.005)
    got = language_model(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, m).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {r.doc_id: ["<", *re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)), None] for r in docs.collect()}
    learned = [ws for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10]
    c, c2 = Counter(w for ws in learned for w in ws), Counter(p for ws in learned for p in zip(ws, ws[1:], strict=False))
    value = level_value(m.base)
    read = lambda n: value[levels(np.array([n]), m.base)[0]] if n else 0.0
    held = sum(read(k) + 0.1 for w, k in c.items() if w != "<") + 0.1
    total = 0.0
    for r in got:
        want = 0.0
        for a, w in zip(words[r.doc_id], words[r.doc_id][1:], strict=False):
            alone, context, both = (read(c[w]) + 0.1) / held, read(c[a]), read(c2[a, w])
            want += math.log10(m.pair_share * min(both, context) / context + (1 - m.pair_share) * alone if context else alone)
        # false hits alone part them
        assert abs(r.score - want) < 0.03 * abs(want) + 2
        total += abs(r.score - want) / abs(want)
    assert len(got) == len(words) and total / len(got) < 0.01
    # words sum to 1, and bigrams of a context do but for their quantised counts
    assert abs(sum((read(k) + 0.1) / held for w, k in c.items() if w != "<") + 0.1 / held - 1) < 1e-9
    after = Counter()
    for (a, w), k in c2.items():
        after[a] += min(read(k), read(c[a])) / read(c[a])
    assert abs(np.mean(list(after.values())) - 1) < 0.05 and max(after.values()) < 1.35


def test_base_scores_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-10, "")], "doc_id long, text string"))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = language_model(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)), None] for r in docs.collect()}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(words)
    for r in got:
        ws = words[r.doc_id]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
    unseen = [r for r in got if held(r.doc_id)]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_language_model_edges(spark, odd_docs):
    got = {r.doc_id: r for r in language_model(odd_docs, F.lit(False)).collect()}
    assert len(got) == 7 and all(r.n_known == 0 and r.train_tokens == 0 for r in got.values()) and got[0].n_tokens == 1
    assert language_model(odd_docs.filter("doc_id < 0"), F.lit(True)).count() == 0
