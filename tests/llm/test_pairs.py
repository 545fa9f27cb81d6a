import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ragframe.llm.neardup import Settings as Near
from ragframe.llm.neardup import components, jaccard, near_duplicates, samples, similarities
from ragframe.llm.neighbours import Hasher, Range, Settings, directions, neighbours, templates


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_brute_force(spark, prose):
    rng = random.Random(9)
    texts, family = [], []
    for f in range(30):
        words = prose(rng.randint(80, 200)).split()
        texts.append(" ".join(words))
        family.append(f)
        for _ in range(rng.randint(0, 40) if f % 5 == 0 else rng.randint(0, 2)):
            edit = list(words)
            edit[rng.randrange(len(edit))] = f"new{rng.random()}"
            texts.append(" ".join(edit) if rng.random() < 0.7 else " ".join(words))
            family.append(f)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if sim >= 0.85:
                assert got[i] == got[j]
            if family[i] != family[j]:
                assert got[i] != got[j]
    assert all(got[i] == min(k for k in got if got[k] == got[i]) for i in got)


def test_all_pairs_of_large_buckets_are_compared(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(500):
        edit = list(base)
        for j in range(2):
            edit[rng.randrange(100)] = f"new{i}-{j}"
        texts.append(" ".join(edit))
    # small blocks, so that a bucket has several
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Near(bucket_texts=90)).collect()}
    sets = [shingle_set(t) for t in texts]
    sim = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])

    def classes(least):
        label = np.arange(len(sets))
        while (low := np.where(sim >= least, label[None, :], len(sets)).min(1)).tolist() != label.tolist():
            label = low
        return label

    # rare and frequent shingles weigh 1.03 to 1, so a similarity near the threshold may fall on either side
    sure, may = classes(0.81), classes(0.79)
    for i in range(len(sets)):
        assert got[i] == got[int(sure[i])] and may[i] == may[got[i]]


def test_similarities_are_those_of_pairs():
    rng = np.random.default_rng(5)
    vec = []
    for _ in range(30):
        sh = np.unique(rng.integers(1, 60, 40).astype(np.uint64))
        vec.append(sh.tobytes() + (rng.integers(1, 4, len(sh)) * rng.uniform(1, 1.03, len(sh))).astype("<f4").tobytes())
    left = np.array([0, 3, 29])
    assert np.allclose(similarities(vec, left, 16), [[jaccard(vec[i], v) for v in vec] for i in left])


def test_near_duplicate_edges(spark, odd_docs):
    got = {r.doc_id: r.class_id for r in near_duplicates(odd_docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert near_duplicates(odd_docs.filter("doc_id < 0")).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    sh = np.sort(rng.integers(1, 2**62, 60).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    sig = samples(np.repeat([0, 1], 60), np.concatenate([sh, sh]), np.concatenate([a, b]), 2, 600)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.07
    x, y = (sh.tobytes() + w.astype("<f4").tobytes() for w in (a, b))
    assert abs(jaccard(x, y) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 1e-6


def test_signing_a_block_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from ragframe.llm import neardup
    from ragframe.llm.common import text_bytes, word_hashes

    rng = random.Random(1)
    some = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(1000)]
    texts = ["", " \n ", None, *some, *some, *some, "one", "x " * 2_000_000, ""]  # the long row is over a piece alone
    data, off = text_bytes(pa.array(texts))
    row, start, end, h = word_hashes(data, off)
    at = len(row) - 2_000_001  # the long row is all but equal; before it, hashes don't depend on the place
    assert row[at] == len(texts) - 3 and [len(x) for x in (start, end, h)] == [len(row)] * 3 and data[start[at] : end[at]].tobytes() == b"one"
    assert np.array_equal(h[:300_000], h[300_000:600_000]) and len(np.unique(h[-2_000_000:])) == 1

    def peak(f):
        tracemalloc.start()
        got = f()
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, held / 1e6

    data, off = text_bytes(pa.array(some * 3))
    word_hashes(data, off)  # tables of powers are kept
    _, held = peak(lambda: word_hashes(data, off))
    assert held < 12 * len(data) / 1e6  # 19 bytes for each of the text before
    row, sh, tf = neardup.weighted(*neardup.shingles(data, off, 5), 3000)
    sig, held = peak(lambda: neardup.samples(row, sh, tf.astype(float), 3000, 27))
    assert held < 40  # 72 MB before
    one = neardup.samples(row[: len(row) // 3], sh[: len(row) // 3], tf[: len(row) // 3].astype(float), 1000, 27)
    assert np.array_equal(sig[:1000], one) and np.array_equal(sig[2000:], one)
    assert all(np.array_equal(x, y) for x, y in zip(neardup.shingle_counts(data, off, 5), (row, sh, tf), strict=True))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
    assert {k: v for k, v in got.items() if k != v} == want


def test_probes_come_in_order_of_expected_score():
    m, n = 4, 40
    far = lambda j: 2 * m + 1 - j
    score = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - far(j) / (m + 1) + far(j) * (far(j) + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    sets = [tuple(x for x in row if x < 2 * m) for row in templates(m, n).tolist()]
    total = [sum(score[i] for i in t) for t in sets]
    # every subset that moves no function twice, in order
    want = sorted(sum(score[i] for i in c) for r in range(m + 1) for c in itertools.combinations(range(2 * m), r) if len({min(i, 2 * m - 1 - i) for i in c}) == r)[:n]
    assert sets[0] == () and len(set(sets)) == n and np.allclose(total, want)


def test_probed_keys_are_those_of_moved_points():
    x = np.random.default_rng(9).standard_normal((5, 8))
    h = Hasher(8, {0: Range(4.0, 0.7, 3)}, Settings(tables=2))
    keys = h.query_keys(x, 0, 27)  # all moves of three functions
    assert keys.shape == (5, 2, 27) and all(len(set(k.tolist())) == 27 for q in keys for k in q)
    y = np.concatenate([directions(x), np.zeros((5, 1))], 1)
    slots = np.floor(np.tensordot(y, h.a, 1) / 0.7 + h.b).astype(np.int64)
    for moves in itertools.product((-1, 0, 1), repeat=3):
        sums = ((slots + np.array(moves)).view(np.uint64) * h.step).sum(2, dtype=np.uint64)
        own = h._keys(sums, 0, 0)
        assert all(own[i, t] in keys[i, t] for i in range(5) for t in range(2))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[1000:1100] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(x[m[1]] @ x[q] - m[2]) < 1e-9 for m in mine)
        hit += len({m[1] for m in mine} & set(order.tolist()))
    assert set(got) == set(range(0, 1500, 20)) and hit / (20 * len(got)) >= 0.9


def recall(spark, x, s):
    """Share of the true 20 nearest that every 20th vector finds; each finds 20 rows."""
    got = {}
    for r in neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, s).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, len(x), 20)) and all(len(g) == 20 for g in got.values())
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    return np.mean([len(set(got[q]) & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in got])


def test_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one = x.copy()
    one[5] *= 10
    assert recall(spark, one, Settings()) >= 0.9
    assert recall(spark, x * rng.lognormal(0, 1.5, (2000, 1)), Settings()) >= 0.9


def test_neighbours_lower_the_functions_until_enough_is_found(spark):
    x = np.random.default_rng(7).standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, Settings(tables=2, probes=4)) >= 0.9


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_neighbours_with_repeated_keys_and_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 8))
    x[40:140] = x[0]
    rows = [(i, v.tolist(), 1.0, 2, "k", 3) for i, v in enumerate(x)] + [(20, x[20].tolist(), 1.0, 2, "k", 3), (21, (x[21] + 9).tolist(), 1.0, 2, "k", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int, p string, h int")
    x[21] = min(x[21].tolist(), (x[21] + 9).tolist())  # the least vector stands for a repeated key
    got = {}
    for r in neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted(got[q])
        want = np.lexsort((np.arange(300), -np.round(s, 9)))[:20].tolist()
        assert [m[0] for m in mine] == list(range(1, 21)) and len({m[1] for m in mine}) == 20
        assert len({m[1] for m in mine} & set(want)) >= 18
    equal = [m[1] for m in sorted(got[0]) if 40 <= m[1] < 140]
    assert equal and equal == list(range(40, 40 + len(equal)))  # of equal vectors the smaller keys
    assert neighbours(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    texts = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.5, 0.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours(texts, F.col("vec_id") == "b").orderBy("rank").collect()] == [("b", "a"), ("b", "c")]


def test_classes_of_the_table_against_brute_force(spark):
    """Every class of the 1000 documents is that of the exact weighted similarities of all pairs of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    first: dict[str, int] = {}
    label = {k: first.setdefault(texts[k], k) if words[k] else k for k in sorted(texts)}
    bags = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in words.items() if label[k] == k and w}
    df = Counter(x for c in bags.values() for x in c)
    rise = 1 / math.log(len(bags))
    weight = {k: {x: n * (1 + Near().idf_span * (1 - rise * math.log(df[x]))) for x, n in c.items()} for k, c in bags.items()}
    holders = defaultdict(list)
    for k, v in weight.items():
        for x in v:
            holders[x].append(k)
    pairs = {(a, b) for own in holders.values() if len(own) > 1 for a in own for b in own if a < b}
    links = []
    for a, b in pairs:
        low = sum(min(w, weight[b].get(x, 0.0)) for x, w in weight[a].items())
        if low / (sum(weight[a].values()) + sum(weight[b].values()) - low) >= 0.8 - 1e-6:
            links.append((a, b))
    assert links
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    for k in label:
        if words[k]:
            label[k] = label[first[texts[k]]]
    assert got == label
