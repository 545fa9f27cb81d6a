import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ragframe.llm.bpe import letter_bytes
from ragframe.llm.packing import Packing, PartEncoder, _bins, best_fit, crossover, evolve, first_people, fitness, mutate, pack
from ragframe.llm.tokens import HashTable, PartTable, crossing, flat_bytes, sentencepiece_codes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")


def test_no_piece_crosses_a_marker():
    assert crossing(MODEL) == []


def test_codes_are_the_librarys(spark, odd_docs):
    rng = random.Random(1)
    texts = [None, "", "  ", " a", "a ", "\n", "\n\n x\n", "a▁b ▁", "<s> </s> <0x0A> <unk>", "日本語 テスト\tx", "😀😀 a", "   a   b\n\n  c\r\nd", "　x y", "x" * 3000]
    texts += ["".join(rng.choice(" \n\tab▁éß日😀.<>sth\x85") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in sentencepiece_codes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, full=True).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens) == (ids, len(ids)), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == sp.decode(ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codes(odd_docs, MODEL).count() == 7 and sentencepiece_codes(odd_docs.filter("doc_id < 0"), MODEL).count() == 0


def packed(df):
    rows = pack(df, BPE).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    return rows, by


def test_packing_whole_documents(spark, prose, odd_texts):
    rng = random.Random(2)
    odd = ["A,b c<|startoftext|>D <|ENDOFTEXT|> x,\x02y 12ab3.4's,'S", "ÉA,é,B;c..'ll 1é2 don'T, ,'s 'é',x", "a\x02 b", "é,áb ①2 …,…a \x1c b\x85c　d"]
    texts = [*odd_texts, *odd, *[prose(rng.randint(1, 1500)) for _ in range(120)]]
    rows, by = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    tok = Tokenizer.from_file(BPE)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, x in enumerate(texts):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 1]
        assert sorted(got[i]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_genetic_operators_keep_every_piece():
    rng = random.Random(5)
    size = [rng.randint(1, 60) for _ in range(200)]
    people = []
    for _ in range(4):
        order = list(range(200))
        rng.shuffle(order)
        bins, load = [], []
        for i in order:  # a poor start: next fit
            if load and load[-1] + size[i] <= 100:
                bins[-1].append(i)
                load[-1] += size[i]
            else:
                bins.append([i])
                load.append(size[i])
        people.append(bins)
    for child in (crossover(people[0], people[1], size, 100, rng), mutate(people[0], size, 100, rng)):
        assert sorted(i for b in child for i in b) == list(range(200)) and all(sum(size[i] for i in b) <= 100 for b in child)
    best = evolve(people, size, Packing(capacity=100, generations=30), rng)[0]
    assert len(best) < min(map(len, people)) and len(best) <= -(-sum(size) // 100) + 2
    assert _bins([0, 1, 0]) == [[0, 2], [1]]


def test_best_fit_takes_the_fullest_bin():
    bins, load = [[0], [1]], [5, 8]
    best_fit(bins, load, [2], [5, 8, 2], 10)
    assert bins == [[0], [1, 2]] and load == [5, 10]


def test_merges_are_the_librarys():
    rng = random.Random(12)
    letters = "etaoinshrdlucmfwypvbgkqjxz" * 3 + "éàüößñçÉÜÀÿ"
    words = ["a", "ß", "ÿ", "THE", "aaaaaaa", "international", "Übergrößenträger", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(3000))]
    raw = " ".join(words).encode()
    n = np.array([len(w.encode()) for w in words])
    end = np.cumsum(n + 1) - 1
    encoder = PartEncoder(BPE)
    ((ids, size),) = encoder(raw, end - n, end)
    assert encoder.letters is not None
    ends = np.cumsum(size)
    for w, a, b in zip(words, ends - size, ends, strict=True):
        assert ids[a:b].tolist() == encoder.tok.encode(w, add_special_tokens=False).ids, w
    assert letter_bytes(np.frombuffer("aZ1.é×÷ÿß–".encode(), np.uint8)).tolist() == [True, True, False, False, *[True] * 2, *[False] * 4, *[True] * 4, *[False] * 3]


def test_parts_go_to_the_library_where_the_merges_differ():
    encoder = PartEncoder(BPE)
    encoder.letters.made = encoder.letters.made[::-1].copy()
    raw = b"international business"
    ((ids, size),) = encoder(raw, np.array([0, 14]), np.array([13, 22]))
    assert encoder.letters is None and ids.tolist() == encoder.tok.encode(raw.decode(), add_special_tokens=False).ids and size.sum() == len(ids)


def test_hash_table_numbers_every_key():
    rng = np.random.default_rng(3)
    t, known = HashTable(64), {}
    for n in (5, 100, 3000, 20_000):
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFFFF00))  # many share their first slot
        h = h[t.find(h) < 0]
        t.add(h)
        known |= {k: len(known) + i for i, k in enumerate(h.tolist())}
        keys = np.array(list(known), np.uint64)
        assert t.find(keys).tolist() == list(known.values()) and (t.find(keys + np.uint64(1)) < 0).all()


def test_part_table_starts_anew_without_change():
    calls = []

    def encode(raw, start, end):
        calls.append(len(start))
        parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return [flat_bytes(parts, "u1")]

    t = PartTable(encode, ("u1",), entries=3)
    raw = b"abcabcdefgabc"
    start, end = np.array([0, 3, 6, 7, 8, 10]), np.array([3, 6, 7, 8, 10, 13])
    h = np.array([hash(raw[a:b]) & (2**64 - 1) for a, b in zip(start, end, strict=True)], np.uint64)
    for _ in range(3):
        ((items, size),) = t.look_up(raw, start, end, h)
        assert items.tobytes() == raw and size.tolist() == [3, 3, 1, 1, 2, 3]
    assert calls == [4, 4, 4]  # more than three entries: each call begins with an empty table


def test_regions_evolve_and_sequences_have_numbers_of_their_own(spark, prose):
    rng = random.Random(4)
    size = [rng.randint(5, 400) for _ in range(300)]
    p = Packing(capacity=1000)
    people = first_people(size, p, rng)
    best = evolve(people, size, Packing(capacity=1000, generations=20), rng)[0]
    assert fitness(best, size, 1000) > max(fitness(x, size, 1000) for x in people)
    texts = [prose(rng.randint(1, 900)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, region int, number int, size string, settled int")
    rows = pack(df, BPE, Packing(region=20)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 and min(v)[0] == 0 for v in by.values()) and len({r.doc_id for r in rows}) == 150
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 2
