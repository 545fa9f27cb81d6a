"""Operator 5: language-model scores from a log-frequency Bloom filter.

The filter holds, for an n-gram counted c times, the entries (n-gram, 1) .. (n-gram, q) with q = 1 + floor(log_b c): a count is read
by probing levels until one is missing, which needs no stored keys or values. Parts of the key space build their own segments, so
that none is merged, and a part probes its segment for the keys of each block: no task holds more than one segment, and an entry has
as many bits at every size of the input. Base scores come from exact counts instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.blocks import KEYS, blocked, key_table, part_of, received, sent
from ragframe.llm.common import cut, mix, release, shards, text_bytes, word_hashes

END, BEGIN = np.uint64(0x5EED0E4D00000001), np.uint64(0x5EED0E4D00000002)
_LEVEL, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Model:
    """The filter's bits and the smoothing; none depends on the input's size."""

    #: Bits of an entry, whatever the input's size.
    bits: float = 10.0
    hashes: int = 5
    #: Base of the logarithm that counts are quantised by.
    base: float = 1.5
    #: Share of the bigram estimate in a probability.
    pair_share: float = 0.3
    #: Megabytes of documents (as stored) of a block.
    block_mb: float = 4.0


def levels(c: np.ndarray, base: float) -> np.ndarray:
    """q of a count; the small epsilon keeps exact powers on their own level."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(base) + 1e-9).astype(np.int64)


def level_value(base: float, most: int = 200) -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers on it (0 for none)."""
    low = np.ceil(base ** np.arange(most) - 1e-9)
    high = np.maximum(low, np.ceil(base ** np.arange(1, most + 1) - 1e-9) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def _places(key: np.ndarray, level: int | np.ndarray, size: np.ndarray, hashes: int) -> list[np.ndarray]:
    a = mix(key + np.asarray(level).astype(np.uint64) * _LEVEL)
    b = mix(a) | np.uint64(1)
    return [((a + np.uint64(i) * b) % size.astype(np.uint64)).astype(np.int64) for i in range(hashes)]


def build_segment(keys: np.ndarray, counts: np.ndarray, m: Model, parts: int) -> bytes:
    """One part's segment: its bits, packed. Its size follows its own entries alone, however many parts there are."""
    q = levels(counts, m.base)
    entries = int(q.sum())
    size = 8 * max(8, int(m.bits * entries) // 8)
    on = np.zeros(size, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        k = keys[q >= level]
        for at in _places(k, level, np.full(len(k), size), m.hashes):
            on[at] = 1
    return np.packbits(on, bitorder="little").tobytes()


class Filter:
    """Segments of some or all parts; level() reads quantised counts by membership probes."""

    def __init__(self, segments: dict[int, bytes], parts: int, m: Model):
        self.m, self.parts = m, parts
        n = np.array([len(segments.get(i, b"")) for i in range(parts)], np.int64)
        self.first = (np.cumsum(n) - n) * 8
        self.size = n * 8
        self.bits = np.frombuffer(b"".join(segments.get(i, b"") for i in range(parts)), np.uint8)
        self.value = level_value(m.base)

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        part = part_of(keys, self.parts)
        alive = np.flatnonzero(self.size[part] > 0)
        level = 0
        while len(alive):
            level += 1
            k, p = keys[alive], part[alive]
            hit = np.ones(len(alive), bool)
            for at in _places(k, level, self.size[p], self.m.hashes):
                i = self.first[p] + at
                hit &= (self.bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
            if level >= len(self.value) - 1:
                break
        return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + word)


def tokens(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and the hash before of each token: the words of a text in lower case (A-Z only) and one end."""
    data, off = text_bytes(col)
    row, _, _, h = word_hashes(data, off, lower=True)
    n = len(off) - 1
    size = np.bincount(row, minlength=n) + 1
    ends = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - size + 1] = BEGIN
    return np.repeat(np.arange(n), size), out, before


def _dealt(values: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The bytes of each run of values."""
    return [x.tobytes() for x in np.split(values, np.cumsum(size)[:-1])] if len(size) else []


def language_model(docs: DataFrame, learns: Column, m: Model = Model(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    score interpolates bigrams with words: pair_share * c(h w) / c(h) + (1 - pair_share) * (c(w) + 0.1) / sum, with c as the filter tells it.
    The words' part sums to 1 exactly; a bigram's counts are quantised apart from its context's, so its part does within some per cent.

    Null is an empty text: one token, the end. Without training rows, N and V are 0 and no token is known; base probabilities are
    then 1. Repeated rows count and score as often as they occur. Extra columns are left out.
    """
    n = shards(docs, m.block_mb, text)
    kind = docs.schema[key].dataType.simpleString()
    dealt = blocked(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns")), "id", n)

    def count(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        row, tok, before = tokens(t["text"])
        learn = np.array(t["learns"].to_pylist(), bool)
        mine = learn[row]
        u, inv = np.unique(tok, return_inverse=True)
        rows = list(sent(block, 0, u, np.bincount(inv[mine], minlength=len(u)), n))
        # pairs that nothing is learned from go too, with count 0: their levels are asked for
        pairs, inv = np.unique(pair_keys(before, tok), return_inverse=True)
        rows += sent(block, 1, pairs, np.bincount(inv[mine], minlength=len(pairs)), n)
        if learn.any():
            rows += sent(block, 2, np.array([BEGIN], np.uint64), np.array([learn.sum()]), n)
        return key_table(rows)

    def resolve(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        blocks, size, keys, c = received(t, 0)
        u, inv = np.unique(keys, return_inverse=True)
        total = np.bincount(inv, c, len(u)).astype(np.int64)
        pair_blocks, pair_size, pk, pc = received(t, 1)
        pu, pinv = np.unique(pk, return_inverse=True)
        pt = np.bincount(pinv, pc, len(pu)).astype(np.int64)
        _, _, bk, bc = received(t, 2)
        often, known = pt > 0, total > 0
        all_keys = np.concatenate([u[known], pu[often], bk[:1]])
        all_counts = np.concatenate([total[known], pt[often], [bc.sum()] if len(bk) else []]).astype(np.int64)
        f = Filter({part: build_segment(all_keys, all_counts, m, n)}, n, m)
        rows = [(b, part, 0, a, lv, 0, 0, 0, 0) for b, a, lv in zip(blocks, _dealt(np.minimum(total, 2**32 - 1).astype("<u4")[inv], size), _dealt(f.level(u).astype(np.uint8)[inv], size), strict=True)]
        rows += [(b, part, 1, b"", lv, 0, 0, 0, 0) for b, lv in zip(pair_blocks, _dealt(f.level(pu).astype(np.uint8)[pinv], pair_size), strict=True)]
        # what the filter holds of all known words, twice to stay whole: the middle of a level may be a half
        mass = int(round(2 * f.value[f.level(u[known])].sum()))
        rows.append((-1, part, 0, b"", b"", int(total.sum()), int(known.sum()), int(f.level(bk[:1]).sum()), mass))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "part", "kind", "data", "levels", "n_tokens", "n_words", "begin", "mass"])

    found = cut(dealt.groupBy("block").applyInArrow(count, KEYS).repartition(n, "part").groupBy("part").applyInArrow(resolve, "block int, part int, kind int, data binary, levels binary, n_tokens long, n_words long, begin long, mass long"))
    release(docs.sparkSession)
    sums = found.filter("block = -1").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_words").alias("n_words"), F.sum("begin").alias("begin"), F.sum("mass").alias("mass")).first()
    total, words, begin, mass = (x or 0 for x in sums)
    norm = total + 0.1 * (words + 1)
    held = mass / 2 + 0.1 * (words + 1)  # over what the filter tells of all words, so that their probabilities sum to 1
    value = level_value(m.base)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, tok, before = tokens(texts["text"])
        u, inv = np.unique(tok, return_inverse=True)
        answers = answers.sort_by("part")
        of = [answers.filter(pa.compute.equal(answers["kind"], k)) for k in (0, 1)]
        c = np.frombuffer(b"".join(x.as_py() for x in of[0]["data"]), "<u4").astype(np.float64)
        single, double = (value[np.frombuffer(b"".join(x.as_py() for x in t["levels"]), np.uint8)] for t in of)
        rows = texts.num_rows
        base = np.bincount(row, np.log10((c + 0.1) / norm)[inv], rows)
        known = np.bincount(row, (c > 0)[inv], rows).astype(np.int64)
        alone = (single + 0.1) / held
        # what stands before a token is a token too, or the begin
        context = np.where(before == BEGIN, value[begin], single[np.minimum(np.searchsorted(u, before), len(u) - 1)])
        _, pair_inv = np.unique(pair_keys(before, tok), return_inverse=True)
        both = np.minimum(double[pair_inv], context)
        p = np.where(context > 0, m.pair_share * both / np.maximum(context, 1) + (1 - m.pair_share) * alone[inv], alone[inv])
        lm = np.bincount(row, np.log10(p), rows)
        size = np.bincount(row, minlength=rows).astype(np.int64)
        return pa.Table.from_arrays([texts["id"], pa.array(size), pa.array(known), pa.array(np.full(rows, total, np.int64)), pa.array(base), pa.array(lm)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = found.filter("block >= 0").select("block", "part", "kind", "data", "levels")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)
