"""Operator 2: toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input joins an embedding of the word with the mean embedding of its character n-grams (both hashed). The network reads
windows of words that overlap by half; attention pools a window's states into one probability; a document's score is the highest of
all its windows. It is trained in numpy on a bounded sample, by multiple-instance learning: of a toxic document the window that
scores highest is the example.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_batches, pieces, prefix_hash, span_hash, spread, text_bytes, words
from ragframe.llm.gru import F32, Adam, backward, direction, forward, sigmoid


#: Bytes of a word that are one input; longer words are several.
PIECE = 64


@dataclass(frozen=True)
class Settings:
    """The sample's bounds and the network's size."""

    #: Labelled documents that the network learns from: those labelled 1, those labelled 0, and the longest taken (characters).
    sample: int = 1000
    clean_sample: int = 2800
    sample_chars: int = 4000
    window: int = 24
    stride: int = 12
    hidden: int = 8
    word_inputs: int = 8
    char_inputs: int = 16
    word_buckets: int = 8192
    char_buckets: int = 32768
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 7
    #: Steps of an epoch at least.
    steps: int = 12
    batch: int = 256
    #: Windows of documents that aren't toxic, for each toxic example: so many that score highest, and so many at random.
    negatives: int = 3
    rate: float = 0.01
    wide: int = 4096
    seed: int = 11


def training_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str, label: str, key: str, s: Settings) -> list[tuple[str, int]]:
    """(text, label) of at most `sample` toxic and `clean_sample` other labelled documents, chosen by a hash of the id."""
    l1 = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
    chosen = None
    for y in (0, 1):
        # an id with both labels counts as toxic
        part = l1.filter(F.col("_y") == y).withColumnRenamed("_k", key).filter(may_learn).withColumnRenamed(key, "_k").orderBy(F.xxhash64("_k"), "_k").limit(s.sample if y else s.clean_sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    one = chosen.groupBy("_k").agg(F.max("_y").alias("_y"))
    pool = docs.filter(may_learn & F.col(text).isNotNull() & (F.length(text) <= s.sample_chars)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = pool.join(F.broadcast(one), F.col("_key") == F.col("_k")).orderBy("_key", "_text").limit(2 * (s.sample + s.clean_sample)).collect()
    return [(r["_text"], r["_y"]) for r in rows]


def in_pieces(row: np.ndarray, start: np.ndarray, end: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() with those of over `most` bytes as consecutive pieces of at most so many, each `overlap` bytes into the next."""
    step = most - overlap
    n = np.maximum(1, -(-(end - start - overlap) // step))
    first = np.repeat(start, n) + spread(n) * step
    return np.repeat(row, n), first, np.minimum(first + most, np.repeat(end, n))


class Words:
    """Distinct words of texts: bucket of each and its character n-grams' buckets. Long words, as in text without spaces, are pieces."""

    def __init__(self, s: Settings, data: np.ndarray, off: np.ndarray):
        lower = data.copy()
        up = (data >= 65) & (data <= 90)
        lower[up] += 32
        # pieces overlap by so much that every n-gram is in one of them
        self.row, start, end = in_pieces(*words(lower, off), PIECE, max(s.grams) - 1)
        h = span_hash(prefix_hash(lower), start, end)
        u, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (u % np.uint64(s.word_buckets)).astype(np.int64)
        # the distinct words between spaces, end to end, so that n-grams see where a word begins and ends
        a, n = start[at], end[at] - start[at]
        body = np.full(int((n + 2).sum()), 32, np.uint8)
        head = np.cumsum(n + 2) - (n + 2)
        body[np.repeat(head + 1, n) + spread(n)] = lower[np.repeat(a, n) + spread(n)]
        sums = prefix_hash(body)
        owner, gram = [], []
        for g in s.grams:
            m = np.maximum(0, n + 2 - g + 1)
            p = np.repeat(head, m) + spread(m)
            owner.append(np.repeat(np.arange(len(n), dtype=np.int32), m))
            gram.append((span_hash(sums, p, p + g) % np.uint64(s.char_buckets)).astype(np.int32))
        owner, gram = np.concatenate(owner), np.concatenate(gram)
        order = np.argsort(owner, kind="stable")
        self.owner, self.gram = owner[order], gram[order]
        self.n_grams = np.maximum(1, np.bincount(self.owner, minlength=len(u)))
        self.rows = len(off) - 1

    def windows(self, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Row of each window and its words (time, window), -1 at padding: every word is in one window at least."""
        n = np.bincount(self.row, minlength=self.rows)
        k = np.where(n == 0, 0, np.maximum(1, -(-(n - s.window) // s.stride) + 1))
        row = np.repeat(np.arange(self.rows), k)
        first = (np.cumsum(n) - n)[row] + spread(k) * s.stride
        at = first[None, :] + np.arange(s.window)[:, None]
        inside = at < np.cumsum(n)[row][None, :]
        out = np.full(at.shape, -1, np.int64)
        out[inside] = self.word[at[inside]]
        return row, out

    def inputs(self, p: dict) -> np.ndarray:
        """Inputs of the distinct words, (inputs, word)."""
        total = np.zeros((len(self.n_grams), p["C"].shape[1]), F32)
        has = np.flatnonzero(np.bincount(self.owner, minlength=len(self.n_grams)))
        first = np.append(np.searchsorted(self.owner, has), len(self.owner))
        for i in range(0, len(has), 8192):  # the n-grams' rows are many times the words'
            j = min(len(has), i + 8192)
            total[has[i:j]] = np.add.reduceat(p["C"][self.gram[first[i] : first[j]]], first[i:j] - first[i], axis=0)
        total /= np.sqrt(self.n_grams)[:, None].astype(F32)
        return np.concatenate([p["E"][self.bucket], total], 1).T


def _pool(p: dict, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights (time, batch), pooled states and logits."""
    e = np.matmul(p["a"], h)[:, 0] + (mask - 1) * F32(1e9)
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    z = (h * e[:, None]).sum(0)
    return e, z, (p["w"] @ z + p["c"])[0]


def _states(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Both directions' states joined, (time, 2 hidden, batch)."""
    out, held = [], {}
    for d in "fb":
        xe, m = (x, mask) if d == "f" else (x[::-1], mask[::-1])
        k = p[d + "U"].shape[1]
        got = forward({"U": p[d + "U"]}, xe[:, 3 * k * (d == "b") : 3 * k * (1 + (d == "b"))], m, keep)
        if keep:
            got, held[d] = got
        out.append(got if d == "f" else got[::-1])
    return np.concatenate(out, 1), held


def _projected(p: dict, inputs: np.ndarray) -> np.ndarray:
    """(6 hidden, word + 1): what both directions add for each distinct word; the last column is padding."""
    both = np.concatenate([p["fW"] @ inputs + p["fb"], p["bW"] @ inputs + p["bb"]])
    return np.concatenate([both, np.zeros((both.shape[0], 1), F32)], 1)


def score_windows(p: dict, table: np.ndarray, win: np.ndarray, wide: int) -> np.ndarray:
    """Probability of each window."""
    out = np.empty(win.shape[1], F32)
    for i in range(0, win.shape[1], wide):
        w = win[:, i : i + wide]
        x = np.moveaxis(table[:, w], 0, 1)
        mask = (w >= 0).astype(F32)
        out[i : i + wide] = sigmoid(_pool(p, _states(p, x, mask)[0], mask)[2])
    return out


def train(sample: list[tuple[str, int]], s: Settings) -> dict:
    """Weights; without examples of both labels the network stays as it is drawn and scores about the share of toxic ones."""
    rng = np.random.default_rng(s.seed)
    k, inputs = s.hidden, s.word_inputs + s.char_inputs
    p = {
        "E": (0.1 * rng.standard_normal((s.word_buckets, s.word_inputs))).astype(F32),
        "C": (0.3 * rng.standard_normal((s.char_buckets, s.char_inputs))).astype(F32),
        "a": (0.3 * rng.standard_normal((1, 2 * k))).astype(F32),
        "w": (0.3 * rng.standard_normal((1, 2 * k))).astype(F32),
        "c": np.full((1, 1), -1.0, F32),
    }
    for d in "fb":
        p |= {d + n: v for n, v in direction(rng, k, inputs).items()}
    y = np.array([v for _, v in sample], np.int64)
    model = {"p": p, "settings": s, "learned": bool(len(y)) and 0 < y.sum() < len(y)}
    if not model["learned"]:
        return model
    raw = [t.encode("utf-8", "replace") for t, _ in sample]
    w = Words(s, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    row, win = w.windows(s)
    pos, neg = np.flatnonzero(y[row] == 1), np.flatnonzero(y[row] == 0)
    if not len(pos) or not len(neg):
        model["learned"] = False
        return model
    by_doc = np.split(pos, np.flatnonzero(np.diff(row[pos])) + 1)
    dense = {n: v for n, v in p.items() if n not in "EC"}
    adam = Adam(dense, s.rate)
    seen = {n: np.full(p[n].shape[0], 1e-6, F32) for n in "EC"}
    for epoch in range(s.epochs):
        if epoch == 0:  # short documents first: their few windows are the likeliest to hold what made them toxic
            mine = np.concatenate([d if len(d) <= 4 else d[:0] for d in by_doc] or [pos])
            mine = mine if len(mine) >= 32 else pos
            hard = rng.choice(neg, min(len(neg), s.negatives * len(mine)), replace=False)
        else:
            score = score_windows(p, _projected(p, w.inputs(p)), win, s.wide)
            mine = np.array([d[score[d].argmax()] for d in by_doc])
            top = neg[np.argsort(-score[neg], kind="stable")[: s.negatives * len(mine)]]
            hard = np.unique(np.concatenate([top, rng.choice(neg, min(len(neg), s.negatives * len(mine)), replace=False)]))
        o = np.concatenate([mine, hard])
        t = np.concatenate([np.ones(len(mine)), np.zeros(len(hard))]).astype(F32)
        # a small sample is gone through several times, so that the network takes as many steps
        for _ in range(max(1, -(-s.steps * s.batch // len(o)))):
            order = rng.permutation(len(o))
            for i in range(0, len(order), s.batch):
                at = order[i : i + s.batch]
                _step(p, adam, seen, w, win[:, o[at]], t[at], s)
    return model


def _step(p: dict, adam: Adam, seen: dict, w: Words, win: np.ndarray, y: np.ndarray, s: Settings) -> None:
    """One batch: forward, backward, and an update of dense weights (Adam) and of the rows of the embeddings in it (Adagrad)."""
    used, x = np.unique(win, return_inverse=True)
    x = x.reshape(win.shape)
    pad = int(used[0] == -1)
    own = used[pad:]
    lo, hi = np.searchsorted(w.owner, own), np.searchsorted(w.owner, own + 1)
    n = hi - lo
    gram = w.gram[np.repeat(lo, n) + spread(n)]
    who = np.repeat(np.arange(len(own)), n)
    scale = (1 / np.sqrt(np.maximum(1, n))).astype(F32)
    c = np.zeros((len(own), s.char_inputs), F32)
    np.add.at(c, who, p["C"][gram])
    inp = np.concatenate([p["E"][w.bucket[own]], c * scale[:, None]], 1).T
    inp = np.concatenate([np.zeros((inp.shape[0], pad), F32), inp], 1)
    mask = (win >= 0).astype(F32)
    e = np.moveaxis(inp[:, x], 0, 1)
    both = np.concatenate([np.matmul(p["fW"], e) + p["fb"], np.matmul(p["bW"], e) + p["bb"]], 1)
    h, held = _states(p, both, mask, keep=True)
    a, z, logit = _pool(p, h, mask)
    d = ((sigmoid(logit) - y) / len(y)).astype(F32)
    g = {"w": (z @ d)[None, :], "c": d.sum(keepdims=True)[None, :]}
    dz = p["w"].T @ d[None, :]
    da = (h * dz[None]).sum(1)
    de = a * (da - (a * da).sum(0))
    g["a"] = np.einsum("tn,tkn->k", de, h)[None, :]
    dh = a[:, None] * dz[None] + p["a"].T[None] * de[:, None]
    k, dx_in = s.hidden, np.zeros_like(e)
    for q in "fb":
        part, m, xe = (dh[:, :k], mask, e) if q == "f" else (dh[::-1, k:], mask[::-1], e[::-1])
        dx, g[q + "U"] = backward({"U": p[q + "U"]}, held[q], part, m)
        g[q + "W"] = np.einsum("tgn,tin->gi", dx, xe)
        g[q + "b"] = dx.sum((0, 2))[:, None]
        back = np.matmul(p[q + "W"].T, dx)
        dx_in += back if q == "f" else back[::-1]
    adam.step(g)
    flat = x.reshape(-1)
    d_own = np.stack([np.bincount(flat, dx_in[:, i].reshape(-1), len(used)) for i in range(dx_in.shape[1])], 1)[pad:].astype(F32)
    for name, at, grad in (("E", w.bucket[own], d_own[:, : s.word_inputs]), ("C", gram, (d_own[:, s.word_inputs :] * scale[:, None])[who])):
        u, inv = np.unique(at, return_inverse=True)
        total = np.zeros((len(u), grad.shape[1]), F32)
        np.add.at(total, inv, grad)
        seen[name][u] += (total * total).mean(1)
        p[name][u] -= F32(0.1) * total / np.sqrt(seen[name][u])[:, None]


def score_texts(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The highest window probability of each text; 0 where there is no word."""
    s, p = model["settings"], model["p"]
    out = np.zeros(len(off) - 1)
    if len(data) and model["learned"]:
        w = Words(s, data, off)
        row, win = w.windows(s)
        if len(row):
            np.maximum.at(out, row, score_windows(p, _projected(p, w.inputs(p)), win, s.wide).astype(np.float64))
    return out


def toxicity(docs: DataFrame, model: dict, text: str = "text", keys: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """keys, score and predicted of every whole text, over all overlapping windows.

    Null, empty and blank texts score 0, and so does every text if the sample lacked one of the labels. Rows are judged alone, so
    repeated rows get equal scores; extra columns are left out.
    """
    arrow_batches(docs.sparkSession)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the settings give the weights' number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, off = text_bytes(b.column(len(keys)))
            score = np.concatenate([score_texts(m, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off, 1_000_000)] or [np.zeros(0)])
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keys, "score", "predicted"])

    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double, predicted int")
