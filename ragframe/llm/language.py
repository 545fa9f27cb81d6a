"""Operator 9: language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of blocks of a text; a document's probabilities are the mean over all its positions. It is trained
in numpy by backpropagation through time on a bounded sample, and its few kilobytes go to the workers with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_batches, pieces, text_bytes
from ragframe.llm.gru import F32, Adam, backward, direction, forward

PAD = 256


@dataclass(frozen=True)
class Settings:
    """The sample's bound and the network's size."""

    #: Documents of each language that the network learns from, and the longest that is taken (characters).
    sample: int = 300
    sample_chars: int = 20_000
    #: Languages at most; more are an error.
    languages: int = 200
    #: Training blocks of a document.
    blocks: int = 12
    hidden: int = 8
    inputs: int = 12
    #: Bytes of a block; the state starts anew at each.
    block: int = 64
    epochs: int = 6
    batch: int = 256
    rate: float = 0.01
    #: Blocks scored at a time.
    wide: int = 4096
    seed: int = 7


def training_sample(docs: DataFrame, may_learn: Column, text: str, lang: str, key: str, s: Settings) -> list[tuple[str, str]]:
    """(text, language) of at most `sample` documents of each language, chosen by a hash of the id; equal rows count once.

    Only ids and hashes are ranked; the texts of what is chosen, sample x languages rows at most, come from a second pass.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"), may_learn.alias("m"))
    rows = rows.filter("m and l is not null and t is not null").filter(F.length("t") <= s.sample_chars).select("k", "l", F.xxhash64("t").alias("h"), "t")
    if len(rows.select("l").distinct().limit(s.languages + 1).collect()) > s.languages:
        raise ValueError(f"more than {s.languages} languages")
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "h"))
    chosen = rows.select("k", "l", "h").distinct().withColumn("r", rank).filter(F.col("r") <= s.sample).select("l", "h", F.coalesce(F.xxhash64("k"), F.lit(0)).alias("kh"))
    found = rows.withColumn("kh", F.xxhash64("k")).join(F.broadcast(chosen), ["l", "h", "kh"], "left_semi")  # sample x languages rows at most
    got = found.groupBy("kh", "l", "h").agg(F.min("t").alias("t")).orderBy("kh", "l", "h").collect()
    return [(r["t"], r["l"]) for r in got]


def blocks_of(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each block, and the blocks (time, block) of byte numbers, padded at the end."""
    n = -(-(off[1:] - off[:-1]) // size)
    row = np.repeat(np.arange(len(n)), n)
    start = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
    at = start[None, :] + np.arange(size)[:, None]
    inside = at < off[row + 1][None, :]
    out = np.full(at.shape, PAD, np.int16)
    out[inside] = data[at[inside]]
    return row, out


def train(sample: list[tuple[str, str]], s: Settings) -> dict:
    """Weights and the learned languages, in sorted order."""
    rng = np.random.default_rng(s.seed)
    langs = sorted({lang for _, lang in sample})
    number = {v: i for i, v in enumerate(langs)}
    xs, ys = [], []
    for t, lang in sample:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        if not len(raw):
            continue
        _, b = blocks_of(raw, np.array([0, len(raw)]), s.block)
        pick = rng.permutation(b.shape[1])[: s.blocks]
        xs.append(b[:, pick])
        ys += [number[lang]] * len(pick)
    k, n_lang = s.hidden, max(1, len(langs))
    p = {"E": (0.5 * rng.standard_normal((s.inputs, 257))).astype(F32), "V": (rng.standard_normal((n_lang, 2 * k)) * 0.3).astype(F32), "o": np.zeros((n_lang, 1), F32)}
    for d in "fb":
        p |= {d + n: v for n, v in direction(rng, k, s.inputs).items()}
    model = {"langs": langs, "p": p, "hidden": k, "block": s.block, "wide": s.wide}
    if not xs or len(langs) < 2:
        return model
    x, y = np.concatenate(xs, 1), np.array(ys)
    adam = Adam(p, s.rate)
    steps = s.epochs * -(-x.shape[1] // s.batch)
    done = 0
    for _ in range(s.epochs):
        order = rng.permutation(x.shape[1])
        for i in range(0, len(order), s.batch):
            o = order[i : i + s.batch]
            adam.step(_gradients(p, x[:, o], y[o], k), 1 - 0.9 * done / steps)
            done += 1
    return model


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, k: int) -> dict:
    """Gradients of the mean cross-entropy over all positions that aren't padding."""
    t, n = x.shape
    real = (x != PAD).astype(F32)
    e = np.moveaxis(p["E"][:, x], 0, 1)  # time, inputs, batch
    held, hs = {}, {}
    for d in "fb":
        xe, m = (e, real) if d == "f" else (e[::-1], real[::-1])
        w = {"U": p[d + "U"]}
        hs[d], held[d] = forward(w, np.matmul(p[d + "W"], xe) + p[d + "b"], m, keep=True)
    h = np.concatenate([hs["f"], hs["b"][::-1]], 1)
    logit = np.matmul(p["V"], h) + p["o"]
    logit -= logit.max(1, keepdims=True)
    q = np.exp(logit)
    q /= q.sum(1, keepdims=True)
    q[:, y, np.arange(n)] -= 1
    q *= (real / max(1.0, float(real.sum())))[:, None, :]
    g = {"V": np.einsum("tln,thn->lh", q, h), "o": q.sum((0, 2))[:, None].astype(F32)}
    dh = np.matmul(p["V"].T, q)
    de = np.zeros_like(e)
    for d in "fb":
        part = dh[:, :k] if d == "f" else dh[::-1, k:]
        xe, m = (e, real) if d == "f" else (e[::-1], real[::-1])
        dx, du = backward({"U": p[d + "U"]}, held[d], part, m)
        g[d + "U"] = du
        g[d + "W"] = np.einsum("tgn,tin->gi", dx, xe)
        g[d + "b"] = dx.sum((0, 2))[:, None]
        back = np.matmul(p[d + "W"].T, dx)
        de += back if d == "f" else back[::-1]
    dE = np.zeros_like(p["E"])
    flat = x.reshape(-1)
    for i in range(dE.shape[0]):
        dE[i] = np.bincount(flat, de[:, i].reshape(-1), 257)
    g["E"] = dE
    return g


class Scorer:
    """Mean probabilities of the learned languages over all bytes of each text."""

    def __init__(self, model: dict):
        self.m = model
        p, k = model["p"], model["hidden"]
        self.tables = {}
        for d in "fb":
            t = p[d + "W"] @ p["E"] + p[d + "b"]
            t[:, PAD] = 0
            t[:k, PAD] = 40.0  # the update gate is shut at padding: the state stays
            self.tables[d] = t.astype(F32)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, m = len(off) - 1, self.m
        langs = len(m["langs"])
        total = np.zeros((n, langs))
        row, x = blocks_of(data, off, m["block"])
        for i in range(0, len(row), m["wide"]):
            r, b = row[i : i + m["wide"]], x[:, i : i + m["wide"]]
            got = self._blocks(b)
            for j in range(langs):
                total[:, j] += np.bincount(r, got[j], n)
        size = np.maximum(1, off[1:] - off[:-1])
        return total / size[:, None]

    def _blocks(self, b: np.ndarray) -> np.ndarray:
        """Sums of the probabilities over the positions of each block."""
        p, k = self.m["p"], self.m["hidden"]
        t, n = b.shape
        langs = p["V"].shape[0]
        logit = np.empty((t, langs, n), F32)
        for d in "fb":
            tab, u = self.tables[d], p[d + "U"]
            v = np.ascontiguousarray(p["V"][:, :k] if d == "f" else p["V"][:, k:])
            u2, un = u[: 2 * k], u[2 * k :]
            h = np.zeros((k, n), F32)
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                x = tab.take(b[s], axis=1)
                g = u2 @ h
                g += x[: 2 * k]
                np.negative(g, out=g)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c = un @ h
                c *= g[k:]
                c += x[2 * k :]
                np.tanh(c, out=c)
                h -= c
                h *= g[:k]
                h += c
                if d == "f":
                    np.add(v @ h, p["o"], out=logit[s])
                else:
                    logit[s] += v @ h
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        logit *= (b != PAD)[:, None, :]
        return logit.sum(0, dtype=np.float64)


def identify(docs: DataFrame, model: dict, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score of every whole text.

    A text that is null or has no letter is `und` with score 0; so is every text if no language was learned. Ties go to the
    language that sorts first. Rows are judged alone.
    """
    arrow_batches(docs.sparkSession)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    langs = np.array(model["langs"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            data, off = text_bytes(b.column(len(keys)))
            has = np.array(b.column(len(keys) + 1).to_pylist(), bool)
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if len(langs):
                for i, j in pieces(off):
                    q = scorer(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    pred[i:j], score[i:j] = langs[q.argmax(1)], q.max(1)
            pred[~has], score[~has] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(pred.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], [*keys, "lang_pred", "score"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keys, F.col(text).alias("_text"), letter.alias("_letter")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
