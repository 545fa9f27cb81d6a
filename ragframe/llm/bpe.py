"""Byte-pair encoding of many words of Latin letters at once, in numpy, by the merges of a given tokenizer file.

A word is a row of symbols. Each round merges, in every row, the first pair of least rank, which is the order in which merges are
defined. It serves words that the tokenizer's pre-tokenizer takes whole and its normalizer only lower-cases; that its file is of that
kind, and that the ids are the library's, is checked by the caller on words of each task.
"""

from __future__ import annotations

import json

import numpy as np

from ragframe.llm.common import mix
from ragframe.llm.tokens import HashTable

NONE = np.int32(np.iinfo(np.int32).max)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32  # the second byte of a Latin-1 capital


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of ASCII or Latin-1 (the two-byte ones that begin with C3, but for the signs of times and division)."""
    low = data | np.uint8(32)
    out = (low >= 97) & (low <= 122) & (data < 128)
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] & 0xC0 == 0x80) & (data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    out[at] = out[at + 1] = True
    return out


def byte_symbols() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones are their own, the others follow 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class LetterBPE:
    """Ids of words of ASCII and Latin-1 letters, in either case alike."""

    #: Longest word that is encoded here, in bytes.
    longest = 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain:
            raise ValueError("not a plain byte-pair model")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        symbols = byte_symbols()
        for b in (*range(97, 123), 0xC3, *range(0x80, 0xC0)):  # one that is missing is an error: the file is of another kind
            self.inner[b], self.last[b] = vocab[symbols[b]], vocab[symbols[b] + suffix]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.uint64(max(vocab.values()) + 1)
        a, b = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.ranks = HashTable(1 << 20)
        self.ranks.add(mix(a * self.size + b))  # numbered in the order of merges

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge or no symbol."""
        out = np.full(a.shape, NONE, np.int32)
        both = (a >= 0) & (b >= 0)
        r = self.ranks.find(mix(a[both].astype(np.uint64) * self.size + b[both].astype(np.uint64)))
        out[both] = np.where(r < 0, NONE, r)
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end] end to end, and the number of each."""
        n = end - start
        order = np.argsort(n, kind="stable")
        rows, size = [], np.zeros(len(n), np.int64)
        for i in range(0, len(order), at_once):
            own = order[i : i + at_once]
            ids = self._merged(data, start[own], n[own])
            size[own] = (ids >= 0).sum(1)
            rows.append(ids)
        ends = np.cumsum(size)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, ids in enumerate(rows):
            own = order[k * at_once : (k + 1) * at_once]
            r, c = np.nonzero(ids >= 0)
            out[(ends - size)[own][r] + c] = ids[r, c]
        return out, size

    def _merged(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row of ids for each word, filled up with -1."""
        wide = int(n.max(initial=1))
        col = np.arange(wide)
        inside = col < n[:, None]
        byte = _LOWER[data[np.minimum(start[:, None] + col, len(data) - 1)]]
        sym = np.full((len(n), wide + 1), -1, np.int32)
        sym[:, :wide] = np.where(inside, np.where(col == n[:, None] - 1, self.last[byte], self.inner[byte]), -1)
        out = np.full((len(n), wide), -1, np.int32)
        rank = self.rank(sym[:, :-1], sym[:, 1:])
        alive = np.arange(len(n))
        while len(alive):
            at = rank.argmin(1)
            row = np.arange(len(alive))
            best = rank[row, at]
            more = best != NONE
            if not more.all():
                out[alive[~more]] = sym[~more, :wide]
                alive, sym, rank, at, best = alive[more], sym[more], rank[more], at[more], best[more]
                row = row[: len(alive)]
                if not len(alive):
                    break
            sym[row, at] = self.made[best]
            # what stands after the merged pair moves one place to the left
            later = col[None, :] > at[:, None]
            sym[:, :wide] = np.where(later, sym[:, 1:], sym[:, :wide])
            rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            sym[:, wide], rank[:, -1] = -1, NONE
            left = np.maximum(at - 1, 0)
            rank[row, left] = np.where(at > 0, self.rank(sym[row, left], sym[row, left + 1]), rank[row, left])
            rank[row, at] = self.rank(sym[row, at], sym[row, at + 1])
        return out
