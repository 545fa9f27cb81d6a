"""Operator 6: SentencePiece encoding and decoding over a table of distinct marked words; also the word table of the packer's tokenizer.

A tokenizer whose pieces never join characters across a boundary gives the same ids for the parts as for the whole. So every
batch of texts is cut at such boundaries, each distinct part is encoded once, and ids are joined back by position.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_batches, prefix_hash, span_hash, text_bytes

MARK = "▁"
#: Stands before each part when it is encoded alone; no piece joins it with what follows (checked for every part).
ANCHOR = "\n"
#: Distinct parts that a task keeps; when there are more, its table starts anew. It bounds memory and changes no result.
TABLE_ENTRIES = 1_000_000
_ROUNDS = 4


class HashTable:
    """Numbers of distinct 64-bit hashes in flat arrays: a hash lies in one of four slots, or among the few that found none free."""

    def __init__(self, slots: int = 1 << 16):
        self.count = 0
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.keys, self.numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.rest: dict[int, int] = {}

    def _slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        return ((h >> np.uint64(13 * turn)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        left = None
        for turn in range(_ROUNDS):
            own = h if left is None else h[left]
            at = self._slot(own, turn)
            number = self.numbers[at]
            held = number >= 0
            hit = held & (self.keys[at] == own)
            # a free slot would have been taken: such a hash isn't in the table
            on = np.flatnonzero(held & ~hit)
            if left is None:
                out[hit] = number[hit]
                left = on
            else:
                out[left[hit]] = number[hit]
                left = left[on]
            if not len(left):
                break
        if self.rest and len(left):
            out[left] = [self.rest.get(k, -1) for k in h[left].tolist()]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers distinct hashes that aren't in the table, in their order."""
        new = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        if self.count > len(self.keys) // 3:
            slots = len(self.keys)
            while self.count > slots // 6:
                slots *= 2
            old = self.numbers >= 0
            keys, numbers = np.concatenate([self.keys[old], np.array(list(self.rest), np.uint64), h]), np.concatenate([self.numbers[old], np.array(list(self.rest.values()), np.int32), new])
            self._clear(slots)
        else:
            keys, numbers = h, new
        for turn in range(_ROUNDS):
            at = self._slot(keys, turn)
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[free]  # of several for one slot the last stays
            mine = self.numbers[at] == numbers
            self.keys[at[mine]] = keys[mine]
            keys, numbers = keys[~mine], numbers[~mine]
            if not len(keys):
                return
        self.rest.update(zip(keys.tolist(), numbers.tolist(), strict=True))


class Flat:
    """Values of numbered parts end to end; both arrays grow by doubling."""

    def __init__(self, kind: str):
        self.flat, self.ends, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, items: np.ndarray, size: np.ndarray) -> None:
        """Values of the next len(size) parts."""
        had = int(self.ends[self.n])
        while len(self.flat) < had + len(items):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < self.n + len(size) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[had : had + len(items)] = items
        self.ends[self.n + 1 : self.n + 1 + len(size)] = had + np.cumsum(size)
        self.n += len(size)

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the parts by position end to end, and the size of each."""
        first = self.ends[number]
        n = self.ends[number + 1] - first
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(first - (ends - n), n) + np.arange(total)], n


class PartTable:
    """Values (ids, and what else `encode` gives) of distinct parts by hash.

    `encode` gets the bytes of all texts, the starts and the ends of distinct parts, and returns for each kind of value all items end
    to end and the number of items of each part.
    """

    def __init__(self, encode: Callable[[bytes, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], kinds: tuple[str, ...], entries: int = TABLE_ENTRIES):
        self.encode, self.entries, self.kinds = encode, entries, kinds
        self._empty()

    def _empty(self) -> None:
        self.table, self.values = HashTable(), [Flat(k) for k in self.kinds]

    def look_up(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind the values by position end to end, and the number of items of each part."""
        if self.table.count > self.entries:
            self._empty()
        number = self.table.find(h)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            u, at, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            number[miss] = self.table.count + inv
            self.table.add(u)
            for flat, (items, size) in zip(self.values, self.encode(raw, start[miss[at]], end[miss[at]]), strict=True):
                flat.add(items, size)
        return [flat.gather(number) for flat in self.values]


def flat_bytes(values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Items of all values end to end, and the number of each."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // width


def _piece_coder(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp


def crossing(path: str) -> list[str]:
    """Pieces with a white-space marker after another character; the table of marked words is exact where there is none."""
    sp = _piece_coder(path)
    return [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]


def _loose_bytes(path: str) -> np.ndarray:
    """ASCII characters that no piece of two or more characters has: parts may end before and after them too."""
    sp = _piece_coder(path)
    used = set().union(*(set(p) for i in range(sp.get_piece_size()) if len(p := sp.id_to_piece(i)) > 1 and not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)))
    out = np.zeros(256, bool)
    out[[c for c in range(1, 128) if chr(c) not in used and c != 32]] = True
    return out


def sentencepiece_codes(docs: DataFrame, model: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Begin, pieces and end of every whole text, and what the library decodes from them.

    Columns: keys, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of UTF-8), and with full=True also
    ids (array of int) and decoded. Null and empty texts are encoded as the empty text: begin and end alone. Rows are independent,
    so repeated rows and extra columns do no harm, and an empty table gives none.
    """
    if crossing(model):
        raise ValueError("pieces of this model cross white-space markers; the table of marked words would not be exact")
    arrow_batches(docs.sparkSession)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _piece_coder(model)
        ends = np.zeros(256, bool) | _loose_bytes(model)
        bos, eos = np.array([sp.bos_id()], "<u4").tobytes(), np.array([sp.eos_id()], "<u4").tobytes()

        lead = sp.encode(ANCHOR, num_threads=1)
        # what decode() makes of each piece inside a text: markers become spaces, byte pieces their byte; others than these go to decode()
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        surface = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        odd = {i for i in range(len(pieces)) if sp.is_control(i) or sp.is_unknown(i)}

        def encode(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            for ids in sp.encode([ANCHOR + p for p in parts], num_threads=1):
                if ids[: len(lead)] != lead:
                    raise ValueError("a piece joins a line feed with what follows it")
                own = ids[len(lead) :]
                plain = b"".join([surface[i] for i in own]) if odd.isdisjoint(own) else sp.decode(ids)[len(ANCHOR) :].encode()
                out.append((array("I", own).tobytes(), plain))
            return [flat_bytes([x[0] for x in out], "<u4"), flat_bytes([x[1] for x in out], "u1")]

        known = PartTable(encode, ("<u4", "u1"))
        mark = np.frombuffer(MARK.encode(), np.uint8)
        for b in batches:
            data, off = text_bytes(b.column(b.schema.get_field_index(text)))
            raw_rows = [data[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]
            n_tokens, ids_hex, dec_hex, all_ids, all_dec = [], [], [], [], []
            i = 0
            while i < len(raw_rows):
                j, size = i, 0
                while j < len(raw_rows) and (j == i or size + len(raw_rows[j]) < 1_500_000):
                    size += len(raw_rows[j]) + 1
                    j += 1
                # the library puts one marker before a text that isn't empty
                chunk = [b" " + r if r else b"" for r in raw_rows[i:j]]
                raw = b"".join(chunk)
                d = np.frombuffer(raw, np.uint8)
                o = np.concatenate([[0], np.cumsum([len(c) for c in chunk])]).astype(np.int64)
                start = _part_starts(d, o, ends, mark)
                end = np.append(start[1:], len(d)) if len(start) else start
                h = span_hash(prefix_hash(d), start, end) if len(start) else np.zeros(0, np.uint64)
                (ids, n_ids), (dec, n_dec) = known.look_up(raw, start, end, h)
                row_of = np.searchsorted(start, o)  # parts before each row
                ci, cd = np.concatenate([[0], np.cumsum(n_ids)]), np.concatenate([[0], np.cumsum(n_dec)])
                for k in range(j - i):
                    a, z = row_of[k], row_of[k + 1]
                    body = ids[ci[a] : ci[z]].tobytes()
                    out = bos + body + eos
                    plain = dec[cd[a] : cd[z]].tobytes()[1:]  # the marker that was put before the text
                    n_tokens.append(len(out) // 4)
                    ids_hex.append(hashlib.sha256(out).hexdigest())
                    dec_hex.append(hashlib.sha256(plain).hexdigest())
                    if full:
                        all_ids.append(np.frombuffer(out, "<u4").astype(np.int32))
                        all_dec.append(plain.decode("utf-8", "replace"))
                i = j
            cols = [b.column(b.schema.get_field_index(k)) for k in keys] + [pa.array(n_tokens, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(dec_hex, pa.string())]
            names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_dec, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*dict.fromkeys([*keys]), F.col(text)).mapInArrow(run, schema)


def _part_starts(d: np.ndarray, off: np.ndarray, loose: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """First bytes of parts: row starts, markers (a space or U+2581) after another character, and around loose characters."""
    n = len(d)
    if not n:
        return np.zeros(0, np.int64)
    space = d == 32
    big = np.zeros(n, bool)
    if n >= 3:
        big[: n - 2] = (d[:-2] == mark[0]) & (d[1:-1] == mark[1]) & (d[2:] == mark[2])
    marker = space | big
    tail = space.copy()  # last byte of a marker
    tail[2:] |= big[:-2]
    first = marker.copy()
    first[1:] &= ~tail[:-1]
    odd = loose[d]
    first |= odd
    first[1:] |= odd[:-1]
    first[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(first)
