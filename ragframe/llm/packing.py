"""Operator 4: packing by a grouping genetic algorithm on islands.

Documents are tokenised, over-long ones cut, and the pieces dealt into regions of bounded size. Several islands evolve packings of
the same region: an individual is a grouping (a list of bins), crossover injects whole well-filled bins of one parent into the
other, drops bins that hold duplicates, and best-fits what they held. Between epochs the islands of a region exchange their elites.
What the best island leaves in loosely filled bins goes to the next level's regions, until one region is left.
"""

from __future__ import annotations

import bisect
import os
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.bpe import LetterBPE, letter_bytes
from ragframe.llm.common import arrow_batches, cut, pieces, prefix_hash, span_hash, spread, text_bytes, words
from ragframe.llm.tokens import PartTable, flat_bytes


@dataclass(frozen=True)
class Packing:
    """Sizes of the search. None depends on the data, so every size is searched alike."""

    capacity: int = 4096
    separator: int = 1
    #: Pieces of a region, on average.
    region: int = 1500
    islands: int = 2
    population: int = 4
    epochs: int = 2
    generations: int = 6
    #: Bins filled to this share are settled when their region is; others go to the next level.
    settled: float = 0.98


#: Stands between parts that are encoded together: one pre-token and one id of its own.
BETWEEN = "\x02"
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[ord("'")] = 0  # contractions begin with it
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


def at_class_changes(d: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where a Latin letter, ASCII digit or punctuation mark follows another of these kinds."""
    c = _CLASS[d]
    c[letter_bytes(d)] = 1
    inside = np.zeros(len(d) + 1, bool)
    inside[1:-1] = (c[1:] != c[:-1]) & (c[1:] > 0) & (c[:-1] > 0)
    cuts = np.flatnonzero(inside)
    s, e = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return row[np.searchsorted(start, s, "right") - 1], s, e


def encode_parts(tok, parts: list[str], at_once: int = 2000) -> list[bytes]:
    """Ids of each part as bytes. Parts go to the tokenizer together, between marks; its objects for each call are large."""
    ids = lambda t: tok.encode_batch_fast([t], add_special_tokens=False)[0].ids
    mark = ids(BETWEEN)[0]
    out = []
    for i in range(0, len(parts), at_once):
        own = parts[i : i + at_once]
        got = np.array(ids(f" {BETWEEN} ".join([*own, ""])), "<u4")
        at = np.flatnonzero(got == mark)
        if len(at) == len(own):
            out += [got[a:b].tobytes() for a, b in zip(np.append(0, at[:-1] + 1).tolist(), at.tolist(), strict=True)]
        else:  # a part holds the mark itself
            out += [np.array(ids(p), "<u4").tobytes() for p in own]
    return out


class PartEncoder:
    """Ids of parts: words of Latin letters by the tokenizer's merges, many at once; all others by the library.

    The first words of each task go through both; where they differ, or the file is of another kind, all go to the library.
    """

    def __init__(self, path: str, checked: int = 200):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.checked = checked
        try:
            self.letters = LetterBPE(path)
        except (ValueError, KeyError):
            self.letters = None

    def special(self) -> list[bytes]:
        return [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    def by_library(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return flat_bytes(encode_parts(self.tok, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u4")

    def __call__(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.letters is None:
            return [self.by_library(raw, start, end)]
        d = np.frombuffer(raw, np.uint8)
        odd = np.concatenate([[0], np.cumsum(~letter_bytes(d))])
        plain = (odd[end] == odd[start]) & (end - start <= self.letters.longest)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, size = self.letters.encode(d, start[at], end[at])
        if self.checked and len(at):
            some = at[: self.checked]
            self.checked = max(0, self.checked - len(some))
            want, n = self.by_library(raw, start[some], end[some])
            if not np.array_equal(n, size[: len(some)]) or not np.array_equal(want, ids[: int(n.sum())]):
                self.letters = None
                return [self.by_library(raw, start, end)]
        if not len(rest):
            return [(ids.astype("<u4"), size)]
        other, other_size = self.by_library(raw, start[rest], end[rest])
        # both kinds back in the order of the parts
        n = np.zeros(len(start), np.int64)
        n[at], n[rest] = size, other_size
        first = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), "<u4")
        out[np.repeat(first[at], size) + spread(size)] = ids
        out[np.repeat(first[rest], other_size) + spread(other_size)] = other
        return [(out, n)]


def token_pieces(docs: DataFrame, tokenizer: str, p: Packing, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (tells repeated keys apart), piece, start, length, ids_crc32 of every document's ids with the separator after them.

    Parts that no pre-token crosses (words, cut again where Latin letters, digits and punctuation meet) are encoded once for each
    task's table, in either case alike, and joined by position.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = PartEncoder(tokenizer)
        special = encoder.special()
        known = PartTable(encoder, ("<u4",))
        for b in batches:
            data, off = text_bytes(b.column(2))
            out: list[list] = [[], [], [], [], [], []]
            keys, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in pieces(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                raw = d.tobytes()
                plain = not any(x in raw for x in special)
                row, start, end = words(d, o)
                if plain:
                    row, start, end = at_class_changes(d, row, start, end)
                h = span_hash(prefix_hash(d, lower=plain), start, end)
                ((ids, n),) = known.look_up(raw, start, end, h)
                ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(row, np.arange(j - i + 1))]
                for k in range(j - i):
                    own = ids[ends[k] : ends[k + 1]].tobytes() + np.array([p.separator], "<u4").tobytes()
                    size = len(own) // 4
                    for m, s in enumerate(range(0, size, p.capacity)):
                        part = own[4 * s : 4 * (s + p.capacity)]
                        for c, v in zip(out, (keys[i + k], rows[i + k], m, s, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *[pa.array(c, pa.int64()) for c in out[3:]]], ["doc", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, row long, piece int, start long, length long, ids_crc32 long")


# A grouping is a list of bins; a bin is a list of piece numbers. Sizes are in `size`, capacity in `cap`.


def best_fit(bins: list[list[int]], load: list[int], loose: list[int], size: list[int], cap: int, largest_first: bool = True) -> None:
    """Puts the loose pieces, largest first or as they come, each into the fullest bin that has room, or else into a new one."""
    rest = sorted((cap - load[k], k) for k in range(len(bins)) if load[k] < cap)
    for x in sorted(loose, key=lambda i: -size[i]) if largest_first else loose:
        at = bisect.bisect_left(rest, (size[x], -1))
        if at == len(rest):
            bins.append([x])
            load.append(size[x])
            if size[x] < cap:
                bisect.insort(rest, (cap - size[x], len(bins) - 1))
        else:
            room, k = rest.pop(at)
            bins[k].append(x)
            load[k] += size[x]
            if room > size[x]:
                bisect.insort(rest, (room - size[x], k))


def fitness(bins: list[list[int]], size: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their fill, which favours full bins beside an empty one."""
    return -len(bins), sum((sum(size[i] for i in b) / cap) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """A child of a with well-filled bins of b: bins of a that share a piece with them go, and their other pieces are best-fitted."""
    order = sorted(range(len(b)), key=lambda k: -sum(size[i] for i in b[k]) - rng.random())
    take = order[: max(1, rng.randint(1, max(1, len(b) // 3)))]
    injected = [list(b[k]) for k in take]
    held = {i for x in injected for i in x}
    child, loose = [], []
    for x in a:
        if held.isdisjoint(x):
            child.append(list(x))
        else:
            loose += [i for i in x if i not in held]
    child += injected
    return _refill(child, loose, size, cap)


def mutate(a: list[list[int]], size: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """Empties the loosest bins and a few others, and best-fits what they held."""
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    gone = set(order[: max(1, len(a) // 20)]) | {rng.randrange(len(a)) for _ in range(max(1, len(a) // 10))}
    return _refill([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], size, cap)


def _refill(bins: list[list[int]], loose: list[int], size: list[int], cap: int) -> list[list[int]]:
    load = [sum(size[i] for i in x) for x in bins]
    best_fit(bins, load, loose, size, cap)
    return bins


def perfect(bins: list[list[int]], size: list[int], p: Packing) -> bool:
    """Whether nothing can be better: as few bins as the pieces' sum needs, and all but one settled."""
    if len(bins) > -(-sum(size) // p.capacity):
        return False
    return sum(sum(size[i] for i in b) < p.settled * p.capacity for b in bins) <= 1


def evolve(people: list[list[list[int]]], size: list[int], p: Packing, rng: random.Random) -> list[list[list[int]]]:
    """Generations of one island; ends when a grouping is perfect."""
    rank = lambda x: fitness(x, size, p.capacity)
    people = sorted(people, key=rank, reverse=True)
    for _ in range(p.generations):
        if perfect(people[0], size, p):
            break
        a, b = rng.sample(people[: max(2, len(people) // 2 + 1)], 2) if len(people) > 1 else (people[0], people[0])
        young = [crossover(a, b, size, p.capacity, rng), crossover(b, a, size, p.capacity, rng), mutate(people[0], size, p.capacity, rng)]
        people = sorted(people + young, key=rank, reverse=True)[: p.population]
    return people


def first_people(size: list[int], p: Packing, rng: random.Random) -> list[list[list[int]]]:
    """Individuals of an island's first generation: the pieces best-fitted as they come, in an order of chance for each."""
    people = []
    for _ in range(p.population):
        order = list(range(len(size)))
        rng.shuffle(order)
        bins: list[list[int]] = []
        best_fit(bins, [], order, size, p.capacity, largest_first=False)
        people.append(bins)
    return people


def _groups(people: list[list[list[int]]], n: int) -> list[list[int]]:
    """Individuals as arrays: the bin of each piece."""
    out = []
    for bins in people:
        at = [0] * n
        for k, b in enumerate(bins):
            for i in b:
                at[i] = k
        out.append(at)
    return out


def _bins(at: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(at, default=-1) + 1)]
    for i, k in enumerate(at):
        bins[k].append(i)
    return [b for b in bins if b]


ITEM = "doc {kind}, row long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, tokenizer: str, p: Packing = Packing(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the separator alone. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Extra columns are left out. Only documents longer than the capacity are cut.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = ITEM.format(kind=kind)
    made = cut(token_pieces(docs, tokenizer, p, key, text))
    # sequences of one full piece have numbers below 0, others level, region and bin: no two are alike
    full = made.filter(F.col("length") == p.capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done = [full]
    loose = made.filter(F.col("length") < p.capacity)
    n, level = loose.count(), 0
    while n:
        regions = max(1, -(-n // p.region))
        last = regions == 1
        settled = cut(_level(loose, regions, level, last, item, p))
        done.append(settled.filter("settled").drop("settled"))
        if last:
            break
        loose = settled.filter(~F.col("settled")).drop("settled", "sequence_id", "offset")
        n, before = loose.count(), n
        level += 1
        if n > 0.9 * before:  # nothing settles: what is left is packed by the last level's rule
            settled = cut(_level(loose, max(1, -(-n // p.region)), level, True, item, p))
            done.append(settled.drop("settled"))
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("doc").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _level(loose: DataFrame, regions: int, level: int, last: bool, item: str, p: Packing) -> DataFrame:
    """Packs each region on its islands, and keeps the best island's grouping."""
    dealt = loose.withColumn("region", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(regions)).cast("int"))
    order = ["row", "piece"]

    def start(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # a row for each island: the region's sizes and the individuals of the first epoch
        pdf = pdf.sort_values(order, kind="stable")
        size = pdf["length"].tolist()
        rows = []
        for k in range(p.islands):
            rng = random.Random(f"{level}:{keys[0]}:{k}")
            rows.append((keys[0], k, size, _groups(first_people(size, p, rng), len(size))))
        return pd.DataFrame(rows, columns=["region", "island", "size", "people"])

    island = "region int, island int, size array<int>, people array<array<int>>"
    world = dealt.select("region", "row", "piece", "length").groupBy("region").applyInPandas(start, island)

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for region, k, size, people in pdf.itertuples(index=False):
                    size = [int(x) for x in size]
                    got = evolve([_bins([int(x) for x in at]) for at in people], size, p, random.Random(f"{level}:{region}:{k}:{number}"))
                    rows.append((region, k, size, _groups(got, len(size))))
                yield pd.DataFrame(rows, columns=["region", "island", "size", "people"])

        return run

    for number in range(p.epochs):
        world = world.mapInPandas(epoch(number), island)
        if number + 1 < p.epochs:
            # each island gets the elite of the one before it in the ring, in place of its worst
            n = F.count(F.lit(1)).over(_by_region())
            elite = F.coalesce(F.lag(F.get("people", F.lit(0))).over(_by_region().orderBy("island")), F.first(F.get("people", F.lit(0))).over(_by_region().orderBy(F.desc("island"))))
            world = world.withColumn("_e", elite).withColumn("_n", n).withColumn("people", F.when(F.col("_n") > 1, F.concat(F.array("_e"), F.slice("people", 1, max(1, p.population - 1)))).otherwise(F.col("people"))).drop("_e", "_n")

    def settle(keys: tuple, items: pd.DataFrame, islands: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(order, kind="stable").reset_index(drop=True)
        size = items["length"].tolist()
        best = max((_bins([int(x) for x in at]) for people in islands.sort_values("island")["people"] for at in people), key=lambda b: fitness(b, size, p.capacity))
        seq, off, ok = [0] * len(size), [0] * len(size), [False] * len(size)
        for k, b in enumerate(best):
            load = sum(size[i] for i in b)
            number = level << 57 | int(keys[0]) << 24 | k
            at = 0
            for i in b:
                seq[i], off[i], ok[i] = number, at, last or load >= p.settled * p.capacity
                at += size[i]
        return items.drop(columns=["region"]).assign(sequence_id=seq, offset=off, settled=ok)

    return dealt.groupBy("region").cogroup(world.select("region", "island", "people").groupBy("region")).applyInPandas(settle, f"{item}, sequence_id long, offset long, settled boolean")


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("region")
