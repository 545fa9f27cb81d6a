"""Operator 3: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance, and hashed by several tables of p-stable
functions floor((a.x + b) / w). A query visits its own bucket and perturbed ones, in the order of their estimated success: the
expected squared distances to the bucket borders that a perturbation crosses, over the query's borders in order of distance.

Points and probes meet by bucket, in two passes. The first visits the likeliest buckets of some tables and gives each query a bound:
the score of its last nearest so far. The second visits all buckets, and gives only candidates at or above that bound: a row for each
query and part, of which a query visits at most as many as its probes, however many points there are. Candidates of all tables are
merged and ranked by the exact measure.

Points are split into ranges of length, each with its own scale, width and number of functions. That number is lowered until a sample
of queries, whose nearest are found exactly in one pass, finds enough of them; without functions all points of a range are compared.
Queries that still find fewer than there are get an exact search in blocks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_batches, cut, mix


@dataclass(frozen=True)
class Settings:
    nearest: int = 20
    tables: int = 16
    #: Each table has at most log2(points) less so many hash functions, rounded: some dozens of points have none, and are all compared.
    fewer_functions: float = 5.0
    #: Share of their nearest that the sampled queries must find in each range of lengths.
    recall: float = 0.95
    #: Queries of that sample.
    tested: int = 100
    #: Ranges of length, each half as long as the one before; the last holds all that are shorter.
    ranges: int = 8
    #: Buckets a query visits in each table.
    probes: int = 150
    #: Tables and buckets of a table that the first pass visits.
    first_tables: int = 4
    first_probes: int = 16
    #: Width of a bucket as a share of the typical distance between a query and a point.
    width: float = 1.5
    #: Vectors that the widths are fitted on.
    sample: int = 2000
    #: Points of a bucket that one task compares; larger buckets are dealt over several.
    salt: int = 4000
    #: Buckets that are dealt so, at most: they are sent to every task. A bucket that isn't among them holds at most that share of all.
    large: int = 500_000
    #: Points of a partition, on average over all tables.
    partition: int = 40_000
    #: Places that the rows of a repeated query vector are dealt over.
    copies: int = 32
    seed: int = 5


def templates(m: int, n: int) -> np.ndarray:
    """The n perturbations of least expected score, one a row: places in the order of 2m moves by distance, filled up with 2m.

    The j-th nearest border and the j-th farthest are those of one function, which moves one way only. The expected squared distances
    are those of uniform places in m slots.
    """
    if not m:
        return np.zeros((1, 1), np.int64)
    j = np.arange(1, 2 * m + 1)
    far = 2 * m + 1 - j
    spread = 4 * (m + 1) * (m + 2)
    score = np.where(j <= m, j * (j + 1) / spread, 1 - far / (m + 1) + far * (far + 1) / spread)
    out: list[tuple[int, ...]] = [()]
    heap = [(float(score[0]), (0,))]
    while heap and len(out) < n:
        total, at = heapq.heappop(heap)
        if len({min(i, 2 * m - 1 - i) for i in at}) == len(at):
            out.append(at)
        last = at[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*at[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*at, last + 1)))
    full = np.full((len(out), max(1, max(map(len, out)))), 2 * m)
    for i, at in enumerate(out):
        full[i, : len(at)] = at
    return full


@dataclass(frozen=True)
class Range:
    """Points of about one length: their longest, the width of their buckets and the functions of a table."""

    scale: float
    w: float
    k: int


def directions(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def lifted(x: np.ndarray, scale: float) -> np.ndarray:
    """Points with the coordinate that makes them equally long."""
    y = x / scale
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))], 1)


class Hasher:
    """p-stable functions of all tables over lifted vectors, for every range. A key is a mixed sum over functions, so that a move adds."""

    def __init__(self, dim: int, ranges: dict[int, Range], s: Settings):
        rng = np.random.default_rng(s.seed)
        most = max(g.k for g in ranges.values())
        # the same functions whatever `most` is: they are drawn one after the other
        drawn = [(rng.standard_normal((dim + 1, s.tables)), rng.uniform(0, 1, s.tables)) for _ in range(most)]
        self.a = np.stack([a for a, _ in drawn], 2) if drawn else np.zeros((dim + 1, s.tables, 0))
        self.b = np.stack([b for _, b in drawn], 1) if drawn else np.zeros((s.tables, 0))
        self.step = mix(np.arange(1, s.tables * most + 1, dtype=np.uint64)).reshape(most, s.tables).T | np.uint64(1)
        self.ranges, self.all_tables = ranges, s.tables

    def tables(self, g: int) -> int:
        """Without functions one table holds all."""
        return self.all_tables if self.ranges[g].k else 1

    def slots(self, x: np.ndarray, g: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """The sums of keys (vector, table) before they are mixed, and places within the slots (vector, table, function), in range g."""
        own, t = self.ranges[g], self.tables(g)
        y = np.concatenate([directions(x), np.zeros((len(x), 1))], 1) if query else lifted(x, own.scale)
        v = np.tensordot(y, self.a[:, :t, : own.k], 1) / own.w + self.b[:t, : own.k]
        f = np.floor(v)
        sums = (f.astype(np.int64).view(np.uint64) * self.step[:t, : own.k]).sum(2, dtype=np.uint64)
        return sums, v - f

    def _keys(self, sums: np.ndarray, g: int, first: int) -> np.ndarray:
        table = mix(np.arange(sums.shape[1], dtype=np.uint64) + np.uint64(g * self.all_tables + first))
        return mix(sums ^ table.reshape(1, -1, *[1] * (sums.ndim - 2))).view(np.int64)

    def point_keys(self, x: np.ndarray, g: int) -> np.ndarray:
        """(vector, table)."""
        return self._keys(self.slots(x, g, False)[0], g, 0)

    def query_keys(self, x: np.ndarray, g: int, probes: int, tables: int | None = None) -> np.ndarray:
        """The buckets that each query visits in each table, likeliest first: (vector, table, probe)."""
        sums, place = self.slots(x, g, True)
        t, k = min(tables or self.all_tables, sums.shape[1]), self.ranges[g].k
        sums, place = sums[:, :t], place[:, :t]
        step = np.broadcast_to(self.step[:t, :k], place.shape)
        moves = np.concatenate([np.negative(step), step], 2)
        order = np.argsort(np.concatenate([place, 1 - place], 2), 2, kind="stable")
        moves = np.concatenate([np.take_along_axis(moves, order, 2), np.zeros((*sums.shape, 1), np.uint64)], 2)
        add = np.zeros((*sums.shape, 1), np.uint64)
        for at in templates(k, probes).T:
            add = add + moves[:, :, at]
        return self._keys(sums[:, :, None] + add, g, 0)


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


class Places:
    """Parts of buckets: a large bucket is dealt over several salts, and its probes go to each."""

    def __init__(self, large: dict[int, int], parts: int):
        self.keys = np.array(sorted(large), np.int64)
        self.salts = np.array([large[k] for k in sorted(large)], np.int64)
        self.parts = parts

    def salts_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.salts[at], 1)

    def salted(self, keys: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The salted keys and their parts."""
        k = mix(keys.view(np.uint64) + salt.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return k.view(np.int64), (k % np.uint64(self.parts)).astype(np.int32)


def _by_part(row: np.ndarray, part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows and parts that have keys, and the keys of each."""
    order = np.lexsort((part, row))
    row, part, keys = row[order], part[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])) if len(row) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(keys, pa.int64()))
    return row[new], part[new], lists


def neighbours(vectors: DataFrame, is_query: Column, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score: the nearest found of each query by inner product in double precision, ties to smaller keys.

    Vectors null, empty, zero or holding null or non-finite components take no part. All must have one length (that of most: others
    take no part). Of rows that repeat a key, the least vector stands for it, and it is a query if any of them is. Equal vectors are
    one point, searched once, with the smallest keys of each. Where there are no more candidates than `nearest`, all are given. Extra
    columns are left out.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4000)
    kind = vectors.schema[key].dataType.simpleString()
    out = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    single = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast(single).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("m")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out)
    v = v.filter(F.size("v") == dims["d"]).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    v = v.withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # equal vectors: one point with its smallest keys (a query needs one more than the nearest, for itself)
    keep = s.nearest + 1
    firsts = v.withColumn("r", F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))).filter(F.col("r") <= keep)
    shorter = F.when(length > 0, F.floor(F.log2(F.lit(float(dims["m"])) / length))).otherwise(s.ranges)
    points = firsts.groupBy("h", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    points = cut(points.select(F.col("ids")[0].alias("p"), "h", "h2", "ids", "v", F.greatest(F.lit(0), F.least(F.lit(s.ranges - 1), shorter)).cast("int").alias("g"), length.alias("m")))
    asked = cut(v.filter("q").select("id", "h", "h2"))
    of = asked.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    queries = points.join(of, ["h", "h2"]).select("p", "v", "n", "only", "h", "h2")
    n, all_ids = points.count(), v.count()
    fitted = _fitted(points, queries, dims["d"], s)
    if fitted is None or all_ids < 2:
        return spark.createDataFrame([], out)
    sent = spark.sparkContext.broadcast(fitted)  # dim x tables x functions numbers
    parts = max(1, -(-n * s.tables // s.partition))

    def own_keys(hasher: Hasher, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of the points of a batch (p, v, g)."""
        x, g = _matrix(b.column(1)), np.asarray(b.column(2))
        rows, keys = [], []
        for own in np.unique(g).tolist():
            at = np.flatnonzero(g == own)
            k = hasher.point_keys(x[at], own)
            rows.append(np.repeat(at, k.shape[1]))
            keys.append(k.ravel())
        return np.concatenate(rows), np.concatenate(keys)

    def count_buckets(batches):
        hasher = sent.value
        for b in batches:
            k, c = np.unique(own_keys(hasher, b)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], ["k", "n"])

    bare = points.select("p", "v", "g")
    bound = max(s.salt, n * s.tables // s.large)
    buckets = bare.mapInArrow(count_buckets, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") > bound)
    large = {r["k"]: -(-r["n"] // s.salt) for r in buckets.collect()}  # `large` rows at most, since all buckets hold n * tables
    dealt = spark.sparkContext.broadcast(Places(large, parts))

    def place_points(first: bool):
        def run(batches):
            hasher, places = sent.value, dealt.value
            for b in batches:
                row, k = own_keys(hasher, b.select(["p", "v", "g"]))
                if first:
                    order = np.argsort(row, kind="stable")
                    row, k = row[order], k[order]
                    of_row = np.arange(len(row)) - np.searchsorted(row, row)
                    row, k = row[of_row < s.first_tables], k[of_row < s.first_tables]
                salt = np.asarray(b.column(3))[row] % places.salts_of(k)
                k, part = places.salted(k, salt)
                row, part, lists = _by_part(row, part, k)
                yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0).take(pa.array(row)), lists, b.column(1).take(pa.array(row))], ["part", "p", "keys", "v"])

        return run

    def place_queries(tables: int, probes: int):
        def run(batches):
            hasher, places = sent.value, dealt.value
            for b in batches:
                for i in range(0, b.num_rows, 256):  # a query has tables x probes keys
                    c = b.slice(i, 256)
                    x = _matrix(c.column(1))
                    k = np.concatenate([hasher.query_keys(x, g, probes, tables).reshape(len(x), -1) for g in hasher.ranges], 1)
                    row, k = np.repeat(np.arange(len(x)), k.shape[1]), k.ravel()
                    m = places.salts_of(k)
                    salt = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    k, part = places.salted(np.repeat(k, m), salt)
                    row, part, lists = _by_part(np.repeat(row, m), part, k)
                    yield pa.RecordBatch.from_arrays([pa.array(part), c.column(0).take(pa.array(row)), lists, c.column(1).take(pa.array(row)), c.column(2).take(pa.array(row))], ["part", "p", "keys", "v", "bound"])

        return run

    found = f"p {kind}, best array<struct<neg:double,other:{kind}>>"

    def compare(pt: pa.Table, qt: pa.Table) -> pa.Table:
        """For each query its best in this part, if any reach its bound."""
        id_type = qt.schema.field("p").type
        if not pt.num_rows or not qt.num_rows:
            return _best(id_type, [], [], [])
        x, y = _matrix(pt["v"]), _matrix(qt["v"])
        pk, pn = _lists(pt["keys"])
        qk, qn = _lists(qt["keys"])
        p_row = np.repeat(np.arange(len(pn)), pn)
        order = np.argsort(pk, kind="stable")
        pk, p_row = pk[order], p_row[order]
        lo, hi = np.searchsorted(pk, qk, "left"), np.searchsorted(pk, qk, "right")
        ends = np.concatenate([[0], np.cumsum(qn)])
        least = np.asarray(qt["bound"])
        names = pt["p"].combine_chunks()
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(pa.compute.sort_indices(names))] = np.arange(len(names))
        got: list[tuple[int, np.ndarray, np.ndarray]] = []
        seen = np.zeros(len(pn), bool)
        for i in range(len(qn)):
            spans = [p_row[a:b] for a, b in zip(lo[ends[i] : ends[i + 1]].tolist(), hi[ends[i] : ends[i + 1]].tolist(), strict=True) if b > a]
            if not spans:
                continue
            seen[:] = False
            for c in spans:
                seen[c] = True
            c = np.flatnonzero(seen)
            score = np.einsum("ij,j->i", x[c], y[i])
            sel = score >= least[i] - 1e-9 * abs(least[i]) if np.isfinite(least[i]) else np.ones(len(c), bool)
            c, score = c[sel], score[sel]
            if len(c) > keep:  # all that tie with the last stay, for the order of keys
                sel = score >= np.partition(score, len(c) - keep)[len(c) - keep]
                c, score = c[sel], score[sel]
            o = np.lexsort((rank[c], -score))[:keep]
            if len(o):
                got.append((i, c[o], score[o]))
        return _best(id_type, qt["p"].take(pa.array([g[0] for g in got], pa.int64())), [g[2] for g in got], [names.take(pa.array(g[1])) for g in got])

    def merged(side_p: DataFrame, side_q: DataFrame) -> DataFrame:
        """p and best: the nearest points of what meets in the parts."""
        best = side_p.groupBy("part").cogroup(side_q.groupBy("part")).applyInArrow(compare, found)
        # a point that several parts found has one place in the order
        together = best.groupBy("p").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("b"))
        once = F.get(F.transform(F.array("b"), lambda b: F.filter(b, lambda x, i: (i == 0) | (F.get(b, i - 1)["other"] != x["other"]))), F.lit(0))
        return together.select("p", F.slice(once, 1, keep).alias("best"))

    salted = points.select("p", "v", "g", F.pmod(F.xxhash64("p"), F.lit(1 << 40)).alias("hash"))
    no_bound = F.lit(float("-inf")).alias("bound")
    point_row, query_row = f"part int, p {kind}, keys array<long>, v {single}", f"part int, p {kind}, keys array<long>, v {single}, bound double"
    spread = queries.select("p", "v", no_bound).repartition(max(1, min(parts, 2000)))
    first = merged(salted.mapInArrow(place_points(True), point_row), spread.mapInArrow(place_queries(s.first_tables, s.first_probes), query_row))
    bounds = cut(first.select("p", F.coalesce(-F.get("best", F.lit(keep - 1))["neg"], F.lit(float("-inf"))).alias("bound")))
    bounded = queries.join(bounds, "p", "left").select("p", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")).repartition(max(1, min(parts, 2000)))
    top = cut(merged(salted.mapInArrow(place_points(False), point_row), bounded.mapInArrow(place_queries(s.tables, s.probes), query_row)))

    members = points.select(F.col("p").alias("other"), "ids")

    def with_ids(top: DataFrame) -> DataFrame:
        """p and near: the nearest keys, where a point stands for all of its."""
        each = top.select("p", F.explode("best").alias("x")).select("p", "x.neg", "x.other").join(members, "other")
        near = each.groupBy("p").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("neg").alias("neg"), i.alias("id")))))).alias("near"))
        return near.select("p", F.slice("near", 1, keep).alias("near"))

    near = cut(with_ids(top))
    # points that found fewer keys than there are: all points, in blocks
    full = near.filter(F.size("near") >= min(keep, all_ids))
    short = cut(queries.select("p", "v").join(full, "p", "left_anti"))
    if not short.isEmpty():
        blocks, one = max(1, -(-n // s.partition)), F.array(F.lit(0).cast("long")).alias("keys")
        block_p = points.select(F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("part"), "p", one, "v")
        block_q = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "p", one, "v", no_bound)
        near = full.unionByName(with_ids(merged(block_p, block_q)))
    # a vector may be asked for by many rows: their places are dealt over `copies`, those of a single row need one
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(s.copies)).cast("int")
    where = F.when(F.col("n") == 1, F.array(place("only"))).otherwise(F.sequence(F.lit(0), F.lit(s.copies - 1)))
    answers = near.join(queries.select("p", "h", "h2", "n", "only"), "p").select("h", "h2", "near", F.explode(where).alias("salt"))
    told = asked.withColumn("salt", place("id")).join(answers, ["h", "h2", "salt"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, s.nearest)
    each = told.select(F.col("id").alias("query_id"), F.posexplode(others).alias("r", "x"))
    return each.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (-F.col("x.neg")).alias("score"))


def _best(id_type: pa.DataType, queries, scores: list[np.ndarray], others: list[pa.Array]) -> pa.Table:
    """A row for each query: its candidates, best first."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in scores])]).astype(np.int32))
    neg = pa.array(-np.concatenate(scores) if scores else np.zeros(0))
    other = pa.concat_arrays(others) if others else pa.array([], id_type)
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([neg, other], ["neg", "other"]))
    return pa.Table.from_arrays([queries if len(queries) else pa.array([], id_type), lists], ["p", "best"])


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Items end to end and lengths."""
    c = col.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    return np.asarray(c.flatten()), np.asarray(pa.compute.list_value_length(c)).astype(np.int64)


def _fitted(points: DataFrame, queries: DataFrame, dim: int, s: Settings) -> Hasher | None:
    """Scale, width and functions of each range; None without queries.

    The width follows the typical distance from a query to a point, in bounded samples. The functions are as many as let the sampled
    queries find the share `recall` of their nearest that lie in the range.
    """
    tested = queries.orderBy(F.xxhash64("p"), "p").limit(s.tested).collect()
    if not tested:
        return None
    q = np.array([r["v"] for r in tested])
    own = [r["p"] for r in tested]
    rows = points.orderBy("p").select("v", "g").limit(s.sample).collect()
    x, xg = np.array([r["v"] for r in rows]), np.array([r["g"] for r in rows])
    true = _true(points, q, own, s)
    nx = np.array([r["v"] for r in true]).reshape(-1, dim)
    ng, nq = np.array([r["g"] for r in true], int), np.array([r["i"] for r in true], int)
    ranges = {}
    for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).orderBy("g").collect():
        g, scale = r["g"], r["m"] or 1.0
        # a range too small for the sample has its nearest to go by, or only the distance at a right angle
        near = next((y for y in (x[xg == g], nx[ng == g]) if len(y)), np.zeros((1, dim)))
        to = np.sqrt(np.maximum(0, 2 - 2 * directions(q) @ (near / scale).T))
        typical = float(np.median(to)) or 1.0
        k = max(0, round(math.log2(r["n"]) - s.fewer_functions))
        at = np.flatnonzero(ng == g)
        while k and len(at):
            h = Hasher(dim, {g: Range(scale, s.width * typical, k)}, s)
            keys, probes = h.point_keys(nx[at], g), h.query_keys(q, g, s.probes)
            hits = [bool((keys[j][:, None] == probes[i]).any()) for j, i in enumerate(nq[at].tolist())]
            if np.mean(hits) >= s.recall:
                break
            k -= 1
        ranges[g] = Range(scale, s.width * typical, k)
    # a range has the same functions alone and among others
    return Hasher(dim, ranges, s)


def _true(points: DataFrame, q: np.ndarray, own: list, s: Settings) -> list:
    """i, v and g of the nearest points of each query i, exactly; its own point counts where others have the same vector."""
    kind = points.schema["p"].dataType.simpleString()

    def best(batches):
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object)) for _ in own]
        for b in batches:
            kind_of = b.schema.field(0).type
            p, single = np.array([*b.column(0).to_pylist(), None], object)[:-1], b.column(2).to_pylist()
            score = _matrix(b.column(1)) @ q.T
            row = {k: i for i, k in enumerate(single) if k is not None}
            for i, k in enumerate(own):
                if k in row:
                    score[row[k], i] = -np.inf
                sc, at = np.concatenate([top[i][0], score[:, i]]), np.concatenate([top[i][1], p])
                o = np.argsort(-sc, kind="stable")[: s.nearest]
                top[i] = sc[o], at[o]
        n = [len(a) for a, _ in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), n), pa.int32()), pa.array(np.concatenate([p for _, p in top]).tolist(), kind_of), pa.array(np.concatenate([a for a, _ in top]))], ["i", "p", "score"])

    found = points.select("p", "v", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("single")).mapInArrow(best, f"i int, p {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "p"))
    top = found.filter(F.col("score") > float("-inf")).withColumn("r", rank).filter(F.col("r") <= s.nearest)
    return top.join(points.select("p", "v", "g"), "p").select("i", "v", "g").collect()
