"""Operator 7: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Exact copies are collapsed first: one document of each distinct text goes on.
2. Shingles of five words are counted over all distinct texts (blocks.py), and each block learns the document frequency of its
   shingles that occur in two texts or more.
3. A text's shingles weigh tf * idf. Two texts of weighted Jaccard similarity s share at least s of either's weight, so a text whose
   shingles of two texts or more hold less than that share has no partner and goes no further: nothing is lost.
4. The others get consistent weighted samples (Ioffe 2010), banded. A band's bucket that is small gives all its pairs; a large one
   is narrowed by further samples, and each of its texts is paired with the bucket's first text at every width.
5. Pairs are verified by weighted Jaccard similarity; classes are the connected components of what stays.
6. What a large bucket has not paired is compared too, block by block: all its texts outside its largest class with all of another
   class. Links found there join classes. So all pairs of every bucket are compared, but for those already in one class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.blocks import KEYS, blocked, key_table, received, sent
from ragframe.llm.common import arrow_batches, cut, mix, pieces, release, shards, spread, text_bytes, word_hashes

_STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    #: Bands of samples, and samples of a band.
    bands: int = 9
    rows: int = 3
    #: Texts of a bucket that gives all its pairs.
    small: int = 24
    #: Widths, in bands' lengths, at which a bucket is narrowed.
    widths: tuple[int, ...] = (1, 2, 4, 9)
    #: idf runs from 1 (in every text) to 1 + idf_span (in one text). Edited copies of a much copied text have rare shingles where
    #: they differ and frequent ones where they agree, so a wide span would part them: 0.03 keeps 0.8 close to the plain measure.
    idf_span: float = 0.03
    block_mb: float = 4.0
    #: Texts and megabytes of vectors of a block, where a large bucket is compared in blocks.
    bucket_texts: int = 400
    bucket_mb: float = 4.0


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of `size` words, in order. A text of fewer words is one shingle, one without words none."""
    row, _, _, h = word_hashes(data, off)
    n_rows = len(off) - 1
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    m = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    at = np.repeat(first, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    end = (first + n)[np.repeat(np.arange(n_rows), m)]
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        i = at + k
        inside = i < end
        out = np.where(inside, mix(out * _STEP + h[np.minimum(i, len(h) - 1)]), out) if len(h) else out
    return np.repeat(np.arange(n_rows), m), out


def weighted(row: np.ndarray, sh: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with the shingle's count in the row, by row and shingle."""
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(new)
    return row[at], sh[at], np.diff(np.append(at, len(row)))


def shingle_counts(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """weighted() of all shingles of the rows, which go in pieces: bounds the working memory."""
    found = [(row + i, sh, tf) for i, j in pieces(off) for row, sh, tf in [weighted(*shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size), j - i)]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def idf(df: np.ndarray, texts: int, span: float) -> np.ndarray:
    """From 1 + span (in one text) down to 1 (in all)."""
    return (1 + span * (1 - np.log(np.maximum(df, 1)) / np.log(max(2, texts)))).astype(np.float64)


def samples(row: np.ndarray, sh: np.ndarray, weight: np.ndarray, n_rows: int, n: int, most: int = 100_000) -> np.ndarray:
    """Improved consistent weighted sampling: n samples of each row as hashes of (shingle, quantised weight); (row, n).

    Rows go in pieces of about `most` shingles, one row at least: bounds the working memory.
    """
    out = np.zeros((n_rows, n), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for i, j in pieces(np.append(first, len(row)), most):
        a, b = first[i], first[j] if j < len(first) else len(row)
        out[row[first[i:j]]] = _samples(sh[a:b], weight[a:b], first[i:j] - a, n)
    return out


def _samples(sh: np.ndarray, weight: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """samples() of the rows that begin at `first`, all of them."""
    out = np.zeros((len(first), n), np.uint64)
    size = np.diff(np.append(first, len(sh)))
    at = np.repeat(np.arange(len(first)), size)
    log_w = np.log(weight)
    unit = lambda k, j: ((mix(sh + np.uint64((5 * k + j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    for k in range(n):
        r = -np.log(unit(k, 0) * unit(k, 1))
        c = -np.log(unit(k, 2) * unit(k, 3))
        beta = unit(k, 4)
        t = np.floor(log_w / r + beta)
        log_a = np.log(c) - r * (t - beta) - r
        low = np.minimum.reduceat(log_a, first)
        best = np.flatnonzero(log_a == np.repeat(low, size))
        # a tie goes to the smaller hash, which comes first
        best = best[np.concatenate([[True], at[best][1:] != at[best][:-1]])]
        out[:, k] = mix(sh[best] * _STEP + t[best].astype(np.int64).astype(np.uint64))
    return out


def copies(docs: DataFrame, key: str, text: str, salts: int = 32) -> DataFrame:
    """Each key with `first`, the smallest key of its exact copies; null and blank texts are copies of none."""
    t = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    h = t.select("id", F.when(~blank, F.md5(F.col("text").cast("binary"))).alias("h"))
    firsts = h.filter(F.col("h").isNotNull()).groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a text may be copied without bound, so its copies are dealt over `salts` places
    dealt = firsts.select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return h.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(dealt, ["h", "salt"], "left").select("id", F.coalesce("first", "id").alias("first"))


def near_duplicates(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key and class_id, the smallest key of its class.

    Null, empty and blank texts are classes of their own key. A text of one to four words is one shingle. Repeated keys get the
    class of their texts' smallest class. Null keys stay alone with class null. Extra columns are left out.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    owner = cut(copies(docs, key, text))
    chosen = owner.filter(F.col("id") == F.col("first")).select("id").distinct()
    n = shards(docs, s.block_mb, text)
    # texts are moved once for each of two passes; the chosen ids meet them in their blocks
    dealt = blocked(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull()), "id", n)
    picks = chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    texts = chosen.count()

    def count(t: pa.Table, own: pa.Table) -> pa.Table:
        t = t.filter(pa.compute.is_in(t["id"], value_set=own["id"].combine_chunks()))
        if not t.num_rows:
            return key_table([])
        block = t["block"][0].as_py()
        data, off = text_bytes(t["text"])
        _, sh, _ = shingle_counts(data, off, s.shingle)
        u, c = np.unique(sh, return_counts=True)
        return key_table(list(sent(block, 0, u, c, n)))

    def resolve(t: pa.Table) -> pa.Table:
        blocks, size, keys, c = received(t, 0)
        u, inv = np.unique(keys, return_inverse=True)
        total = np.bincount(inv, c, len(u)).astype(np.int64)[inv]
        rows, at = [], 0
        for b, m in zip(blocks, size.tolist(), strict=True):
            k, d = keys[at : at + m], total[at : at + m]
            at += m
            k, d = k[d > 1], d[d > 1]
            if len(k):
                rows.append((b, k.tobytes(), d.astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "keys", "df"])

    counted = dealt.groupBy("block").cogroup(picks.groupBy("block")).applyInArrow(count, KEYS).repartition(n, "part").groupBy("part").applyInArrow(resolve, "block int, keys binary, df binary")
    frequent = cut(counted)
    del counted
    release(docs.sparkSession)
    told = frequent.withColumn("id", F.lit(None).cast(kind)).unionByName(picks, allowMissingColumns=True)
    n_samples = s.bands * s.rows

    def sign(t: pa.Table, known: pa.Table) -> pa.Table:
        names = ["id", "total", "vector", "sig"]
        none = pa.Table.from_arrays([pa.array([], k) for k in (id_type(t), pa.float64(), pa.binary(), pa.list_(pa.int64()))], names)
        t = t.filter(pa.compute.is_in(t["id"], value_set=known["id"].drop_null().combine_chunks()))
        known = known.filter(pa.compute.is_valid(known["keys"]))
        if not t.num_rows or not known.num_rows:
            return none
        keys = np.frombuffer(b"".join(x.as_py() for x in known["keys"]), "<u8")
        df = np.frombuffer(b"".join(x.as_py() for x in known["df"]), "<u4")
        order = np.argsort(keys)
        keys, df = keys[order], df[order]
        data, off = text_bytes(t["text"])
        row, sh, tf = shingle_counts(data, off, s.shingle)
        at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
        often = keys[at] == sh
        weight = tf * idf(np.where(often, df[at], 1), texts, s.idf_span)
        total = np.bincount(row, weight, t.num_rows)
        shared = np.bincount(row[often], weight[often], t.num_rows)
        may = shared >= s.threshold * total * (1 - 1e-9)
        may &= total > 0
        keep = may[row]
        row, sh, weight = row[keep], sh[keep], weight[keep]
        pick = np.flatnonzero(may)
        if not len(pick):
            return none
        number = np.cumsum(may) - 1
        sig = samples(number[row], sh, weight, len(pick), n_samples)
        ends = np.cumsum(np.bincount(number[row], minlength=len(pick)))
        vec = [sh[a:b].tobytes() + weight[a:b].astype("<f4").tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_arrays([t["id"].take(pa.array(pick)), pa.array(total[pick]), pa.array(vec, pa.binary()), pa.array(list(sig.view(np.int64)), pa.list_(pa.int64()))], names)

    signed = cut(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(sign, f"id {kind}, total double, vector binary, sig array<long>"))
    release(docs.sparkSession)
    at = buckets(signed.select("id", "sig"), s)
    links = cut(verified(candidate_pairs(at, s), signed.select("id", "vector", "total"), s))
    classes = cut(components(links))
    joined = owner.join(classes, owner["first"] == classes["node"], "left").select("id", F.coalesce("label", "first").alias("label"))
    crossing = cut(across(at, classes, signed.select("id", "vector"), s))
    if not crossing.isEmpty():
        merged = components(crossing).select(F.col("node").alias("label"), F.col("label").alias("into"))
        joined = joined.join(merged, "label", "left").select("id", F.coalesce("into", "label").alias("label"))
    return joined.select(F.col("id").alias(key), F.col("label").alias("class_id"))


def id_type(t: pa.Table) -> pa.DataType:
    return t.schema.field("id").type


def buckets(signed: DataFrame, s: Settings) -> DataFrame:
    """id, width, band, bucket, texts of it and its first text, of every text that shares a bucket."""
    keys = []
    for band in range(s.bands):
        for w in s.widths:
            part = [F.get("sig", F.lit((band * s.rows + j) % (s.bands * s.rows))) for j in range(s.rows * w)]
            # all samples together are one bucket, not one for each band
            if w < s.bands or band == 0:
                keys.append(F.struct(F.lit(w).alias("w"), F.lit(band).alias("band"), F.xxhash64(F.lit(w), F.lit(band if w < s.bands else -1), *part).alias("k")))
    rows = signed.select("id", F.explode(F.array(*keys)).alias("x")).select("id", "x.w", "x.band", "x.k")
    shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    return cut(rows.join(shared, "k"))


def candidate_pairs(at: DataFrame, s: Settings) -> DataFrame:
    """Distinct pairs a < b: all of a small bucket; in a large one, each text with the first at every width."""
    stars = at.filter((F.col("id") != F.col("first")) & ((F.col("n") > s.small) | (F.col("w") == s.bands))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    # the first width at which a text's bucket is small: there all pairs are formed
    tight = at.filter(F.col("n") <= s.small).groupBy("id", "band").agg(F.min_by("k", "w").alias("k")).select("k", "id")
    # texts that narrow at different widths meet in the wider of their buckets
    left, right = tight.alias("l"), at.filter(F.col("n") <= s.small).select("k", "id").alias("r")
    near = left.join(right, F.col("l.k") == F.col("r.k")).filter(F.col("l.id") != F.col("r.id")).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
    return stars.unionByName(near).distinct()


def across(at: DataFrame, classes: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between classes, by their labels, that the pairs of large buckets give.

    Blocks of the texts outside a bucket's largest class meet each other and the blocks of that class. A pair of blocks tells as many
    links as join its classes, not all.
    """
    own = at.filter((F.col("w") == s.widths[0]) & (F.col("n") > s.small)).select("k", "id")
    own = own.join(classes, own["id"] == classes["node"], "left").select("k", "id", F.coalesce("label", "id").alias("label"))
    own = cut(own.join(vectors.select("id", F.length("vector").alias("bytes")), "id"))
    sizes = own.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("k").agg(F.max(F.struct("c", "label", "bytes")).alias("main"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes")).filter(F.col("c") > F.col("main.c"))
    blocks = lambda c, b: F.greatest(F.ceil(c / s.bucket_texts), F.ceil(b / (s.bucket_mb * 1e6))).cast("int")
    main = main.select("k", F.col("main.label").alias("most"), blocks(F.col("c") - F.col("main.c"), F.col("bytes") - F.col("main.bytes")).alias("rest"), blocks(F.col("main.c"), F.col("main.bytes")).alias("of_most"))
    in_most, h = F.col("label") == F.col("most"), F.xxhash64("id")
    placed = own.join(main, "k").withColumn("block", F.when(in_most, F.col("rest") + F.pmod(h, F.col("of_most"))).otherwise(F.pmod(h, F.col("rest"))).cast("int"))
    meets = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    before = lambda n: F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: meets(i, F.col("block"), False))
    after = F.transform(F.sequence("block", F.col("rest") + F.col("of_most") - 1), lambda j: meets(F.col("block"), j, True))
    dealt = placed.withColumn("x", F.explode(F.when(in_most, before(F.col("rest"))).otherwise(F.concat(before(F.col("block")), after))))
    dealt = dealt.select("k", "x.i", "x.j", "x.left", "id", "label").join(vectors.select("id", "vector"), "id")
    kind = at.schema["id"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        label = t["label"].combine_chunks()
        label = pa.concat_arrays(label.chunks) if isinstance(label, pa.ChunkedArray) else label
        coded = label.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        left = np.flatnonzero(np.asarray(t["left"]))
        sim = similarities([x.as_buffer() for x in t["vector"]], left)
        a, b = np.nonzero((sim >= s.threshold - 1e-6) & (code[left][:, None] != code[None, :]))
        a, b = code[left[a]], code[b]
        parent = list(range(len(coded.dictionary)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).tolist():
            if root(x) != root(y):
                parent[root(x)] = root(y)
                out.append((x, y))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([coded.dictionary.take(pa.array(ends[:, i])) for i in (0, 1)], ["a", "b"])

    return dealt.groupBy("k", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def similarities(raw: list, left: np.ndarray, wide: int = 4096) -> np.ndarray:
    """jaccard() of the vectors `left` with all, (left, all). A sum of minima is one over shared steps of weight."""
    vec = [_vector(x) for x in raw]
    row = np.repeat(np.arange(len(vec)), [len(a) for a, _ in vec])
    sh, w = np.concatenate([a for a, _ in vec]), np.concatenate([b for _, b in vec])
    total = np.bincount(row, w, len(vec))
    order = np.lexsort((w, sh))
    row, sh, w = row[order], sh[order], w[order]
    new_sh = np.concatenate([[True], sh[1:] != sh[:-1]])
    # shingles of one text alone add to its sum only
    group = np.cumsum(new_sh) - 1
    keep = np.bincount(group)[group] > 1
    row, sh, w = row[keep], sh[keep], w[keep]
    low = np.zeros((len(left), len(vec)))
    if len(row):
        new_sh = np.concatenate([[True], sh[1:] != sh[:-1]])
        new = new_sh | np.concatenate([[True], w[1:] != w[:-1]])
        step = np.cumsum(new) - 1
        first = np.maximum.accumulate(np.where(new_sh, step, 0))
        size = w[new] - np.where(new_sh[new], 0, np.concatenate([[0], w[new][:-1]]))
        m = step - first + 1
        row, step = np.repeat(row, m), np.repeat(first, m) + spread(m)
        order = np.argsort(step, kind="stable")
        row, step = row[order], step[order]
        for i in range(0, len(size), wide):
            a, b = np.searchsorted(step, [i, i + wide])
            x = np.zeros((len(vec), min(wide, len(size) - i)))
            x[row[a:b], step[a:b] - i] = 1
            low += (x[left] * size[i : i + wide]) @ x.T
    return low / (total[left][:, None] + total[None, :] - low)


def verified(pairs: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose weighted Jaccard similarity is the threshold or more: a, b, similarity."""
    left = vectors.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("total").alias("ta"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("total").alias("tb"))
    # sums of minima are at most the smaller sum, so sums too far apart need no vectors
    totals = pairs.join(left.select("a", "ta"), "a").join(right.select("b", "tb"), "b").filter(F.least("ta", "tb") >= s.threshold * 0.999999 * F.greatest("ta", "tb")).select("a", "b")
    both = totals.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches):
        for t in batches:
            sim = [jaccard(x.as_buffer(), y.as_buffer()) for x, y in zip(t.column(2), t.column(3), strict=True)]
            keep = pa.array([v >= s.threshold - 1e-6 for v in sim], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sim, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    return both.mapInArrow(check, f"a {kind}, b {kind}, similarity double")


def _vector(raw) -> tuple[np.ndarray, np.ndarray]:
    n = len(memoryview(raw)) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n, 8 * n).astype(np.float64)


def jaccard(x, y) -> float:
    """Sum of minima over sum of maxima of two vectors of sorted shingles."""
    (a, wa), (b, wb) = _vector(x), _vector(y)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    low = float(np.minimum(wa[both], wb[at[both]]).sum())
    return low / (float(wa.sum()) + float(wb.sum()) - low)


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its connected component, of every node of the links (a, b).

    Alternating large-star and small-star steps (Kiveris et al. 2014): the links stay as many, and a hub's links are rewired, not
    multiplied. Ends when a round changes nothing.
    """
    e = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("b"))
        small = small.unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        e = cut(small.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u < v").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("label"))
    return nodes.groupBy("node").agg(F.min("label").alias("label"))
