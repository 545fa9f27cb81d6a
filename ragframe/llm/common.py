"""Pieces that several training-data operators share: table access, sizing, checkpoints, word hashing in numpy."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.session import settled

#: The six white-space bytes of the word pattern [^\x20\x09-\x0D]+, as a character class for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_M64 = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n: the fold of a row."""
    return F.crc32(col.cast("string")) % n


def shards(df: DataFrame, mb: float, text: str, least: int = 1, most: int = 200_000) -> int:
    """How many pieces of about mb megabytes df has: it grows with the input.

    The size is the optimizer's (for files, that of the files); where it knows none, as for rows made in memory, the texts' bytes.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0
    return max(least, min(most, -(-size // int(mb * 1e6))))


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, since whole documents may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir)."""
    return settled(df)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that shuffle files behind a checkpoint go before the next step writes its own.

    To be called when nothing refers to the frame before the checkpoint any more.
    """
    for _ in range(3):  # Python's frames let go of the JVM's in a thread of their own, and these are collected after that
        gc.collect()
        time.sleep(0.7)
        spark.sparkContext._jvm.System.gc()


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, for arrays of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.array([_mix_int(i + 1) for i in range(256)], np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_R = _mix_int(12345) | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and lengthened as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 20), base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least: bounds the working memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums so that span_hash() can tell the hash of any span of data."""
    v = (_BYTE_LOWER if lower else _BYTE)[data]
    v *= _power(_R, len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], whatever its place."""
    return mix((sums[end] - sums[start]) * _power(_R_INV, len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each word (SPACE-separated; never across rows)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~_IS_SPACE[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    at = off[:-1][off[:-1] < n]
    first[at] = w[at]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = off[1:][off[1:] > 0] - 1
    last[at] = w[at]
    start = np.flatnonzero(first)
    return np.searchsorted(off, start, "right") - 1, start, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() with the hash of each. Rows go in pieces: sums take several 64-bit numbers for each byte, and no word crosses a row."""
    found = []
    for i, j in pieces(off):
        d = data[off[i] : off[j]]
        row, start, end = words(d, off[i : j + 1] - off[i])
        found.append((row + i, start + off[i], end + off[i], span_hash(prefix_hash(d, lower), start, end)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
