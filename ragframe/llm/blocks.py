"""Corpus counts without a row for each occurrence.

Documents are dealt into blocks of a few megabytes. A block counts its own 64-bit keys in numpy and sends them, sorted, to parts by
key range: one row for each block and part. A part sums what all blocks sent, and can answer each block in the order of its keys.
So a hot key reaches its part once from each block, and the volume moved is that of the distinct keys of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = "part int, block int, kind int, keys binary, counts binary"
_KEYS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def blocked(docs: DataFrame, key: str, n: int) -> DataFrame:
    """docs with a column block, dealt by it."""
    return docs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "block")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts by ranges of keys: sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of KEYS for sorted distinct keys."""
    p = part_of(keys, parts)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]]) if len(p) else np.zeros(1, np.int64)
    counts = counts.astype("<u4")
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(p[a]), block, kind, keys[a:b].tobytes(), counts[a:b].tobytes()


def key_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KEYS)], schema=_KEYS)


def received(t: pa.Table, kind: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of one part and kind: the blocks in order, the number of keys of each, all keys and all counts end to end."""
    t = t.filter(pa.compute.equal(t["kind"], kind))
    if not t.num_rows:
        return [], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = t["block"].to_pylist()
    keys = [x.as_buffer() for x in t["keys"]]
    counts = [x.as_buffer() for x in t["counts"]]
    n = np.array([k.size // 8 for k in keys], np.int64)
    return blocks, n, np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
