"""Meeting places of items that share a 64-bit key, found with one compact shuffle.

A task that made (key, item) entries joins items that share a key within the task at once, so that only the least item
of each key goes on: a key holds at most one entry per flush of a task, however hot it is. Entries travel as one binary
per bucket of keys, 10 bytes each, and meet their likes in a task per bucket.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame

from .textbytes import U64


def buckets_for(df: DataFrame, bytes_per_bucket: int = 4 << 20) -> int:
    """Buckets so that each holds the entries of about so many bytes of input, at least the shuffle partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-min(size, 1 << 50) // bytes_per_bucket)), 1 << 24)


def meet(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least item of each) and the links (item, least item) of items that share a key."""
    if not len(keys):
        none = np.zeros(0, np.int64)
        return keys, none, none, none
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    first = np.empty(len(keys), dtype=bool)
    first[0] = True
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    least = items[at]
    of = np.repeat(least, np.diff(np.append(at, len(keys))))
    linked = of != items
    pairs = np.unique(np.stack([items[linked], of[linked]], axis=1), axis=0) if linked.any() else np.zeros((0, 2), np.int64)
    return keys[at], least, pairs[:, 0], pairs[:, 1]


def write_entries(keys: np.ndarray, items: np.ndarray) -> bytes:
    """48 bits of each key; items as offsets from the least, 4 bytes if they fit."""
    base = int(items.min())
    spread = items - base
    wide = bool(spread.max() >= 1 << 32)
    low, high = (keys & U64(0xFFFFFFFF)).astype("<u4"), ((keys >> U64(32)) & U64(0xFFFF)).astype("<u2")
    return struct.pack("<q?", base, wide) + low.tobytes() + high.tobytes() + spread.astype("<i8" if wide else "<u4").tobytes()


def read_entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, wide = struct.unpack_from("<q?", data)
    n = (len(data) - 9) // (14 if wide else 10)
    low, high = np.frombuffer(data, "<u4", n, 9), np.frombuffer(data, "<u2", n, 9 + 4 * n)
    items = np.frombuffer(data, "<i8" if wide else "<u4", n, 9 + 6 * n).astype(np.int64) + base
    return low.astype(U64) | high.astype(U64) << U64(32), items


def by_bucket(keys: np.ndarray, items: np.ndarray, buckets: int):
    """(bucket, entries) of keys; the bucket comes from the key's upper bits, which entries leave out."""
    bucket = ((keys >> U64(40)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, items = bucket[order], keys[order], items[order]
    found, at = np.unique(bucket, return_index=True)
    ends = np.append(at[1:], len(bucket))
    for b, s, e in zip(found.tolist(), at.tolist(), ends.tolist(), strict=True):
        yield b, write_entries(keys[s:e], items[s:e])
