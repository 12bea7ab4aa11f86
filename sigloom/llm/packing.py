"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

An item goes where the sum, over residual gaps, of the squared number of open sequences with that gap becomes smallest:
into an open sequence with gap g, item size s, the sum changes by 2 * (N(g - s) - N(g) + 1), so the rule takes the g
with the smallest N(g - s) - N(g), the smaller gap on ties. Only the counts per gap matter, at most `capacity` numbers.
One departure from the rule: a new sequence, which would change the sum by 2 * N(capacity - s) + 1, is opened only if the
item fits in none that is open, since the aim is as few sequences as possible and no stream of later items is awaited;
tests compare the number with that of the plain rule.

Items are dealt at random into groups that tasks pack on their own. Sequences that a group leaves less than nearly full
are dissolved and their items packed again in fewer groups, until one group is left or nothing is gained, so the loss
against one single group stays a few sequences per group of the last round.

Defined results: null text is an empty document, one end id; a text of any length is cut whole; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, materialize, release
from .tokens import END_ID, default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but for the first, which holds the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    cuts = ([0] if first else []) + list(range(first, length, capacity))
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:] + [length], strict=True)], strict=True))


def token_pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, offs in enc.encode(batch.column(1)):
                view = memoryview(np.insert(ids, offs[1:], np.uint32(end_id)).astype("<u4").tobytes())
                rows: list[tuple] = []
                for i in range(len(offs) - 1):
                    begin, length = int(offs[i]) + i, int(offs[i + 1] - offs[i]) + 1
                    for k, (at, n) in enumerate(pieces_of(length, capacity)):
                        rows.append((doc_ids[first + i], k, at, n, zlib.crc32(view[4 * (begin + at) : 4 * (begin + at + n)])))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and offset of each item, placed in the given order."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    places, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        change = np.where(counts[s:] > 0, counts[: capacity + 1 - s] - counts[s:], far)
        change[0] = -counts[s] if counts[s] else far  # a filled sequence leaves the sum and adds no gap
        g = s + int(np.argmin(change))
        if change[g - s] < far:
            place = open_at[g].pop()
            counts[g] -= 1
        else:
            g, place, made = capacity, made, made + 1
        places[i], offsets[i] = place, capacity - g
        if g > s:
            open_at[g - s].append(place)
            counts[g - s] += 1
    return places, offsets


def filler(k: int, last: bool, capacity: int, least: int):
    """Packs one group of round k; in the last round every sequence is final, else those of at least `least` tokens."""

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        # Longest first: the small items come when they can level the gaps.
        df = df.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        sizes = df["length"].to_numpy()
        place, offset = sum_of_squares(sizes, capacity)
        used = np.bincount(place, weights=sizes)[place]
        group = int(df["_group"].iloc[0])
        df = df.drop(columns=["_group"])
        df["sequence_id"] = (np.int64(k) << 58) | (np.int64(group) << 26) | place
        df["offset"] = offset
        df["_done"] = True if last else used >= least
        give_back()
        return df

    return fill


def pack(pieces: DataFrame, capacity: int = 1024, group_items: int = 20_000, full_share: float = 0.99, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity.

    Sequence ids are unique across groups and rounds. A group's size is bounded by group_items, on average.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    held = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))  # read again in the first round alone
    left, done = held, []
    total = left.count()
    least = int(capacity * full_share)

    for k in range(rounds):
        n = left.count() if k else total
        groups = max(1, -(-n // group_items))
        last = groups == 1 or k == rounds - 1

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(k)), F.lit(groups)).cast("int"))
        filled = dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(filler(k, last, capacity, least), f"{kinds}, sequence_id long, `offset` long, _done boolean")
        filled = materialize(filled)
        if not k:
            release(held)
        done.append(filled.where("_done").select(*cols, "sequence_id", "offset"))
        if last:
            break
        left = filled.where("not _done").select(*held.columns)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out
