"""Vector code compression: product codes of integer parts, found through memoised grid cells.

A vector's components become floor(scale * x) and are cut into equal consecutive parts; each part position has a codebook
of up to `entries` integer entries, trained by `rounds` of assignment and floored means. To assign a part, its coarse
grid cell is hashed. A cell's memo holds the entries that no other entry dominates across the cell's box: those whose
least distance to the box is not above the smallest of all entries' largest distances to it. Only these are evaluated
exactly, so the nearest entry, ties to the lower index, is the one that evaluating all entries would give. The cell width
of a position is the widest power of two at which boxes around the starting parts keep at most a `share` of the entries
on average; it and the memo's size (MEMO cells a position and task, then it starts anew) change speed alone.

Tasks send one sum and count per entry and round, Spark adds them up, and only codebooks (entries times components, a
fixed size) pass through the driver. All arithmetic is on integers and exact, beyond 64 bits on Python's own.

Defined results: a null vector, or one with null or non-finite components, is dropped. Parts need equal lengths: a vector
whose length is not the table's most frequent multiple of `parts` (ties to the smaller), or with a component that has no
integer below 2**62, takes no part and has null code and error. Null ids come last among the first `entries`, equal ids
are ordered by their vectors; repeated rows count each. With fewer rows than entries the codebooks are as many. Errors
beyond 64 bits are null. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MEMO = 20_000
#: Starting parts by which a cell width is chosen.
SAMPLE = 64
#: Numbers of a temporary array.
AT_ONCE = 1 << 19
BROADCAST_ROWS = 100_000
LIMIT = 1 << 62


def exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if squared distances times entries fit, else as Python integers."""
    most = max((abs(int(v)) for y in (x, book) if y.size for v in (y.min(), y.max())), default=0)
    if 16 * (most + 1) ** 2 * max(1, book.shape[1]) * max(1, len(book)) < 1 << 63:
        return x.astype(np.int64), book.astype(np.int64)
    return x.astype(object), book.astype(object)


def undominated(cells: np.ndarray, width: int, book: np.ndarray) -> list[np.ndarray]:
    """Per cell, the entries that may be nearest to a point of its box [cell * width, (cell + 1) * width)."""
    out: list[np.ndarray] = []
    step = max(1, AT_ONCE // max(1, book.size))
    for i in range(0, len(cells), step):
        low = (cells[i : i + step] * width)[:, None, :]
        below, above = low - book, book - (low + (width - 1))
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        least, most = (near * near).sum(axis=2), (far * far).sum(axis=2)
        out += [np.flatnonzero(row) for row in least <= most.min(axis=1)[:, None]]
    return out


def cell_width(sample: np.ndarray, book: np.ndarray, share: float) -> int:
    """The widest power of two at which boxes of the sample's cells keep at most share of the entries on average."""
    sample, book = exact(sample, book)
    spread = int(max(sample.max(), book.max())) - int(min(sample.min(), book.min()))
    narrow, wide = 0, max(1, spread).bit_length()
    while narrow < wide:  # what is kept grows with the width
        power = (narrow + wide + 1) // 2
        kept = np.mean([len(c) for c in undominated(sample // (1 << power), 1 << power, book)])
        narrow, wide = (power, wide) if kept <= max(1.0, share * len(book)) else (narrow, power - 1)
    return 1 << narrow


class CellMemo:
    """The nearest entry of a codebook, by memoised grid cells."""

    def __init__(self, book: np.ndarray, width: int):
        self.book, self.width = book, width
        self.memo: dict[bytes | tuple, np.ndarray] = {}

    def _kept(self, cells: np.ndarray, book: np.ndarray) -> list[np.ndarray]:
        keys = [tuple(c) for c in cells] if cells.dtype == object else [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(range(len(keys)))
        for i, entries in zip(new, undominated(cells[new], self.width, book), strict=True):
            self.memo[keys[i]] = entries.astype(np.int32)
        return [self.memo[k] for k in keys]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, entries evaluated) of each row of x."""
        x, book = exact(x, self.book)
        entry, distance, tried = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), np.zeros(len(x), np.int64)
        cells = x // self.width
        if x.dtype == object:
            index: dict[tuple, int] = {}
            of = np.array([index.setdefault(tuple(c), len(index)) for c in cells], dtype=np.int64)
            cells = np.array(list(index), dtype=object).reshape(len(index), x.shape[1])
        else:
            cells, of = np.unique(cells, axis=0, return_inverse=True)
            of = of.reshape(-1)
        kept = self._kept(cells, book)
        lengths = np.array([len(k) for k in kept], dtype=np.int64)
        flat, firsts = np.concatenate(kept), np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(lengths[of])
        step = max(len(book), AT_ONCE // x.shape[1])
        i = 0
        while i < len(x):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + step, "right")))
            counts = lengths[of[i:j]]
            row = np.repeat(np.arange(i, j), counts)
            starts = np.cumsum(counts) - counts
            at = flat[np.arange(counts.sum()) - np.repeat(starts, counts) + firsts[of[row]]]
            apart = x[row] - book[at]
            best = np.minimum.reduceat((apart * apart).sum(axis=1) * len(book) + at, starts)
            entry[i:j], distance[i:j], tried[i:j] = best % len(book), best // len(book), counts
            i = j
        return entry, distance, tried


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The parts of a batch as one row per vector."""
    return batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, dim)


def _mean(sums: np.ndarray, counts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their mean; those without parts stay."""
    out = book.astype(object)
    for i in np.flatnonzero(counts):
        out[i] = [int(s) // int(counts[i]) for s in sums[i]]
    return out


def codebooks(coded: DataFrame, dim: int, parts: int, entries: int, rounds: int, share: float) -> tuple[list[np.ndarray], list[int]]:
    """The trained codebooks and their cell widths, from rows (vec_id, _x)."""
    spark = coded.sparkSession
    wide = dim // parts
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "_x").limit(entries).select("_x").collect()
    seeds = np.array([r["_x"] for r in first], dtype=object).reshape(len(first), dim)
    books = [seeds[:, p * wide : (p + 1) * wide] for p in range(parts)]
    samples = [b[:: max(1, len(b) // SAMPLE)] for b in books]

    def widths() -> list[int]:
        return [cell_width(s, b, share) for s, b in zip(samples, books, strict=True)]

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((books, widths()))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            memos = [CellMemo(b, w) for b, w in zip(*sent.value, strict=True)]
            total = [np.zeros(m.book.shape, dtype=object) for m in memos]
            count = [np.zeros(len(m.book), dtype=np.int64) for m in memos]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _integers(batch, dim)
                for p, memo in enumerate(memos):
                    part = x[:, p * wide : (p + 1) * wide]
                    entry, _, _ = memo.nearest(part)
                    order = np.argsort(entry, kind="stable")
                    found, at, n = np.unique(entry[order], return_index=True, return_counts=True)
                    add = part[order]
                    if max(int(add.max()), -int(add.min())) >= LIMIT // batch.num_rows:
                        add = add.astype(object)  # sums may pass 64 bits
                    total[p][found] += np.add.reduceat(add, at, axis=0)
                    count[p][found] += n
            rows = [(p, int(e), int(count[p][e]), [Decimal(int(v)) for v in total[p][e]]) for p in range(parts) for e in np.flatnonzero(count[p])]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

        sent_sums = coded.select("_x").mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>")
        flat = sent_sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        rows = flat.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for r in rows:
            total[r["part"]][r["entry"], r["pos"]] = int(r["s"])
            count[r["part"]][r["entry"]] = r["n"]
        books = [_mean(s, n, b) for s, n, b in zip(total, count, books, strict=True)]
        sent.unpersist()
    return books, widths()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, share: float = 1 / 8) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256, and evaluated: the entries evaluated exactly for the code.

    code has two hex digits or more a part. label_error sums error over equal labels, nulls together.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", v.alias("_v"))
    fits = F.forall("_v", lambda x: F.abs(x * scale) < float(LIMIT))
    rows = materialize(rows.select("vec_id", "label", F.when(fits, F.transform("_v", lambda x: F.floor(x * scale).cast("long"))).alias("_x")))
    sizes = rows.where(F.size("_x") > 0).where(F.size("_x") % parts == 0).groupBy(F.size("_x").alias("dim")).count()
    usual = sizes.orderBy(F.desc("count"), "dim").limit(1).collect()
    if not usual:
        empty = "cast(null as string) as code, cast(null as long) as error, cast(null as long) as label_error, cast(null as string) as codebooks_sha256, cast(null as long) as evaluated"
        return rows.selectExpr("vec_id", "label", *empty.split(", "))
    dim = usual[0]["dim"]
    usable = F.coalesce(F.size("_x") == dim, F.lit(False))
    books, widths = codebooks(rows.where(usable), dim, parts, entries, rounds, share)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    sent = spark.sparkContext.broadcast((books, widths))
    digits, wide = max(2, len(f"{len(books[0]) - 1:x}")), dim // parts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(b, w) for b, w in zip(*sent.value, strict=True)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch, dim)
            found = [m.nearest(x[:, p * wide : (p + 1) * wide]) for p, m in enumerate(memos)]
            code = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*[f[0].tolist() for f in found], strict=True)]
            error = [sum(row) for row in zip(*[f[1].tolist() for f in found], strict=True)]
            error = [e if e < 1 << 63 else None for e in error]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64()), pa.array(sum(f[2] for f in found))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "evaluated"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, evaluated long"
    out = rows.where(usable).mapInArrow(assign, schema)
    rest = rows.where(~usable).selectExpr("vec_id", "label", "cast(null as string) as code", "cast(null as long) as error", "cast(null as long) as evaluated")
    out = materialize(out.unionByName(rest))
    release(rows)
    by_label = out.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = materialize(by_label.withColumn("label_error", F.expr("try_cast(label_error as long)")))
    few = by_label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = out.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"), "evaluated")
