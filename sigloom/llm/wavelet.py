"""Token-id output: one wavelet matrix per shard, a single compressed file that answers access, count and occurrence queries.

A shard's bytes are a header (magic, number of documents, tokens and bit planes), the documents' ids and lengths, the
number of zeros of each plane, and the planes themselves, most significant bit first, with a rank count every 512 bits.
There are as many planes as the largest id has bits. Each shard is a Parquet file of its own with one row, whose payload
column holds these bytes, compressed by the file's codec, so that any store that Spark writes to can hold it.

Defined results: a null text is an empty document, which has the end id alone; rows with equal ids are ordered by length, then text; a null id comes first;
an empty table gives no shard and no row; a text of any length is one document of one shard; other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import buckets_for
from .common import lean, materialize, text_or_empty
from .tokens import END_ID, default_path, encoder

MAGIC = b"WMX1"
BLOCK = 512
#: Bits of a plane that are made or undone at once, a multiple of 8: their positions stay in a core's cache.
RUN = 1 << 16
#: Stands for a null doc_id inside a shard.
NULL_ID = -(1 << 63)
SHARD_SCHEMA = "part int, shard int, docs long, before long, tokens long, payload binary"


class WaveletMatrix:
    """A sequence of unsigned ids as succinct bit planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], length: int):
        self.planes, self.zeros, self.length = planes, zeros, length
        self.ranks = [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        ones = np.bitwise_count(plane).astype(np.uint64)
        step = BLOCK // 8
        padded = np.zeros(-(-len(ones) // step) * step, np.uint64)
        padded[: len(ones)] = ones
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, step).sum(axis=1))]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        low, high = np.empty_like(row), np.empty_like(row)
        planes, zeros = [], []
        for bit in reversed(range(bits)):
            plane, z, o = np.empty(-(-len(row) // 8), np.uint8), 0, 0
            for at in range(0, len(row), RUN):
                some = row[at : at + RUN]
                on = some & row.dtype.type(1 << bit) != 0
                plane[at // 8 : (at + RUN) // 8] = np.packbits(on)
                off, on = np.flatnonzero(~on), np.flatnonzero(on)
                some.take(off, out=low[z : z + len(off)], mode="clip")  # other modes would go by a copy
                some.take(on, out=high[o : o + len(on)], mode="clip")
                z, o = z + len(off), o + len(on)
            low[z:] = high[:o]
            row, low = low, row
            planes.append(plane)
            zeros.append(z)
        return cls(planes, zeros, len(ids))

    def _rank1(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block = at // BLOCK
        first, last = block * BLOCK // 8, at // 8
        n = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][first:last]).sum())
        if at % 8:
            n += (int(self.planes[level][last]) >> (8 - at % 8)).bit_count()
        return n

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, at)
            value = value << 1 | bit
            ones = self._rank1(level, at)
            at = z + ones if bit else at - ones
        return value

    def _descend(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> len(self.zeros):
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (z + a, z + b) if value >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        a, b = self._descend(value, start, self.length if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) bit of a kind, by binary search in the rank directory."""
        low, high = 0, self.length
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrence(self, value: int, nth: int) -> int:
        """Position of an id's nth occurrence (from 0); -1 if there are not so many."""
        a, b = self._descend(value, 0, self.length)
        if not 0 <= nth < b - a:
            return -1
        at = a + nth
        for level in reversed(range(len(self.zeros))):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, undoing each plane's stable partition from the last to the first."""
        row = np.zeros(self.length, np.uint16 if len(self.planes) <= 16 else np.uint32)
        out = np.empty_like(row)
        for level in reversed(range(len(self.planes))):
            low, high = 0, self.zeros[level]
            row[high:] |= row.dtype.type(1 << (len(self.planes) - 1 - level))
            for at in range(0, self.length, RUN):
                some = out[at : at + RUN]
                on = np.unpackbits(self.planes[level][at // 8 : (at + RUN) // 8], count=len(some)).view(bool)
                ones, zeros = np.flatnonzero(on), np.flatnonzero(~on)  # by position: a third of the time that a mask takes
                some[ones] = row[high : high + len(ones)]
                some[zeros] = row[low : low + len(zeros)]
                low, high = low + len(zeros), high + len(ones)
            row, out = out, row
        return row.astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QH", self.length, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(r.astype("<u4").tobytes() for r in self.ranks) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        length, bits = struct.unpack_from("<QH", data)
        zeros = np.frombuffer(data, "<u8", bits, 10).tolist()
        n, blocks = -(-length // 8), -(-(-(-length // 8)) // (BLOCK // 8)) + 1
        at = 10 + 8 * bits
        out = cls.__new__(cls)
        out.ranks = [np.frombuffer(data, "<u4", blocks, at + 4 * blocks * i) for i in range(bits)]
        at += 4 * blocks * bits
        out.planes = [np.frombuffer(data, np.uint8, n, at + n * i) for i in range(bits)]
        out.zeros, out.length = zeros, length
        return out


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    body = np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes()
    return MAGIC + struct.pack("<Q", len(doc_ids)) + body + WaveletMatrix.build(ids).to_bytes()


def open_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the ids' wavelet matrix."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    (n,) = struct.unpack_from("<Q", data, 4)
    docs, lengths = (np.frombuffer(data, "<i8", n, 12 + 8 * n * i) for i in range(2))
    return docs, lengths, WaveletMatrix.from_bytes(data[12 + 16 * n :])


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = 1 << 21, end_id: int = END_ID) -> DataFrame:
    """Encodes documents in ascending doc_id order into shards of about shard_tokens tokens, a whole document at least.

    Returns the written table: one row and payload per shard; (part, shard) ascending is the order of the documents, and
    `before` counts the tokens of the part's earlier shards.
    """
    path = tokenizer or default_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, before
            docs_, lens, all_ids = np.concatenate(names), np.concatenate(sizes), np.concatenate(ids)
            row = [[part], [shard], [len(docs_)], [before], [len(all_ids)], [pack_shard(docs_, lens, all_ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "shard", "docs", "before", "tokens", "payload"])
            names.clear(), sizes.clear(), ids.clear()
            shard, held, before = shard + 1, 0, before + len(all_ids)
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, got, offs in enc.encode(batch.column(1)):
                n = len(offs) - 1
                ended = np.insert(got, offs[1:], np.uint32(end_id))
                names.append(doc_ids[first : first + n])
                sizes.append(np.diff(offs) + 1)
                ids.append(ended)
                held += len(ended)
                if held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    wanted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_or_empty().alias("text"))
    n = buckets_for(wanted, 64 << 20)
    ordered = wanted.repartitionByRange(n, "doc_id", F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    return materialize(ordered.mapInArrow(lean(shards), SHARD_SCHEMA), maxRecordsPerFile=1, compression="zstd")


def read_documents(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()  # one row per task
    before, starts = 0, []
    for r in totals:
        starts.append((r["part"], before))
        before += r["tokens"]
    spark = shards.sparkSession
    bases = spark.createDataFrame(starts, "part int, base long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, lengths, matrix = open_shard(payload.as_py())
                data = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(data.tobytes())
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    both = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("base"), "payload")
    return both.mapInArrow(lean(documents), "doc_id long, start long, n_tokens long, ids_crc32 long")
