"""Language-model scoring with a log-frequency Bloom filter.

Counting. Tasks count word pairs and words of the training texts by 64-bit hash and send them as one binary per bucket
of hashes; a task per bucket adds them up. The bucket's piece of the filter holds each pair with count c at the levels
1 .. 1 + floor(log_base(c)), by `hashes` bits per level. Words keep exact counts.

Scoring. P(w | h) = k * c(h, w) / c(h) + (1 - k) * P(w), with P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); h is the word
before, the end mark at the start; k depends on the magnitude of c(h). c(h, w) is the least count of the highest level
for which the filter still answers yes, so it takes one membership probe per level; a pair with an unknown word is not
probed, and c(h, w) is never above c(h) or c(w). A filter answers wrongly for one pair in 2 ** hashes.

Smoothing. k is the likeliest weight on the training texts when each token is predicted from the counts without it
(deleted interpolation): a pass over all of them sums up a histogram of the ratio of both estimates per magnitude.

The filter and the word counts are sent to all tasks while both are within max_broadcast bytes. Beyond that nothing is
sent: texts are written in chunks of rows; a chunk's distinct pairs and words go to the buckets in about 6 bytes each, are
probed there, and come back in the same order, a byte each, so without their keys. What the estimates need of each token
is then written, by document, and no text is read again.

Defined results: null text is empty, one end mark; rows with equal ids and texts get equal scores; without training
texts N and V are 0 and every word is unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .cells import buckets_for
from .common import give_back, materialize, release, tidy
from .textbytes import BASES, U64, mix, slices, word_hashes

END = U64(0xA0761D6478BD642F)
COUNTED = "bucket long, width int, data binary"
MODEL = "bucket long, words binary, word_counts binary, bits binary, pairs long"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def sequences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row, each followed by the end mark, and the len+1 offsets of rows."""
    words, rows = word_hashes(raw, offs)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def pair_keys(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor and the key of the pair; the first of a row follows the end mark."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    if len(tokens):
        before[rows[:-1]] = END
    return before, mix(before * BASES[0] + mix(tokens))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Filter:
    """Pieces of a log-frequency Bloom filter, one per bucket of keys."""

    def __init__(self, pieces: dict[int, bytes], buckets: int, hashes: int, base: float):
        self.buckets, self.hashes, self.base = buckets, hashes, base
        self.bits = np.empty(sum(map(len, pieces.values())), np.uint8)
        self.at, self.size, self.used = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
        for b in sorted(pieces):
            self.add(b, pieces[b])

    @classmethod
    def of_size(cls, size: int, buckets: int, hashes: int, base: float) -> "Filter":
        """Without pieces yet, with room for `size` bytes of them."""
        out = cls({}, buckets, hashes, base)
        out.bits = np.empty(size, np.uint8)
        return out

    def add(self, bucket: int, piece: bytes) -> None:
        self.at[bucket], self.size[bucket] = self.used, len(piece)
        self.bits[self.used : self.used + len(piece)] = np.frombuffer(piece, np.uint8)
        self.used += len(piece)

    @staticmethod
    def places(keys: np.ndarray, level: int, hashes: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
        a = mix(keys + U64(level) * BASES[1])
        step = mix(a ^ BASES[0]) | U64(1)
        for _ in range(hashes):
            yield (a >> U64(8)) % np.asarray(bits, dtype=U64)
            a = a + step

    @classmethod
    def piece(cls, keys: np.ndarray, counts: np.ndarray, hashes: int, base: float) -> bytes:
        """A bucket's bits, half of them set when its keys are in."""
        levels = 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)
        bits = max(64, int(levels.sum() * hashes * 1.4427)) // 8 * 8
        on = np.zeros(bits, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for place in cls.places(keys[levels >= level], level, hashes, bits):
                on[place.astype(np.int64)] = True
        return np.packbits(on, bitorder="little").tobytes()

    @staticmethod
    def least(levels: np.ndarray, base: float) -> np.ndarray:
        """The least count of each level, 0 for level 0."""
        return np.array([0, *(int(np.ceil(base**i - 1e-9)) for i in range(int(levels.max(initial=0))))], dtype=np.int64)[levels]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The least count of the highest level of each key that the filter knows, 0 for none."""
        return self.least(self.levels(keys), self.base)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key that the filter knows, 0 for none."""
        out = np.zeros(len(keys), np.uint8)
        bucket = (keys % U64(self.buckets)).astype(np.int64)
        alive = np.flatnonzero(self.size[bucket] > 0)
        level = 1
        while len(alive):
            at, bits = self.at[bucket[alive]], (self.size[bucket[alive]] * 8).astype(U64)
            a = mix(keys[alive] + U64(level) * BASES[1])
            step = mix(a ^ BASES[0]) | U64(1)
            for _ in range(self.hashes):
                place = ((a >> U64(8)) % bits).astype(np.int64)
                yes = np.flatnonzero(self.bits[at + (place >> 3)] >> (place & 7).astype(np.uint8) & 1)
                alive, at, bits, step = alive[yes], at[yes], bits[yes], step[yes]
                a = a[yes] + step
            out[alive] = level
            level += 1
        return out


class WordCounts:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0).astype(np.int64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each; counts of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(data: bytes, n: int, at: int = 0) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + n)
    return counts


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers: the low bytes of each in full, a byte for the step of what is above them."""
    gap = int(np.diff(values, prepend=U64(0)).max(initial=0))
    low = next(n for n in range(9) if (gap >> 8 * n) + 1 < 256)
    high = values >> U64(8 * low) if low < 8 else np.zeros_like(values)
    return bytes([low]) + np.diff(high, prepend=U64(0)).astype(np.uint8).tobytes() + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low = data[0]
    n = (len(data) - 1) // (1 + low)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, 1 + n).reshape(n, low)
    high = np.cumsum(np.frombuffer(data, np.uint8, n, 1), dtype=U64)
    return out.view("<u8").reshape(-1) | (high << U64(8 * low) if low < 8 else U64(0))


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys; ascending keys give ascending places."""
    bucket = (keys % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, at[1:]), strict=True)


def count_model(texts: DataFrame, hashes: int = 8, base: float = 1.5, flush: int = 2_000_000) -> tuple[DataFrame, int]:
    """Written table with each bucket's words, their counts and piece of the filter; the number of buckets."""
    buckets = buckets_for(texts, 8 << 20)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        size = 0

        def flush_out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for width, lists in held.items():
                if lists:
                    keys, counts = added(np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists]))
                    lists.clear()
                    bucket = (keys % U64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    found, at = np.unique(bucket[order], return_index=True)
                    keys, counts = keys[order], counts[order]
                    data = []
                    for k, c in zip(np.split(keys, at[1:]), np.split(counts, at[1:]), strict=True):
                        data.append(np.int64(len(k)).tobytes() + k.tobytes() + packed_counts(c))
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), width, np.int32)), pa.array(data, pa.binary())], names=["bucket", "width", "data"])
            size = 0

        for batch in batches:
            for _, raw, offs in slices(batch.column("text")):
                tokens, rows = sequences(raw, offs)
                for width, keys in ((1, tokens), (2, pair_keys(tokens, rows)[1])):
                    k, c = added(keys, np.ones(len(keys), np.int64))
                    held[width].append((k, c))
                    size += len(k)
                if size >= flush:
                    yield from flush_out()
        yield from flush_out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if current is not None:
                sums = {w: added(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x])) if x else (np.zeros(0, U64), np.zeros(0, np.int64)) for w, x in held.items()}
                row = ([current], [sums[1][0].tobytes()], [sums[1][1].tobytes()], [Filter.piece(*sums[2], hashes, base)], [len(sums[2][0])])
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["bucket", "words", "word_counts", "bits", "pairs"])
            for x in held.values():
                x.clear()

        for batch in batches:
            for bucket, width, data in zip(batch.column("bucket").to_pylist(), batch.column("width").to_pylist(), batch.column("data"), strict=True):
                if bucket != current:
                    yield from done()
                    current = bucket
                raw = data.as_py()
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                held[width].append((np.frombuffer(raw, "<u8", n, 8), unpacked_counts(raw, n, 8 + 8 * n)))
        yield from done()

    counted = texts.select("text").mapInArrow(count, COUNTED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    with tidy(texts.sparkSession):
        return materialize(counted.mapInArrow(gather, MODEL)), buckets


#: Classes of log2 c(h); of the log2 ratio of pair and word estimate, the first for pairs not seen elsewhere.
MAGNITUDES, RATIOS = 40, 64


class Estimates:
    """Counts and both estimates for the tokens of some rows."""

    def __init__(self, c: np.ndarray, rows: np.ndarray, of_pair):
        """c: each token's count; of_pair: pair counts of the tokens at some places."""
        self.c = c
        self.c_before = np.empty_like(self.c)
        self.c_before[1:] = self.c[:-1]
        self.c_before[rows[:-1]] = self.c[rows[1:] - 1]  # each row ends with an end mark
        self.both = np.zeros(len(c), np.int64)
        probe = np.flatnonzero((self.c > 0) & (self.c_before > 0))
        self.both[probe] = np.minimum(np.minimum(of_pair(probe), self.c[probe]), self.c_before[probe])
        self.magnitude = np.log2(np.maximum(self.c_before, 1)).astype(np.int64).clip(0, MAGNITUDES - 1)
        self.rows = rows

    @classmethod
    def of_texts(cls, raw: np.ndarray, offs: np.ndarray, of_word, of_pair) -> "Estimates":
        tokens, rows = sequences(raw, offs)
        keys = pair_keys(tokens, rows)[1]
        words, which = np.unique(tokens, return_inverse=True)

        def pairs_at(places: np.ndarray) -> np.ndarray:
            pairs, which = np.unique(keys[places], return_inverse=True)
            return of_pair(pairs)[which]

        return cls(of_word(words)[which], rows, pairs_at)

    def ratios(self, total: int, distinct: int) -> np.ndarray:
        """Histogram over (magnitude, ratio) of tokens whose own occurrence is taken out of the counts."""
        use = self.c_before > 1
        pair = (self.both[use] - 1).clip(0) / (self.c_before[use] - 1)
        word = ((self.c[use] - 1).clip(0) + 0.5) / (total - 1 + 0.5 * (distinct + 1))
        ratio = np.where(pair > 0, np.log2(np.maximum(pair, 1e-300) / word), -np.inf)
        place = np.where(pair > 0, (np.round(ratio).clip(-15, RATIOS - 17) + 16), 0).astype(np.int64)
        return np.bincount(self.magnitude[use] * RATIOS + place, minlength=MAGNITUDES * RATIOS)

    def scores(self, total: int, distinct: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: known tokens, base score and score."""
        p = (self.c + 0.5) / (total + 0.5 * (distinct + 1))
        k = np.where(self.c_before > 0, weights[self.magnitude], 0.0)
        smoothed = k * self.both / np.maximum(self.c_before, 1) + (1 - k) * p
        at = self.rows[:-1]
        return np.add.reduceat((self.c > 0).astype(np.int64), at), np.add.reduceat(np.log10(p), at), np.add.reduceat(np.log10(smoothed), at)


def likeliest_weights(histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The weight of the pair estimate per magnitude that makes the histogram's tokens likeliest; below 1."""
    ratio = np.append(0.0, 2.0 ** np.arange(-15, RATIOS - 16))
    out = np.zeros(MAGNITUDES)
    for m, n in enumerate(histogram.reshape(MAGNITUDES, RATIOS)):
        k = 0.5 if n.sum() else 0.0
        for _ in range(rounds if n.sum() else 0):
            k = float((n * (k * ratio / (k * ratio + 1 - k))).sum() / n.sum())
            k = min(k, 0.999)
        out[m] = k
    return out


def score(docs: DataFrame, held_out: Column, hashes: int = 8, base: float = 1.5, max_broadcast: int = 256 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learnt where held_out is false."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    model, buckets = count_model(rows.where(~F.col("held_out")).select("text"), hashes, base)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bits = batch.column("word_counts"), batch.column("bits")
            sums = [[int(np.frombuffer(x.as_py(), np.int64).sum()) for x in counts], [len(x.as_py()) // 8 for x in counts], [len(x.as_py()) for x in bits]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sums], names=["n", "v", "b"])

    sums = model.select("word_counts", "bits").mapInArrow(summed, "n long, v long, b long").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "nvb")).first()
    total, distinct = sums["n"], sums["v"]
    small = sums["b"] + 16 * distinct <= max_broadcast
    each = _by_broadcast(rows, model, distinct, sums["b"], buckets, hashes, base) if small else _by_buckets(rows, model, buckets, hashes, base)

    def ratios(batch: pa.RecordBatch, e: Estimates) -> pa.RecordBatch:
        n = e.ratios(total, distinct)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    histogram = np.zeros(MAGNITUDES * RATIOS)
    for r in each(ratios, "place long, n long", ~F.col("held_out")).groupBy("place").agg(F.sum("n").alias("n")).collect():
        histogram[r["place"]] = r["n"]
    weights = likeliest_weights(histogram)

    def scores(batch: pa.RecordBatch, e: Estimates) -> pa.RecordBatch:
        cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(e.rows)), *map(pa.array, e.scores(total, distinct, weights))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return each(scores, OUT, F.lit(True)).withColumn("train_tokens", F.lit(total).cast("long"))


def _by_broadcast(rows: DataFrame, model: DataFrame, distinct: int, size: int, buckets: int, hashes: int, base: float):
    """each(function, schema, condition): applies the function to all rows with the filter and word counts at hand.

    The model, within max_broadcast, comes to the driver a partition at a time and is held there once, until it is sent.
    """
    give_back()
    words, counts, at = np.empty(distinct, np.uint64), np.empty(distinct, np.int64), 0
    pairs = Filter.of_size(size, buckets, hashes, base)
    for r in model.select("bucket", "words", "word_counts", "bits").toLocalIterator():
        n = len(r["words"]) // 8
        words[at : at + n], counts[at : at + n] = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["word_counts"], np.int64)
        pairs.add(r["bucket"], r["bits"])
        at += n
    known = WordCounts(words, counts)
    del words, counts
    sent = rows.sparkSession.sparkContext.broadcast((known, pairs))
    del known, pairs
    release(model)
    give_back()

    def each(function, schema: str, condition: Column) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, pairs = sent.value
            for batch in batches:
                for first, raw, offs in slices(batch.column("text")):
                    yield function(batch.slice(first, len(offs) - 1), Estimates.of_texts(raw, offs, known.of, pairs.counts))

        return rows.where(condition).mapInArrow(run, schema)

    return each


#: Bytes of text in a chunk; tokens of a batch of looked-up documents that are handled at once.
CHUNK_BYTES, RUN = 12 << 20, 400_000
#: Rows of some MB each: row groups are closed by size, however few rows they hold.
CHUNKS = {"compression": "none", "parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def _chunk_keys(data: bytes) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows without their texts, its tokens, their pair keys and the len+1 offsets of rows."""
    batches, tokens, keys, ends = [], [], [], [np.zeros(1, np.int64)]
    for batch in pa.ipc.open_stream(data):
        batches.append(batch.select(["doc_id", "held_out"]))
        for _, raw, offs in slices(batch.column("text")):
            t, rows = sequences(raw, offs)
            tokens.append(t)
            keys.append(pair_keys(t, rows)[1])
            ends.append(rows[1:] + ends[-1][-1])
    return batches, np.concatenate(tokens), np.concatenate(keys), np.concatenate(ends)


def _by_buckets(rows: DataFrame, model: DataFrame, buckets: int, hashes: int, base: float):
    """The same without a broadcast: a chunk's distinct keys go to their bucket's piece and the answers come back by chunk."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    for batch in held:
                        out.write_batch(batch)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

        for batch in batches:
            for first, _, offs in slices(batch.column("text")):
                held.append(batch.slice(first, len(offs) - 1))
                size += int(offs[-1]) + 16 * (len(offs) - 1)
                if size >= CHUNK_BYTES:
                    yield from done()
                    size = 0
        yield from done()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                _, tokens, keys, _ = _chunk_keys(data.as_py())
                asked: list[dict[int, bytes]] = []
                for some in (np.unique(tokens), np.unique(keys)):
                    asked.append({b: packed(some[at] // U64(buckets)) for b, at in dealt(some, buckets)})
                found = sorted(asked[0].keys() | asked[1].keys())
                cols = [pa.array([chunk] * len(found), pa.int64()), pa.array(found, pa.int64()), *(pa.array([x.get(b) for b in found], pa.binary()) for x in asked)]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "bucket", "words", "pairs"])

    def answer(asked: pa.Table, piece: pa.Table) -> pa.Table:
        have = piece.num_rows and asked.num_rows
        bucket = asked.column("bucket")[0].as_py() if asked.num_rows else 0
        got = {c: piece.column(c)[0].as_py() if have else b"" for c in ("words", "word_counts", "bits")}
        known = WordCounts(np.frombuffer(got["words"], np.uint64), np.frombuffer(got["word_counts"], np.int64))
        pairs = Filter({bucket: got["bits"]} if have else {}, buckets, hashes, base)
        out = {}
        for name, look, pack in (("words", known.of, packed_counts), ("pairs", pairs.levels, np.ndarray.tobytes)):
            keys = [unpacked(x) * U64(buckets) + U64(bucket) if x is not None else np.zeros(0, U64) for x in asked.column(name).to_pylist()]
            ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
            some, which = np.unique(np.concatenate([np.zeros(0, U64), *keys]), return_inverse=True)  # chunks share keys
            out[name] = pa.array([pack(x) for x in np.split(look(some)[which], ends[:-1])] if keys else [], pa.binary())
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), **out})

    def look_up(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for data in chunk.column("data"):  # one
            batches, tokens, keys, ends = _chunk_keys(data.as_py())
            at_bucket = {b: i for i, b in enumerate(answers.column("bucket").to_pylist())}
            looked = []
            for name, every, kind in (("words", tokens, np.int64), ("pairs", keys, np.uint8)):
                some, which = np.unique(every, return_inverse=True)
                found, column = np.zeros(len(some), kind), answers.column(name)
                for b, at in dealt(some, buckets):
                    raw = column[at_bucket[b]].as_py()
                    found[at] = unpacked_counts(raw, len(at)) if name == "words" else np.frombuffer(raw, np.uint8)
                looked.append(found[which])
            wide = int(looked[0].max(initial=0)) >= 1 << 32
            counts = looked[0].astype("<i8" if wide else "<u4")
            columns = [[x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (counts, looked[1])]
            ids = pa.Table.from_batches(batches)
            out.append(pa.table({"doc_id": ids.column("doc_id"), "held_out": ids.column("held_out"), "counts": pa.array(columns[0], pa.binary()), "levels": pa.array(columns[1], pa.binary())}))
        return pa.concat_tables(out) if out else pa.table([[]] * 4, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("counts", pa.binary()), ("levels", pa.binary())]))

    with tidy(spark):
        texts = materialize(rows.mapInArrow(chunks, "data binary").withColumn("chunk", F.monotonically_increasing_id()), **CHUNKS)  # ids fixed by being written
        n = max(parts, texts.count() // 8)  # partitions of about 100 MB of text
        asked = texts.mapInArrow(ask, "chunk long, bucket long, words binary, pairs binary").repartition(n, "bucket")
        pieces = model.select("bucket", "words", "word_counts", "bits").repartition(n, "bucket")
        answers = asked.groupBy("bucket").cogroup(pieces.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket long, words binary, pairs binary")
        answers = materialize(answers, compression="zstd")
        release(model)
        both = texts.repartition(n, "chunk").groupBy("chunk").cogroup(answers.repartition(n, "chunk").groupBy("chunk"))
        looked = materialize(both.applyInArrow(look_up, "doc_id long, held_out boolean, counts binary, levels binary"), compression="zstd")
        release(texts, answers)

    def each(function, schema: str, condition: Column) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.array([len(x) for x in batch.column("levels").to_pylist()], np.int64)
                ends = np.append(0, np.cumsum(lengths))
                first = 0
                while first < batch.num_rows:
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + RUN, "right")) - 1)
                    part = batch.slice(first, last - first)
                    counts = [np.frombuffer(x, "<u4" if len(x) == 4 * n else "<i8").astype(np.int64) for x, n in zip(part.column("counts").to_pylist(), lengths[first:last], strict=True)]
                    both = Filter.least(np.frombuffer(b"".join(part.column("levels").to_pylist()), np.uint8), base)
                    yield function(part, Estimates(np.concatenate(counts), ends[first : last + 1] - ends[first], both.__getitem__))
                    first = last

        return looked.where(condition).mapInArrow(run, schema)

    return each
