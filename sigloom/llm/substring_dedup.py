"""Substring dedup by content-defined chunks.

A gear hash rolls over the words: it is shifted left and the next word's hash added, so that it depends on the last
CUT_WORDS words alone. The text is cut behind a word whose gear hash is the least of some `window` neighbouring ones, so
that cuts are `window` words apart at most and depend on the words around alone: two documents that share min_words
words cut them at the same places but for the margins, whatever stands before, behind or was inserted elsewhere.

A chunk is the words between two cuts: from a cut to the first cut at least `least` words on, which bars chunks of one or
two words that every document has. Each cut begins a chunk, so chunks overlap and none depends on where the one before
began. With window = min_words // 5 and least = min_words - 3 * window + 1 (4 and 9 for 20 words, chunks of 9 to 12),
every min_words words in a row hold a whole chunk whose ends both holders see. A chunk's digest is a 64-bit hash of its
words; a digest's first document, by id, keeps the chunk; in later documents it goes. Chunks cover shared words but for
window + 1 before and 2 * window - 2 behind at most.

At the ends of a run of such chunks the passage may reach further. The chunks from which an uncovered word can be reached
are collected over all documents; every document that holds one, whether its own run ends there or goes on, gives hashes
of the 1, 2, ... words beside it, and the run grows by the longest that an earlier document has. Runs that have min_words
words or more in the end are removed, with the white space after them. Shorter runs stay, they are phrases and common
lines. So every word of a passage of min_words words that an earlier document has is removed. Passages of different
earlier documents that touch or overlap count as one run.

Hashes travel as one binary per task and bucket; a task sends a hash once, with its least document, however often it
occurs. Which are repeated, and which chunks stand at ends, reaches the tasks as bitmaps of fixed size (bits), whose
false hits an exact join removes; no task and not the driver gets all hashes.

Defined results: null and empty texts stay as they are; a null id counts as the first of all; rows with equal ids are
one document, which never loses text to itself; a text that is repeated entirely becomes empty; other columns are kept,
and those named like the added ones are replaced; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import buckets_for
from .common import lean, materialize, release, word_count
from .textbytes import BASES, U64, mix, slices, span_hashes, word_spans

NULL_ID = -(1 << 63)
BROADCAST_DOCUMENTS = 2_000_000
SIDES = (U64(0x6C62272E07BB0142), U64(0x2545F4914F6CDD1D))  # after and before a chunk
CUT_WORDS = 2  # words that a gear hash depends on
INVERSE = U64(pow(int(BASES[1]), -1, 1 << 64))


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


class Words:
    """The words of a run of rows."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.rows = word_spans(raw, offs)
        self.hashes = span_hashes(raw, self.starts, self.ends)

    def cuts(self, window: int) -> np.ndarray:
        """The words that a cut stands before (the first one behind it), in order."""
        n = len(self.hashes) - CUT_WORDS + 1
        if n < window:
            return np.zeros(0, np.int64)
        gear = np.zeros(n, U64)
        for i in range(CUT_WORDS):
            gear = (gear << U64(64 // CUT_WORDS)) + self.hashes[i : n + i]
        gear |= U64(1)
        lowest = sliding(gear, window, np.minimum)
        row_end = np.repeat(self.rows[1:], np.diff(self.rows))[: len(lowest)]
        lowest[np.arange(len(lowest)) + window + CUT_WORDS - 1 > row_end] = 0  # a window lies in one row
        best = sliding(np.pad(lowest, window - 1), window, np.maximum)
        return np.flatnonzero((gear == best) & (best > 0)) + CUT_WORDS

    def chunks(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, row, digest) of the chunks, in order."""
        cuts = self.cuts(cut_window(min_words))
        to = np.searchsorted(cuts, cuts + least_words(min_words))
        at, end = cuts[to < len(cuts)], cuts[to[to < len(cuts)]]
        row = np.searchsorted(self.rows, at - 1, "right") - 1  # the row of the word before the cut
        inside = end <= self.rows[row + 1]
        at, end, row = at[inside], end[inside], row[inside]
        # The sum of hash * BASE ** place over a chunk, taken back by BASE ** first, is the same wherever it stands.
        n = len(self.hashes)
        powers, inverse = powers_of(BASES[1], n), powers_of(INVERSE, n)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.hashes * powers, dtype=U64)])
        words = end - at
        return at, words, row, mix((sums[end] - sums[at]) * inverse[at] ^ words.astype(U64))

    def beside(self, at: np.ndarray, words: np.ndarray, row: np.ndarray, digests: np.ndarray, before: int, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(steps, which chunks, keys): keys of the 1, 2, ... words beside each chunk, as far as its row goes."""
        which, state = np.arange(len(at)), digests ^ SIDES[before]
        for steps in range(1, margins(min_words)[before] + 1):
            to = at[which] - steps if before else at[which] + words[which] - 1 + steps
            inside = to >= self.rows[row[which]] if before else to < self.rows[row[which] + 1]
            which, state = which[inside], state[inside]
            if not len(which):
                return
            state = (state ^ self.hashes[to[inside]]) * BASES[0]
            state ^= state >> U64(31)
            yield steps, which, mix(state)


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def cut_window(min_words: int) -> int:
    return max(1, min_words // 5)


def least_words(min_words: int) -> int:
    return max(1, min_words - 3 * cut_window(min_words) + 1)


def margins(min_words: int) -> tuple[int, int]:
    """Words of a shared passage that chunks may leave uncovered after and before them, at most."""
    window = cut_window(min_words)
    return 2 * window - 2, window + CUT_WORDS - 1


def end_codes(digests: np.ndarray, before: int) -> np.ndarray:
    return mix(digests ^ SIDES[before])


def at_ends(row: np.ndarray, at: np.ndarray, words: np.ndarray, gone: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks (in order) go and may reach a word after (0) or before (1) their run of chunks that go."""
    after, before = margins(min_words)
    out = np.zeros((2, len(at)), dtype=bool)
    which = np.flatnonzero(gone)
    if len(which):
        r, p, e = row[which], at[which], (at + words)[which]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] > e[:-1])])  # ends ascend as starts do
        run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.append(begin[1:], len(p)) - 1
        out[0, which] = e[last][run] - e < after
        out[1, which] = p - p[begin][run] < before
    return out[0], out[1]


ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("many", "?")])
PACKED = "bucket long, data binary"


def _bucketed(keys: np.ndarray, docs: np.ndarray, many: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    entries = np.empty(len(keys), ENTRY)
    entries["key"], entries["doc"], entries["many"] = keys[order], docs[order], many[order]
    data = [part.tobytes() for part in np.split(entries, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(data, pa.binary())], names=["bucket", "data"])


def _least(keys: np.ndarray, docs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once: its least document and whether it has several."""
    order = np.lexsort((docs, keys))
    keys, docs, many = keys[order], docs[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return keys, docs, many
    several = np.logical_or.reduceat(many, at)
    ends = np.append(at[1:], len(keys)) - 1
    return keys[at], docs[at], several | (docs[ends] != docs[at])


def repeated(keyed: DataFrame, buckets: int) -> DataFrame:
    """Written table (digest, first) of the keys that several documents have; `keyed` comes from packed()."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                e = np.concatenate(held)
                held.clear()
                keys, docs, many = _least(e["key"], e["doc"], e["many"])
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(docs[many])], names=["digest", "first"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if bucket != current:
                    yield from done()
                    current = bucket
                held.append(np.frombuffer(data.as_py(), ENTRY))
        yield from done()

    return materialize(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(join), "digest long, first long"))


def packed(gather, buckets: int, flush: int = 500_000):
    """Turns gather(batch) -> (keys, documents) pairs into a task function that emits packed entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for keys, docs in gather(batch):
                held.append((keys, docs))
                count += len(keys)
                if count >= flush:
                    keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, count = [], 0
                    yield _bucketed(*_least(keys, docs, np.zeros(len(keys), dtype=bool)), buckets)
        if count:
            keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _bucketed(*_least(keys, docs, np.zeros(len(keys), dtype=bool)), buckets)

    return run


def on_bitmap(sent: np.ndarray, digests: np.ndarray, bits: int) -> np.ndarray:
    place = digests.view(np.int64) % bits
    return (sent[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """A bit per digest modulo `bits`, as bytes; at most bits / 64 numbers reach the driver."""
    word, bit = f"cast(pmod(digest, {bits}) div 64 as int)", f"shiftleft(1L, cast(pmod(digest, {bits}) % 64 as int))"
    words = found.groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    rows = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def dedup(docs: DataFrame, min_words: int = 20, bits: int = 1 << 24) -> DataFrame:
    """docs with `text` replaced, and n_words, removed_words and removed (word ranges [start, end)) added."""
    spark = docs.sparkSession
    added = ("n_words", "removed_words", "removed", "_id", "_key")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    texts = docs.select(ident.alias("_id"), F.xxhash64("text").alias("_key"), "text")
    buckets = buckets_for(texts, 16 << 20)

    def gather(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column("_id").to_numpy()
        for first, raw, offs in slices(batch.column("text")):
            _, _, row, digests = Words(raw, offs).chunks(min_words)
            yield digests, ids[first + row]

    first_of = repeated(texts.mapInArrow(lean(packed(gather, buckets)), PACKED), buckets)
    sent = spark.sparkContext.broadcast(bitmap(first_of, bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
            for first, raw, offs in slices(batch.column("text")):
                words = Words(raw, offs)
                at, size, row, digests = words.chunks(min_words)
                on = on_bitmap(sent.value, digests, bits)
                at, size, row, digests = at[on], size[on], row[on], digests[on]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first + row]), pa.array(keys[first + row]), pa.array((at - words.rows[row]).astype(np.int32)),
                        pa.array(size.astype(np.int32)), pa.array(digests.view(np.int64)),
                    ],
                    names=["_id", "_key", "chunk", "words", "digest"],
                )

    found = texts.mapInArrow(lean(hits), "_id long, _key long, chunk int, words int, digest long").join(first_of, "digest")
    # A document's repeated chunks: bounded by its own length.
    marked = found.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("chunk", "words", "first", "digest"))).alias("_marks"))
    fields = {"chunk": "_chunks", "words": "_sizes", "first": "_firsts", "digest": "_digests"}
    marked = materialize(marked.select("_id", "_key", *[F.col(f"_marks.{f}").alias(c) for f, c in fields.items()]))
    held = docs.withColumn("_id", ident).withColumn("_key", F.xxhash64("text"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, size, firsts, digests = marks_of(batch)
            sides = at_ends(row, at, size, firsts < batch.column("_id").to_numpy()[row], min_words)
            codes = np.unique(np.concatenate([end_codes(digests[on], before) for before, on in enumerate(sides)]))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64))], names=["digest"])

    sent_ends = spark.sparkContext.broadcast(bitmap(marked.mapInArrow(lean(ends), "digest long"), bits))

    def edges(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the words beside each chunk that stands at an end of a run in any document."""
        ids = batch.column("_id").to_numpy()
        for first, raw, offs in slices(batch.column("text")):
            words = Words(raw, offs)
            row, at, size, _, digests = marks_of(batch.slice(first, len(offs) - 1))
            for before in (0, 1):
                on = on_bitmap(sent_ends.value, end_codes(digests, before), bits)
                for _, which, keys in words.beside(words.rows[row[on]] + at[on], size[on], row[on], digests[on], before, min_words):
                    yield keys, ids[first + row[on][which]]

    some = _few(marked)
    with_marks = materialize(_only(held.select("_id", "_key", "text"), some).join(marked, ["_id", "_key"]))
    grown = repeated(with_marks.mapInArrow(lean(packed(edges, buckets)), PACKED), buckets)
    sent_grown = spark.sparkContext.broadcast(bitmap(grown, bits))

    def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
            for first, raw, offs in slices(batch.column("text")):
                words = Words(raw, offs)
                row, at, size, firsts, digests = marks_of(batch.slice(first, len(offs) - 1))
                for before, on in enumerate(at_ends(row, at, size, firsts < ids[first + row], min_words)):
                    for n, which, keys in words.beside(words.rows[row[on]] + at[on], size[on], row[on], digests[on], before, min_words):
                        there = on_bitmap(sent_grown.value, keys, bits)
                        of, edge, keys = first + row[on][which[there]], at[on][which[there]] * 2 + before, keys[there]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[of]), pa.array(row_keys[of]), pa.array(edge.astype(np.int32)), pa.array(np.full(len(of), n, np.int32)), pa.array(keys.view(np.int64))],
                            names=["_id", "_key", "edge", "words", "digest"],
                        )

    reach = with_marks.mapInArrow(lean(edge_rows), "_id long, _key long, edge int, words int, digest long").join(grown, "digest").where("first < _id")
    reach = reach.groupBy("_id", "_key", "edge").agg(F.max("words").alias("words"))
    reach = reach.groupBy("_id", "_key").agg(F.collect_list(F.struct("edge", "words")).alias("_edges"))
    reach = reach.select("_id", "_key", F.col("_edges.edge").alias("_edge"), F.col("_edges.words").alias("_reach"))

    decided = marked.drop("_digests").join(reach, ["_id", "_key"], "left").where(F.exists("_firsts", lambda f: f < F.col("_id")))
    decided = materialize(decided)
    release(with_marks, grown)
    names = docs.columns
    at_text = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, removed_words long, removed array<array<int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            marks, sizes, firsts, edge, more = (batch.column(x).to_pylist() for x in ("_chunks", "_sizes", "_firsts", "_edge", "_reach"))
            for first, raw, offs in slices(batch.column("text")):
                c = Words(raw, offs)
                n = len(offs) - 1
                original = batch.column("text").slice(first, n)
                texts_, spans = original.to_pylist(), []
                for r in range(n):
                    i = first + r
                    gone = [(m, w) for m, w, f in zip(marks[i] or (), sizes[i] or (), firsts[i] or (), strict=True) if f < ids[i]]
                    ranges = removed_ranges(gone, dict(zip(edge[i] or (), more[i] or (), strict=True)), min_words)
                    spans.append(ranges)
                    if ranges:
                        parts, at = [], int(offs[r])
                        for a, b in ranges:
                            w = int(c.rows[r])
                            parts.append(raw[at : int(c.starts[w + a])])
                            at = int(c.starts[w + b]) if w + b < c.rows[r + 1] else int(offs[r + 1])
                        parts.append(raw[at : int(offs[r + 1])])
                        texts_[r] = np.concatenate(parts).tobytes().decode("utf-8", "replace")
                cols = [pa.array(texts_, pa.string()) if k == at_text else batch.column(name).slice(first, n) for k, name in enumerate(names)]
                removed = [sum(b - a for a, b in s) for s in spans]
                cols += [pa.array(np.diff(c.rows).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "removed_words", "removed"])

    some = _few(decided)
    changed = _only(held, some).join(decided, ["_id", "_key"]).select(*[F.col(f"`{c}`") for c in names], "_id", "_chunks", "_sizes", "_firsts", "_edge", "_reach")
    same = held.join(some, ["_id", "_key"], "left_anti").select(*[F.col(f"`{c}`") for c in names])
    same = same.withColumns({"n_words": word_count(), "removed_words": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<array<int>>")})
    same = same.withColumn("removed", F.coalesce("removed", F.array().cast("array<array<int>>")))
    return changed.mapInArrow(lean(cut), schema).unionByName(same)


def _few(keyed: DataFrame) -> DataFrame:
    """The documents' keys, marked for broadcast while there are at most BROADCAST_DOCUMENTS (16 bytes each)."""
    keys = keyed.select("_id", "_key")
    return F.broadcast(keys) if keyed.count() <= BROADCAST_DOCUMENTS else keys


def _only(docs: DataFrame, some: DataFrame) -> DataFrame:
    return docs.join(some, ["_id", "_key"], "left_semi")


def marks_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in it, words, first document, digest) of a batch's repeated chunks, in order."""
    lists = [batch.column(x) for x in ("_chunks", "_sizes", "_firsts", "_digests")]
    row = np.repeat(np.arange(len(batch)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    at, size, firsts, digests = (x.flatten().to_numpy() for x in lists)
    return row, at.astype(np.int64), size.astype(np.int64), firsts, digests.view(U64)


def removed_ranges(gone: list[tuple[int, int]], reach: dict[int, int], min_words: int) -> list[list[int]]:
    """Word ranges to remove: runs of chunks an earlier document has, grown at both ends, of min_words or more."""
    out: list[list[int]] = []
    for a, b in sorted((m - reach.get(m * 2 + 1, 0), m + words + reach.get(m * 2, 0)) for m, words in gone):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [x for x in out if x[1] - x[0] >= min_words]
