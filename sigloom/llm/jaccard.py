"""N-gram Jaccard join: documents whose sets of k-word shingles have at least a given Jaccard similarity.

Two sets of sizes a and b reach num/den when their difference d (items in one but not both) is at most
(den - num) / (den + num) * (a + b). The join uses this twice.

Candidates. Sizes are cut into classes so that linked sets are in one class or in neighbouring ones. Per class a set is
dealt by hash into an eighth more parts than a pair may differ in, so that linked sets agree in an eighth of the parts.
Each part with two items or more is a key; documents meet where they share a key (cells.py). Parts with one item or none
are keys only for a set with so many of them that they could be all that a linked pair agrees in; where only one of a
pair is such a set, the other's count shows that they agree in a larger part. Sets of some hundred items or more are
dealt into fewer parts, so that a pair at the very bound has no key in common with a chance below MISS, a closer pair
with a smaller one: less than what 64-bit hashes leave open anyway. A shared passage alone hardly makes documents meet,
since a part is a random sample of a whole set. Components of the meetings are families: every link lies within a family.

Search. The sets of a family of like sizes are written as differences D from the set of its least document, so near
copies become short; in others D is the set itself.
Documents x, y with |Dx| + |Dy| small enough are linked whatever they share; the one with the smallest difference
stands for all of these. Other links need at least T shared items of D, T from both sizes: a T-occurrence search with
DivideSkip. Of a query's inverted lists the longest T - 1 at most are set aside, the short ones are merged, and a
candidate that is met often enough is looked up in the long lists by binary search; it is kept if it reaches its T. A
family is searched by size class, a class with the next larger one; large classes are cut into blocks and each pair of
blocks is searched in a task of its own.

Documents with equal sets are searched once. Tasks return a forest of their links, never all pairs.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; with fewer than k words the whole
sequence is the one shingle; a null or empty text has none and links with nothing; rows with equal ids share a
component, that of all their texts, also across the links of each; very long texts are read whole; a null id takes no part in links and keeps a null component; an empty table gives no rows; other columns are
ignored. Items are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import buckets_for, by_bucket, meet, read_entries
from .common import give_back, lean, materialize, release
from .components import components
from .textbytes import U64, mix, shingle_hashes, slices, word_hashes
from .vector_dedup import forest

#: Entries that a task gathers before it passes them on.
FLUSH = 1_000_000
#: Members up to which their ids are sent to all tasks (16 bytes each); more are joined by a shuffle.
BROADCAST_MEMBERS = 2_000_000
#: Copies of a set from which its rows are joined apart.
HOT_COPIES = 1000


@lru_cache(maxsize=8)
def size_classes(top: int, num: int, den: int) -> np.ndarray:
    """Ascending upper ends of the size classes, up to two classes beyond `top`."""
    ends, low, more = [], 1, 2
    while more:
        high = low * den // num
        ends.append(high)
        more -= high >= top
        low = high + 1
    return np.array(ends)


#: Chance that a linked pair at the very bound shares no key; less than that of one equal 64-bit hash in a few billion pairs.
MISS = 1e-9


@lru_cache(maxsize=4096)
def parts_for(size: int, differ: int) -> tuple[int, bool]:
    """(parts, certain) for sets of `size` items at most that differ in `differ` at most.

    An eighth more parts than that, two at least: the parts of a linked pair that are equal then mostly outnumber those
    with an item or none, and keys_of() sees where they may not. For larger sets fewer, larger parts do: the fewest for
    which a linked pair has no equal part of two items or more with a chance below MISS.
    """
    most = differ + max(2, differ // 7)
    common = size - differ / 2
    for parts in range(2, most):
        each = common / parts
        if parts * math.exp(-differ / parts) * (1 - math.exp(-each) * (1 + each)) > -math.log(MISS):
            return parts, False
    return most, True


def keys_of(items: np.ndarray, num: int, den: int, ends: np.ndarray) -> np.ndarray:
    """The keys of a set (sorted hashes) in its own class and the next."""
    out = []
    own = int(np.searchsorted(ends, len(items)))
    for c in (own, own + 1):
        differ = 2 * int(ends[c]) * (den - num) // (den + num)
        if not differ:
            continue  # only equal sets are linked
        parts, certain = parts_for(int(ends[c]), differ)
        salted = mix(items ^ U64(0x5851F42D4C957F2D * (c + 1) & 0xFFFFFFFFFFFFFFFF))
        part = ((salted >> U64(33)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        sums = np.add.reduceat(mix(salted[order] + U64(1)), first)
        full = part[order][first]
        keys = mix(sums ^ ((full + 1).astype(U64) * U64(0x9FB21C651E98DF25)) ^ U64(c))
        large = np.diff(np.append(first, len(items))) > 1
        if not certain or parts - int(large.sum()) < parts - differ:
            out.append(keys[large])  # of the equal parts of a linked pair one at least is large
            continue
        out.append(keys)
        if parts - len(full) >= parts - differ:
            empty = np.setdiff1d(np.arange(parts), full)
            out.append(mix((empty + 1).astype(U64) ^ U64((c + 1) << 48) ^ U64(0xE7037ED1A0B428DB)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of a batch with a text column."""
    for first, raw, offs in slices(batch.column("text")):
        words, at = word_hashes(raw, offs)
        for i in range(len(offs) - 1):
            yield first + i, np.unique(shingle_hashes(words[at[i] : at[i + 1]], k))


def _meetings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Written table of documents (kind 0: a = id, n, digest) and meetings (kind 1: a, b)."""
    buckets = buckets_for(docs.select("doc_id", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "bucket long, kind int, a long, b long, n long, data binary"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["bucket", "kind", "a", "b", "n", "data"]

    def batch_of(bucket, kind, a, b, n, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((bucket, kind, a, b, n, data), types, strict=True)], names=names)

    def links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return batch_of(a % buckets, np.full(n, 1), a, b, np.zeros(n, np.int64), [None] * n)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not count:
                return
            keys = np.concatenate([h for h, _ in held])
            items = np.repeat(np.array([d for _, d in held], np.int64), [len(h) for h, _ in held])
            held.clear()
            count = 0
            keys, items, a, b = meet(keys, items)
            if len(a):
                yield links_batch(a, b)
            rows = list(by_bucket(keys, items, buckets))
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                n = len(part)
                yield batch_of([r[0] for r in part], [2] * n, [None] * n, [None] * n, [None] * n, [r[1] for r in part])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, items in shingle_sets(batch, k):
                rows.append((ids[i], len(items), hashlib.md5(items.tobytes()).digest() if len(items) else None))
                if len(items) and ids[i] is not None:
                    keys = keys_of(items, num, den, size_classes(1 << max(10, len(items).bit_length()), num, den))
                    held.append((keys, ids[i]))
                    count += len(keys)
                    if count >= FLUSH:
                        yield from flush()
            n = len(rows)
            yield batch_of([(r[0] or 0) % buckets for r in rows], [0] * n, [r[0] for r in rows], [None] * n, [r[1] for r in rows], [r[2] for r in rows])
        yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(entries) > 1:
                _, _, a, b = meet(np.concatenate([e[0] for e in entries]), np.concatenate([e[1] for e in entries]))
                if len(a):
                    yield links_batch(a, b)
            entries.clear()

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            other = np.flatnonzero(kind != 2)
            if len(other):
                yield batch.take(pa.array(other))
            packed = batch.take(pa.array(np.flatnonzero(kind == 2)))
            for bucket, data in zip(packed.column("bucket").to_pylist(), packed.column("data"), strict=True):
                if bucket != current:
                    yield from done()
                    current = bucket
                entries.append(read_entries(data.as_py()))
        yield from done()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(emit), schema)
    met = made.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(join), schema)
    return materialize(met.drop("bucket"))


def divide_skip(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """For each row the linked rows found before it, rows being differences from one common set and the full sizes.

    Rows are searched in ascending order of their need s = f * |D| - size, f = (den + num) / (den - num) scaled to
    integers: rows x, y are linked when 2 * f * shared >= s(x) + s(y).
    """
    f, g = den + num, den - num
    lengths = np.array([len(s) for s in sets], np.int64)
    need = f * lengths - g * sizes
    order = np.argsort(need, kind="stable")
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(sets))
    ranked = need[order]
    none = np.zeros(0, np.int64)
    # Inverted lists over places, ascending; items of a single row need none.
    items = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), lengths[order])
    by_item = np.argsort(items, kind="stable")
    run = np.cumsum(np.diff(items[by_item], prepend=items[by_item][:1]) != 0) if len(items) else np.zeros(0, np.int64)
    counts = np.bincount(run)
    ends = np.cumsum(counts)
    list_of = np.empty(len(items), np.int64)
    list_of[by_item] = run
    several = counts[list_of] > 1 if len(items) else np.zeros(0, dtype=bool)
    begin = np.concatenate([[0], np.cumsum(np.bincount(owner[several], minlength=len(sets)))])
    list_of, owner = list_of[several], owner[by_item]
    for x in range(1, len(sets)):
        row = order[x]
        hits = none
        if ranked[0] + ranked[x] <= 0:
            hits = np.zeros(1, np.int64)  # the row that stands for all that need nothing shared
        mine = list_of[begin[x] : begin[x + 1]]
        least = max(1, -int(-(ranked[0] + ranked[x]) // (2 * f)))
        lists = []
        if len(mine) >= least:
            lists = [owner[a:b] for a, b in zip((ends[mine] - counts[mine]).tolist(), ends[mine].tolist(), strict=True)]
            lists = [r[: np.searchsorted(r, x)] for r in lists]
            lists = sorted((r for r in lists if len(r)), key=len)
        if len(lists) >= least:
            aside = min(least - 1, len(lists) - 1)
            short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
            merged = np.concatenate(short)
            merged.sort(kind="stable")  # merges the ascending runs
            first = np.flatnonzero(np.diff(merged, prepend=-1))
            shared = np.diff(np.append(first, len(merged)))
            rows = merged[first]
            often = shared >= least - aside
            rows, shared = rows[often], shared[often]
            for r in long:
                at = np.minimum(np.searchsorted(r, rows), len(r) - 1)
                shared = shared + (r[at] == rows)
            hits = np.concatenate([hits, rows[2 * f * shared >= ranked[rows] + ranked[x]]])
        found[row] = order[np.unique(hits)]
    return found


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_rows: int = 4096, block_items: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row of (doc_id, text).

    Where ids repeat, each text of such an id is linked under a hash of its own; the components of one id's texts are
    then joined.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return _linked(docs, k, num, den, block_rows, block_items)
    keyed = docs.join(_sendable(repeated.withColumn("again", F.lit(True))), "doc_id", "left")
    node = F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = keyed.select(node.alias("node"), "doc_id", "text", "again")
    linked = _linked(keyed.select(F.col("node").alias("doc_id"), "text"), k, num, den, block_rows, block_items)
    names = materialize(keyed.where("again").select("node", F.col("doc_id").alias("id")).distinct())
    rows = linked.withColumnRenamed("doc_id", "node").join(_sendable(names), "node", "left")
    rows = materialize(rows.select(F.coalesce("id", "node").alias("doc_id"), "n_shingles", "component_id", F.col("id").isNotNull().alias("again")))

    texts = materialize(rows.where("again").select("doc_id", "component_id").distinct())
    least = texts.groupBy("doc_id").agg(F.min("component_id").alias("b"))
    merged = components(texts.join(least, "doc_id").select(F.col("component_id").alias("a"), "b"))
    roots = texts.select("component_id").distinct().join(merged, F.col("component_id") == F.col("id"), "left")
    roots = materialize(roots.select("component_id", F.coalesce("component", "component_id").alias("root")))
    smallest = rows.join(_sendable(roots), "component_id").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    named = materialize(roots.join(smallest, "root").select("component_id", "smallest"))
    out = rows.join(_sendable(named), "component_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("smallest", "component_id").alias("component_id"))


def _sendable(written: DataFrame) -> DataFrame:
    """A written table of two numbers a row, marked for broadcast while it has at most BROADCAST_MEMBERS rows."""
    return F.broadcast(written) if written.count() <= BROADCAST_MEMBERS else written


def _linked(docs: DataFrame, k: int, num: int, den: int, block_rows: int, block_items: int) -> DataFrame:
    """near_duplicates() of rows of which equal ids have equal sets."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _meetings(docs, k, num, den)
    rows = met.where("kind = 0").select(F.col("a").alias("doc_id"), "n", F.col("data").alias("digest"))
    families = components(met.where("kind = 1").select("a", "b"))

    # Equal sets are one member, their least id.
    twins = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = materialize(families.join(twins, F.col("id") == F.col("rep"), "left_semi").select(F.col("id").alias("doc_id"), F.col("component").alias("family")))
    crowded = members.groupBy("family").count().where("count > 1").select("family")
    members = materialize(members.join(crowded, "family", "left_semi"))
    few = members.count() <= BROADCAST_MEMBERS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, family = batch.column("doc_id"), batch.column("family")
            rows = list(shingle_sets(batch, k))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                take = pa.array([i for i, _ in part], pa.int64())
                size = np.array([len(s) for _, s in part], np.int64)
                own = np.searchsorted(size_classes(1 << max(10, int(size.max(initial=1)).bit_length()), num, den), size).astype(np.int32)
                cols = [ids.take(take), family.take(take), pa.array(size), pa.array(own), pa.array(size), pa.array([s.tobytes() for _, s in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "family", "size", "own", "n", "items"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(members) if few else members, "doc_id")
    full = materialize(texts.mapInArrow(lean(sets), "doc_id long, family long, size long, own int, n long, items binary"))
    # In a family of like sizes all sets are written against that of its least member.
    alike = full.groupBy("family").agg(F.min("doc_id").alias("doc_id"), (F.max("own") - F.min("own")).alias("spread")).where("spread <= 2").drop("spread")
    alike = materialize(alike)
    alike = F.broadcast(alike) if alike.count() <= BROADCAST_MEMBERS else alike
    against = full.join(alike, ["family", "doc_id"], "left_semi").select("family", F.col("items").alias("base")).dropDuplicates(["family"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.setxor1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True) for x, y in zip(batch.column("items"), batch.column("base"), strict=True)]
            cols = [*(batch.column(c) for c in ("doc_id", "family", "size", "own")), pa.array([len(d) for d in out], pa.int64()), pa.array([d.tobytes() for d in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "family", "size", "own", "n", "items"])

    tight = full.join(alike.select("family"), "family", "left_semi")
    short = tight.join(against, "family").select(*full.columns, "base").mapInArrow(lean(differences), full.schema)
    short = materialize(short).unionByName(full.join(alike.select("family"), "family", "left_anti"))
    # Linked sets are of one size class or of neighbouring ones: a class of a family is searched with the next larger one.
    classed = short.withColumn("class", F.explode(F.array("own", F.col("own") - 1)))
    scale = classed.groupBy("family", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("items"), F.max(F.col("own") == F.col("class")).alias("any"))
    blocks = F.greatest(F.ceil(F.col("sets") / block_rows), F.ceil(F.col("items") / block_items), F.lit(1)).cast("int")
    scale = materialize(scale.where("any and sets > 1").select("family", "class", blocks.alias("blocks")))
    scale = F.broadcast(scale) if scale.count() <= BROADCAST_MEMBERS else scale
    dealt = classed.join(scale, ["family", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["family", "class", "low", "high"]
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).select(*group, "doc_id", "size", "items")

    def search(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates("doc_id")
        ids = df["doc_id"].to_numpy()
        found = divide_skip([np.frombuffer(b, np.uint64) for b in df["items"]], df["size"].to_numpy(), num, den)
        roots = forest(len(ids), np.arange(len(ids)), found)
        a, b = ids, ids[roots]
        give_back()
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    linked = components(dealt.repartition(parts, *group).groupBy(*group).applyInPandas(search, "a long, b long"))
    # Rows whose set occurs once and is linked with none are their own component and stay out of the join.
    of_set = twins.join(linked, F.col("rep") == F.col("id"), "left").where("copies > 1 or component is not null")
    of_set = materialize(of_set.select("digest", "copies", F.coalesce("component", "rep").alias("component")))
    release(full, members)
    hot = of_set.where(F.col("copies") > HOT_COPIES).select("digest", F.col("component").alias("of_hot"))
    split = hot.count() <= BROADCAST_MEMBERS
    joined = rows.where("digest is not null")
    if split:  # sets with many copies don't go through one task
        joined = joined.join(F.broadcast(hot), "digest", "left")
        of_set = of_set.where(F.col("copies") <= HOT_COPIES)
    else:
        joined = joined.withColumn("of_hot", F.lit(None).cast("long"))
    settled = joined.where("of_hot is not null").select("doc_id", "n", F.col("of_hot").alias("component"))
    other = joined.where("of_hot is null").join(of_set, "digest", "left").select("doc_id", "n", "component")
    empty = rows.where("digest is null").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    out = settled.unionByName(other).unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
