"""Embedding near-dedup over a robust-pruned flat graph.

1. Exact copies of a vector (same label) become one node with a weight.
2. Pivots come from spherical k-means per label over a bounded sample of rows. A node goes to its nearest pivot's shard
   (home) and to every shard whose border it may reach within the similarity bound, so shards overlap. Shards above
   max_rows are cut into blocks by hash and every pair of blocks is a shard of its own.
3. A task per shard picks each node's neighbours by robust pruning; the adjacency lists of all shards are united.
4. A task per shard searches the united graph for each home node: greedy search from the medoid and from the node,
   then range expansion: whatever lies within the bound opens its own neighbours until nothing new is within it.
5. Each link found is verified by its cosine in double precision. Tasks return link counts and, for components, a
   forest of their links, never all pairs; components are joined across tasks.

recall() compares with brute force for the rows whose id is divisible by 50.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link
with nothing; vectors of different length don't link; linkable rows of one id are told apart when counted, whatever their
vectors, but share a component; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidy
from .components import components
from .vectors import clean, matrix, unit, usable

ADJACENT = "node long, neighbours array<long>"
LINKS = "node long, others long, root long"


def pivots(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    count = min(count, len(sample))
    centre = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        home = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, home, sample)
        used = np.linalg.norm(sums, axis=1) > 1e-9
        centre[used] = sums[used] / np.linalg.norm(sums[used], axis=1, keepdims=True)
    return centre


def shards_of(x: np.ndarray, centre: np.ndarray, threshold: float, spread: float = 3.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home shard of each unit vector and all shards it may reach: those whose border is at most `spread` standard
    deviations of a random step of the linked distance away."""
    sims = x @ centre.T
    home = np.argmax(sims, axis=1)
    gaps = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))
    step = math.sqrt(2 - 2 * threshold) * min(1.0, spread / math.sqrt(x.shape[1]))
    near = sims.max(axis=1, keepdims=True) - sims <= step * gaps[home]
    near[np.arange(len(x)), home] = True
    return home, [np.flatnonzero(r) for r in near]


def robust_prune(x: np.ndarray, degree: int = 24, nearest: int = 48, alpha: float = 1.2, spread: int = 512) -> np.ndarray:
    """Neighbour lists (-1 where unused): of the nearest rows and of some at growing ranks, keep those that no kept
    neighbour is closer to by the factor alpha. The growing ranks are those among `spread` rows at equal steps, so that a
    row's others are parted at the nearest but never sorted. Single precision, as lists steer the search alone."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    x = x.astype(np.float32)
    k = min(nearest, n - 1)
    steps = np.unique(np.linspace(0, n - 1, min(spread, n)).astype(int))
    ranks = np.unique(np.geomspace(1, max(1, len(steps) - 2), 16).astype(int) - 1)
    out = np.full((n, min(degree, k + len(ranks))), -1)
    size = max(16, min(256, (4 << 20) // n))
    for at in range(0, n, size):
        rows = np.arange(at, min(n, at + size))
        every = np.arange(len(rows))
        sims = x[rows] @ x.T
        sims[every, rows] = -np.inf
        far = steps[np.argsort(-sims[:, steps], axis=1, kind="stable")[:, ranks]]
        pool = np.concatenate([np.argpartition(sims, n - k, axis=1)[:, n - k :], far], axis=1)
        near = np.take_along_axis(sims, pool, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = np.take_along_axis(pool, order, axis=1), np.take_along_axis(near, order, axis=1)
        dist = np.sqrt(np.maximum(2 - 2 * near, 0))
        between = np.sqrt(np.maximum(2 - 2 * (x[pool] @ x[pool].transpose(0, 2, 1)), 0))
        alive = pool != rows[:, None]
        for d in range(out.shape[1]):
            pick = np.argmax(alive, axis=1)  # the pool is in ascending distance
            some = alive[every, pick]
            if not some.any():
                break
            chosen = pool[every, pick]
            out[rows[some], d] = chosen[some]
            alive &= alpha * between[every, pick] > dist
            alive &= pool != chosen[:, None]
    return out


def range_search(x: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, asked: np.ndarray, threshold: float, width: int = 24) -> list[np.ndarray]:
    """For each asked row the other rows found with cosine >= threshold."""
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    found = []
    for row in asked.tolist():
        q = x[row]
        seen = np.zeros(len(x), dtype=bool)
        pool = np.unique([medoid, row])
        seen[pool] = True
        sims = x[pool] @ q
        opened = np.zeros(len(pool), dtype=bool)
        while True:
            # All rows within the bound are opened, and the best `width` until they all are.
            order = np.argsort(-sims, kind="stable")
            pool, sims, opened = pool[order], sims[order], opened[order]
            todo = (sims >= threshold) & ~opened
            if not todo.any():
                todo[:width] = ~opened[:width]
                todo[np.flatnonzero(todo)[4:]] = False
            if not todo.any():
                break
            opened |= todo
            new = np.unique(np.concatenate([lists[i] for i in pool[todo]]))
            new = new[~seen[new]]
            seen[new] = True
            near = x[new] @ q
            keep = (sims >= threshold) | (np.arange(len(pool)) < width)
            pool, sims, opened = np.concatenate([pool[keep], new]), np.concatenate([sims[keep], near]), np.concatenate([opened[keep], np.zeros(len(new), dtype=bool)])
        found.append(pool[(sims >= threshold) & (pool != row)])
    return found


def forest(n: int, asked: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """The least row of each row's component, the asked rows being linked with what they found."""
    hits = dict(zip(asked.tolist(), found, strict=True))
    label, joined = np.full(n, -1), {}

    def top(i: int) -> int:
        while joined.get(i, i) != i:
            i = joined[i]
        return i

    for start in hits:
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            near = hits.get(todo.pop(), np.zeros(0, np.int64))
            met = label[near]
            for other in np.unique(met[(met >= 0) & (met != start)]).tolist():
                a, b = sorted((top(start), top(other)))
                joined[b] = a
            new = near[met < 0]
            label[new] = start
            todo += new.tolist()
    label = np.where(label < 0, np.arange(n), label)
    labels, which = np.unique(label, return_inverse=True)
    tops = np.array([top(i) for i in labels.tolist()])[which]
    least = np.full(n, n)
    np.minimum.at(least, tops, np.arange(n))
    return least[tops]


def links(vectors: DataFrame, threshold: float = 0.93, max_rows: int = 49_152, shard_rows: int = 16_384, sample_rows: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Shards overlap the more the more there are of a label, up to several times in 64 dimensions, so they are as large as a
    task can hold: max_rows and shard_rows are for 64 components, fewer for longer vectors.
    """
    with tidy(vectors.sparkSession):
        return _links(vectors, threshold, max_rows, shard_rows, sample_rows)


def _links(vectors: DataFrame, threshold: float, max_rows: int, shard_rows: int, sample_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label").withColumn("fit", usable() & F.col("label").isNotNull())
    good = clean(rows.where("fit")).withColumn("digest", F.md5(F.array_join(F.transform("embedding", lambda v: F.hex(v.cast("string").cast("binary"))), ",")))
    alike = good.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    nodes = materialize(alike.withColumn("node", F.monotonically_increasing_id()))  # fixed by being written

    counts = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()  # one row per label
    total = sum(r["n"] for r in counts)
    share = min(1.0, sample_rows / max(total, 1))
    chosen = nodes.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_003)) <= int(share * 1_000_003)).select("label", "dim", "embedding").limit(2 * sample_rows).toPandas()
    centres: dict = {}
    wanted = {(r["label"], r["dim"]): math.ceil(r["n"] * max(r["dim"], 64) / 64 / shard_rows) for r in counts}
    for key, part in chosen.groupby(["label", "dim"], sort=True):
        centres[key] = pivots(unit(matrix(part["embedding"])), min(wanted[key], 256, max(1, len(part) // 8)))
    sent = spark.sparkContext.broadcast(centres)  # at most sample_rows / 8 pivots

    def assign(batches):
        for df in batches:
            out = []
            for key, part in df.groupby(["label", "dim"], sort=True):
                x = unit(matrix(part["embedding"]))
                centre = sent.value.get(key)
                home, reach = shards_of(x, centre, threshold) if centre is not None else (np.zeros(len(x), int), [np.zeros(1, int)] * len(x))
                out.append(pd.DataFrame({"label": key[0], "dim": key[1], "node": part["node"], "weight": part["weight"], "embedding": list(x), "home": home, "shard": reach}))
            if out:
                yield pd.concat(out)

    spread = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node")
    kind = nodes.schema["label"].dataType.simpleString()
    placed = spread.mapInPandas(assign, f"label {kind}, dim int, node long, weight long, embedding array<double>, home int, shard array<int>")
    placed = materialize(placed.withColumn("shard", F.explode("shard")))

    # A shard above max_rows becomes blocks; each pair of blocks is searched on its own.
    sizes = placed.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(64)) / (64 * max_rows)).cast("int").alias("blocks"))
    members = placed.join(F.broadcast(sizes), ["label", "dim", "shard"])  # one row per pivot
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    group = ["label", "dim", "shard", "low", "high"]
    n_groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2000))
    members = members.select(*group, "block", "node", "weight", "home", "embedding").repartition(n_groups, *group)

    def build(df: pd.DataFrame) -> pd.DataFrame:
        ids, x = df["node"].to_numpy(), matrix(df["embedding"])
        lists = robust_prune(x)
        return pd.DataFrame({"node": ids, "neighbours": [ids[r[r >= 0]] for r in lists]})

    united = members.groupBy(*group).applyInPandas(build, ADJACENT)
    united = materialize(united.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")))  # a node is in few shards
    equipped = members.join(united, "node").repartition(n_groups, *group)

    def search(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node", kind="stable").reset_index(drop=True)
        ids, x, weight = df["node"].to_numpy(), matrix(df["embedding"]), df["weight"].to_numpy()
        low, high, shard = int(df["low"].iloc[0]), int(df["high"].iloc[0]), int(df["shard"].iloc[0])
        lengths = df["neighbours"].map(len).to_numpy()
        flat = np.concatenate(df["neighbours"].tolist())
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        rows = np.repeat(np.arange(len(ids)), lengths)[here]
        both = np.unique(np.concatenate([rows * len(ids) + at[here], at[here] * len(ids) + rows]))  # edges serve both ways
        lists = np.split(both % len(ids), np.searchsorted(both // len(ids), np.arange(1, len(ids))))
        asked = np.flatnonzero(df["home"].to_numpy() == shard)
        found = range_search(x, lists, ids, asked, threshold)
        block = df["block"].to_numpy()
        others = np.zeros(len(ids), np.int64)
        for row, hit in zip(asked.tolist(), found, strict=True):
            others[row] = weight[hit if low == high else hit[block[hit] != block[row]]].sum()
        return pd.DataFrame({"node": ids, "others": others, "root": ids[forest(len(ids), asked, found)]})

    found = materialize(equipped.groupBy(*group).applyInPandas(search, LINKS))
    release(placed, united)
    held = materialize(good.select("vec_id", "label", "dim", "digest").join(nodes.select("label", "dim", "digest", "node"), ["label", "dim", "digest"]).select("vec_id", "node"))
    pairs = held.distinct()
    repeated = pairs.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last")  # ids of several vectors
    same_id = pairs.join(repeated, "vec_id").select(F.col("node").alias("a"), "b")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same_id))
    linked = found.groupBy("node").agg(F.sum("others").alias("others"))
    of_node = nodes.select("node", "least", "weight").join(linked, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    of_node = materialize(of_node.select("node", "least", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    named = of_node.groupBy("component").agg(F.min("least").alias("component_id"))

    out = held.join(of_node, "node").join(named, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, every: int = 50) -> float:
    """Share of the links of the rows with id divisible by `every` that the result counts, by brute force in blocks."""
    good = clean(vectors.where(F.col("label").isNotNull()).select("vec_id", "embedding", "label"))
    asked = good.where(F.col("vec_id") % every == 0).toPandas()
    groups = {k: (g["vec_id"].to_numpy(), unit(matrix(g["embedding"]))) for k, g in asked.groupby(["label", "dim"])}

    def count(batches):
        for df in batches:
            for key, part in df.groupby(["label", "dim"]):
                if key in groups:
                    ids, q = groups[key]
                    own = part["vec_id"].to_numpy()
                    hit = (q @ unit(matrix(part["embedding"])).T >= threshold) & (ids[:, None] != own)
                    yield pd.DataFrame({"vec_id": ids, "true_links": hit.sum(axis=1)})

    true = good.mapInPandas(count, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    got = true.join(result, "vec_id").agg(F.sum(F.least("true_links", "n_links")).alias("got"), F.sum("true_links").alias("all")).first()
    return got["got"] / got["all"] if got["all"] else 1.0
