"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on a few Gaussian directions (2-stable: a projected squared distance is the true one times a
chi-square variable with as many degrees of freedom as directions). A kd-tree over the projections indexes them: its top
levels, fitted on a bounded sample of rows, cut the space into cells and every row goes to its cell; cells above a size
are cut into blocks by hash; each block keeps the lower levels.

A query takes its projected neighbours in ascending projected distance, verifies each by its true distance, and stops
once the chi-square law says that a vector as near as the k-th found would, with probability `sure`, have been met
already: projected distance squared >= quantile * (k-th distance) squared. It searches its own block first; the k-th
distance found there goes along to the other blocks, of which only those are visited that the same test cannot exclude.
So of the true neighbours about `sure` are found. `verified` tells how many rows had their true distance computed.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
another length than the query's; a query never finds its own row's id; fewer candidates than k give fewer rows; ties go
to the smaller id; rows with equal ids count as one vector id with several rows; an empty table gives no rows; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import materialize, release
from .vectors import clean, matrix

FOUND = "query_id long, vec_id long, score double, verified long"
SENT = "dim int, cell int, block int, part int, asked long, vec_id long, embedding array<double>, reach double"


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


class KdTree:
    """Median splits along the widest side down to leaves of a size; each leaf's rows and box."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.rows: list[np.ndarray] = []
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left and right: a node, or ~leaf
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        wide = np.full(points.shape[1], np.inf)
        todo = [(np.arange(len(points)), -wide, wide, -1, 0)]
        while todo:
            rows, low, high, parent, side = todo.pop()
            part = points[rows]
            spans = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= leaf or spans.max() == 0:
                place = ~len(self.rows)
                self.rows.append(rows)
                boxes.append((low, high))
            else:
                place, axis = len(self.nodes), int(np.argmax(spans))
                order = np.argsort(part[:, axis], kind="stable")
                cut = float(part[order[len(rows) // 2], axis])
                if part[order[0], axis] == cut:  # a row goes right from the cut on, and some must go left
                    cut = float(np.min(part[:, axis][part[:, axis] > cut]))
                self.nodes.append((axis, cut, 0, 0))
                left = part[:, axis] < cut
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = cut
                todo += [(rows[left], low, below, place, 2), (rows[~left], above, high, place, 3)]
            if parent >= 0:
                node = list(self.nodes[parent])
                node[side] = place
                self.nodes[parent] = tuple(node)
        self.low, self.high = (np.array([b[i] for b in boxes]) for i in (0, 1))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose box holds each point."""
        out = np.full(len(points), 0 if self.nodes else -1)
        while (out >= 0).any():
            for node in np.unique(out[out >= 0]).tolist():
                axis, cut, left, right = self.nodes[node]
                here = np.flatnonzero(out == node)
                out[here] = np.where(points[here, axis] < cut, left, right)
        return ~out

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of a projected query to every leaf's box."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        return (gap * gap).sum(axis=1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, n: int, sure: float, seed: int) -> pd.DataFrame:
    """The k nearest rows found for each query; `reach` is the k-th distance that the query brings along, infinite for none."""
    proj = directions(x.shape[1], n, seed)
    px, pq = x @ proj, q @ proj
    tree = KdTree(px)
    quantile = chi_square_quantile(sure, n)
    out_q, out_v, out_d, out_n = [], [], [], []
    for i in range(len(q)):
        near = tree.leaf_distances(pq[i])
        leaves = np.argsort(near, kind="stable")
        best_d, best_v = np.zeros(0), np.zeros(0, np.int64)
        limit, verified, opened = float(reach[i]), 0, 0
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        while True:
            # Rows come in ascending projected distance: those of a leaf once its box is nearer than any row at hand.
            bound = quantile * limit * limit * (1 + 1e-9)
            wanted = far[31] if len(far) > 31 else np.inf
            start = opened
            while opened < len(leaves) and near[leaves[opened]] <= min(wanted, bound) and opened - start < 8:
                opened += 1
            if opened > start:
                more = np.concatenate([tree.rows[j] for j in leaves[start:opened]])
                more = more[ids[more] != query_ids[i]]
                gap = px[more] - pq[i]
                rows, far = np.concatenate([rows, more]), np.concatenate([far, (gap * gap).sum(axis=1)])
                order = np.argsort(far, kind="stable")
                rows, far = rows[order], far[order]
                continue
            take = min(32, int(np.searchsorted(far, bound, "right")))
            if not take:
                break
            diff = x[rows[:take]] - q[i]
            best_d = np.concatenate([best_d, np.sqrt((diff * diff).sum(axis=1))])
            best_v = np.concatenate([best_v, ids[rows[:take]]])
            keep = np.lexsort((best_v, best_d))[:k]
            best_d, best_v = best_d[keep], best_v[keep]
            if len(best_d) == k:
                limit = min(limit, float(best_d[-1]))
            verified += take
            rows, far = rows[take:], far[take:]
        out_q.append(np.full(len(best_v), query_ids[i]))
        out_v.append(best_v)
        out_d.append(best_d)
        out_n.append(np.where(np.arange(len(best_v)) == 0, verified, 0))
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_d), "verified": np.concatenate(out_n)})


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, n_directions: int = 10, sure: float = 0.95, seed: int = 5, block_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 65_536
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found rows, and verified."""
    if n_directions % 2:
        raise ValueError("n_directions must be even")
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = clean(vectors.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")))
    rows = materialize(rows)

    # The top of the tree, a cell per block_rows rows, from a sample; at most a cell per 16 sampled rows.
    total = rows.count()
    share = int(min(1.0, sample_rows / max(total, 1)) * 1_000_003) + 1
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < share).select("dim", "embedding").limit(2 * sample_rows).toPandas()
    tops = {}
    for dim, part in sample.groupby("dim"):
        leaf = max(16, math.ceil(len(part) * block_rows / max(total * len(part) / len(sample), 1)))
        tops[int(dim)] = KdTree(matrix(part["embedding"]) @ directions(int(dim), n_directions, seed), leaf)
    sent = spark.sparkContext.broadcast(tops)

    def place(batches):
        for df in batches:
            cell = np.zeros(len(df), np.int32)
            for dim, at in df.groupby("dim").indices.items():
                if dim in sent.value:
                    cell[at] = sent.value[dim].leaf_of(matrix(df["embedding"].iloc[at]) @ directions(int(dim), n_directions, seed))
            yield df.assign(cell=cell)

    placed = rows.mapInPandas(place, "vec_id long, embedding array<double>, is_query boolean, dim int, cell int")
    placed = materialize(placed)
    release(rows)
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("blocks")).collect()  # a row per cell
    blocks = {(r["dim"], r["cell"]): r["blocks"] for r in cells}
    of_cell = F.broadcast(spark.createDataFrame([(*key, n) for key, n in blocks.items()], "dim int, cell int, blocks int"))
    salted = F.xxhash64("vec_id", F.hash("embedding"))
    index = placed.join(of_cell, ["dim", "cell"]).withColumn("block", F.pmod(salted, F.col("blocks")).cast("int"))
    asked = materialize(index.where("is_query").withColumn("asked", salted))
    key = ["dim", "cell", "block", "part"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "verified": np.zeros(0, np.int64)})
        return search_block(left["vec_id"].to_numpy(), matrix(left["embedding"]), right["vec_id"].to_numpy(), matrix(right["embedding"]), right["reach"].to_numpy(), k, n_directions, sure, seed)

    def searched(queries: DataFrame) -> DataFrame:
        """Each block meets its queries once, or once per query_rows of them."""
        queries = queries.dropDuplicates(["dim", "cell", "block", "asked"])
        parts = queries.groupBy("dim", "cell", "block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
        parts = F.broadcast(parts) if len(blocks) * 2 + total // block_rows < 1_000_000 else parts  # a row per block
        whole = index.select("dim", "cell", "block", "vec_id", "embedding").join(parts, ["dim", "cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = queries.join(parts, ["dim", "cell", "block"]).withColumn("part", F.pmod(F.col("asked"), F.col("parts")).cast("int"))
        left = whole.select(*key, "vec_id", "embedding").groupBy(*key)
        return left.cogroup(dealt.select(*key, "vec_id", "embedding", "reach").groupBy(*key)).applyInPandas(search, FOUND)

    none = F.lit(float("inf"))
    home = materialize(searched(asked.select("dim", "cell", "block", "asked", "vec_id", "embedding", none.alias("reach"))))
    # The least k-th distance that is sure for every row of a query id.
    kth = home.select("query_id", "vec_id", "score").distinct().withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("r") == k).select("query_id", F.col("score").alias("reach"))
    several = asked.groupBy("vec_id").agg(F.countDistinct("asked").alias("rows")).where("rows > 1").select(F.col("vec_id").alias("query_id"))
    kth = kth.join(several, "query_id", "left_anti")

    def spread(batches):
        quantile = chi_square_quantile(sure, n_directions)
        for df in batches:
            out = []
            for dim, part in df.groupby("dim"):
                cells_here = sorted(c for d, c in blocks if d == dim)
                tree = sent.value.get(dim)
                proj = matrix(part["embedding"]) @ directions(int(dim), n_directions, seed)
                for row, p in zip(part.itertuples(), proj, strict=True):
                    near = tree.leaf_distances(p) if tree is not None else np.zeros(1)
                    for c in cells_here:
                        if near[c] <= quantile * row.reach * row.reach * (1 + 1e-9):
                            for b in range(blocks[dim, c]):
                                if (c, b) != (row.cell, row.block):
                                    out.append((dim, c, b, 0, row.asked, row.vec_id, row.embedding, row.reach))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    again = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("dim", "cell", "block", "asked", "vec_id", "embedding", F.coalesce("reach", none).alias("reach"))
    visits = again.repartition(tasks, "asked").mapInPandas(spread, SENT).drop("part")
    found = home.unionByName(searched(materialize(visits))).groupBy("query_id", "vec_id", "score").agg(F.sum("verified").alias("verified"))
    mine = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(mine.orderBy("score", "vec_id"))).withColumn("verified", F.sum("verified").over(mine)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "verified")
