"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(pairs: DataFrame, least_of: DataFrame) -> DataFrame:
    """For each (a, b): b linked to the least id around a."""
    return _joined(pairs, least_of.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))


def _joined(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """The join on a in a stage of its own, behind an exchange of both sides, where Spark can split the pairs of a hub."""
    return pairs.join(least.select((F.col("a") + F.lit(0)).alias("a"), "m"), "a")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """From links (a, b) to (id, component): component is the smallest id reachable, for every id that has a link.

    Each round is a few shuffles of the links that are left; rounds grow with the logarithm of the longest chain.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    written = [now]
    for _ in range(rounds):
        # Large star: every larger neighbour of a is linked to the least neighbour of a.
        two = _both(now)
        large = _to_least(two.where("b > a"), two).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: a and its smaller neighbours are linked to the least of them.
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(large, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct())
        same = now.exceptAll(new).isEmpty() and new.exceptAll(now).isEmpty()
        release(written[-1])
        written.append(new)
        now = new
        if same:
            break
    else:
        raise RuntimeError("components() did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
