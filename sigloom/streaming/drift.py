"""Drift of features in a stream against a reference, with running bin counts as keyed state.

A feature's bins are the reference's quantile ranges [a, b). Rows of a micro-batch are counted per bin within their task,
so that a feature's state meets one row per bin and Arrow batch; the state adds them up over all batches and says how far
the stream has moved: PSI, the largest gap of the cumulated shares at a bin's edge (KS on bins), and a severity. An alert
row is given whenever a batch brings a feature rows; `crossed` marks those whose severity rose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.diagnostics import unpivot
from ..operators.order_statistics import exact_quantiles

ALERTS = "feature string, rows long, psi double, ks double, severity string, crossed boolean"
LEVELS = ("none", "medium", "high", "critical")
LEAST = 10
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def binned(long: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin) of each value; edges has one row per feature."""
    rows = long.where(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")
    return rows.select("feature", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin"))


def reference_bins(reference: DataFrame, features: list[str], bins: int = 10) -> tuple[DataFrame, dict[str, list[int]]]:
    """The bins' edges per feature, and how many reference rows each bin holds."""
    long = unpivot(reference, features).where(F.col("value").isNotNull())
    cuts = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], "feature")
    edges = cuts.select("feature", F.array_distinct("q").alias("edges"))
    counts: dict[str, list[int]] = {r["feature"]: [0] * (len(r["edges"]) + 1) for r in edges.collect()}
    for r in binned(long, edges).groupBy("feature", "bin").count().collect():
        counts[r["feature"]][r["bin"]] = r["count"]
    return edges, counts


def distance(reference: list[int], current: list[int]) -> tuple[float, float]:
    """PSI and KS of two rows of bin counts; 0 below LEAST rows on a side."""
    a, b = sum(reference), sum(current)
    if min(a, b) < LEAST:
        return 0.0, 0.0
    psi = ks = x = y = 0.0
    for r, c in zip(reference, current, strict=True):
        p, q = max(r / a, 1e-6), max(c / b, 1e-6)
        if r or c:
            psi += (q - p) * math.log(q / p)
        x, y = x + r / a, y + c / b
        ks = max(ks, abs(x - y))
    return abs(psi), ks


def severity(psi: float, ks: float) -> str:
    return "critical" if ks > 0.4 or psi > 0.5 else "high" if ks > 0.25 or psi > 0.35 else "medium" if ks > 0.15 or psi > 0.2 else "none"


class RunningBins(StatefulProcessor):
    """Bin counts of one feature over the whole stream, and the severity they have reached."""

    def __init__(self, reference: dict[str, list[int]]):
        self.reference = reference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "counts array<long>, severity string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        reference = self.reference[key[0]]
        before = self.seen.get()
        counts, level = ([0] * len(reference), "none") if before is None else (list(before[0]), before[1])
        for part in rows:
            for at, n in zip(part["bin"].tolist(), part["n"].tolist(), strict=True):
                counts[at] += n
        psi, ks = distance(reference, counts)
        now = severity(psi, ks)
        self.seen.update((counts, now))
        crossed = LEVELS.index(now) > LEVELS.index(level)
        yield pd.DataFrame([(key[0], sum(counts), psi, ks, now, crossed)], columns=["feature", "rows", "psi", "ks", "severity", "crossed"])

    def close(self) -> None:
        pass


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.groupby(["feature", "bin"]).size().reset_index(name="n")


def drift_alerts(rows: DataFrame, reference: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """The stream of alert rows for a stream of rows with the features."""
    edges, counts = reference_bins(reference, features, bins)
    known = binned(unpivot(rows, features), edges).mapInPandas(_counted, "feature string, bin int, n long")
    return known.groupBy("feature").transformWithStateInPandas(RunningBins(counts), ALERTS, "Append", "None")


def watch(rows: DataFrame, reference: DataFrame, features: list[str], alerts: str, checkpoint: str, bins: int = 10) -> StreamingQuery:
    """Appends the alerts of what is there to a Parquet folder, then stops. State is kept by RocksDB, for this query alone."""
    spark = rows.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        out = drift_alerts(rows, reference, features, bins).writeStream.format("parquet").outputMode("append")
        return out.option("path", alerts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def latest(alerts: DataFrame) -> DataFrame:
    """Where each feature stands after the last batch that brought it rows, and how often its severity rose."""
    last = F.max_by(F.struct("psi", "ks", "severity"), "rows").alias("_last")
    out = alerts.groupBy("feature").agg(F.max("rows").alias("rows"), last, F.count_if("crossed").alias("rises"))
    return out.select("feature", "rows", "_last.psi", "_last.ks", "_last.severity", "rises")
