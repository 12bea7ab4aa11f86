"""Running drift of a stream against brute-force counts."""

import numpy as np
import pandas as pd

from sigloom.streaming import daily, drift
from sigloom.tables import scratch

SCHEMA = "date date, ticker string, a double, b double"


def rows(seed, n, day, shift):
    rng = np.random.default_rng(seed)
    return [(pd.Timestamp(day).date(), f"t{i}", float(rng.normal() + shift), float(rng.normal()) if i % 10 else None) for i in range(n)]


def test_drift_rises_with_the_batches(spark):
    """Each file is a batch: `a` moves further with each, `b` does not; copies and late rows do not count."""
    reference = rows(0, 2000, "2024-01-01", 0)
    batches = [rows(1, 300, "2024-02-01", 0), rows(2, 300, "2024-02-02", 1), rows(2, 300, "2024-02-02", 1), rows(3, 900, "2024-03-20", 4), rows(4, 300, "2024-01-02", 9)]
    drop, alerts, marks = scratch(spark), scratch(spark), scratch(spark)
    base = spark.createDataFrame(reference, SCHEMA)
    for batch in batches:  # one run each, from the same state
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(drop)
        stream = daily.once_each(spark.readStream.schema(SCHEMA).parquet(drop), "10 days")
        drift.watch(stream, base, ["a", "b"], alerts, marks).awaitTermination()
    got = {r["feature"]: r for r in drift.latest(spark.read.parquet(alerts)).collect()}
    known = batches[0] + batches[1] + batches[3]
    for k, name in ((2, "a"), (3, "b")):
        x, y = [r[k] for r in reference if r[k] is not None], [r[k] for r in known if r[k] is not None]
        edges = np.quantile(x, [i / 10 for i in range(1, 10)])
        p, q = (np.maximum(np.bincount(np.searchsorted(edges, v, "right"), minlength=10) / len(v), 1e-6) for v in (x, y))
        assert got[name]["rows"] == len(y)
        np.testing.assert_allclose([got[name]["psi"], got[name]["ks"]], [abs(((q - p) * np.log(q / p)).sum()), np.abs(np.cumsum(p) - np.cumsum(q)).max()], rtol=1e-9)
    assert got["a"]["severity"] == "critical" and got["a"]["rises"] >= 2 and got["b"]["severity"] == "none" and got["b"]["rises"] == 0


def test_distance_needs_rows_on_both_sides():
    assert drift.distance([5, 4], [100, 1]) == (0.0, 0.0) and drift.distance([50, 50], [100, 0])[1] == 0.5
