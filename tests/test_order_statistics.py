"""Ranks, running sums and quantiles in ranges, and running ranks, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import windows as w
from sigloom.operators import order_statistics as order


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n).round(2))  # a third of the rows tie
    df = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.9, 0.09, 0.01]), "g": rng.integers(0, 2, n), "x": x})
    df.loc[::17, "x"] = np.nan
    return df


def frame(spark, df):
    return spark.createDataFrame([(r.k, r.g, None if np.isnan(r.x) else r.x) for r in df.itertuples()], "k string, g int, x double").repartition(5)


def test_ranks_in_ranges(spark, values):
    got = order.ranked_in_ranges(frame(spark, values), {"r": "x"}, "k", "g").toPandas()
    want = values.assign(r=values.groupby(["k", "g"])["x"].rank())
    key = ["k", "g", "x", "r"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want[key].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_no_task_ranks_a_whole_key(spark, values):
    plan = order.ranked_in_ranges(frame(spark, values), {"r": "x"}, "k")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line]
    assert windows and all("_range" in line for line in windows)


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("bracket", [2e-4, 0.2])
def test_quantiles(spark, values, small, bracket, monkeypatch):
    monkeypatch.setattr(order, "SMALL_ROWS", small)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in order.exact_quantiles(frame(spark, values), "x", probs, "k", bracket=bracket).collect()}
    for k, g in values.groupby("k"):
        np.testing.assert_allclose(got[k], np.nanquantile(g["x"], probs), rtol=1e-12, atol=1e-12)
    whole = order.exact_quantiles(frame(spark, values), "x", probs, bracket=bracket).collect()
    np.testing.assert_allclose(whole[0]["q"], np.nanquantile(values["x"], probs), atol=1e-12)


def test_quantiles_widen_a_bracket_that_misses(spark, values, monkeypatch):
    """Even if the sketch gives nonsense, the result is right."""
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.lit(5.0)] * len(p)))
    got = order.exact_quantiles(frame(spark, values), "x", [0.3, 0.5]).collect()
    np.testing.assert_allclose(got[0]["q"], np.nanquantile(values["x"], [0.3, 0.5]), atol=1e-12)


def test_quantiles_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert order.exact_quantiles(none, "x", [0.5]).collect() == [] and order.exact_quantiles(none, "x", [0.5], "k").collect() == []
    assert order.exact_quantiles(spark.createDataFrame([("a", None)], "k string, x double"), "x", [0.5], "k").collect() == []


def test_running_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 64, 501):
        x = rng.integers(0, 20, n).astype(float)
        below, same = w.so_far(x)
        assert below.tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)] and same.tolist() == [int((x[:i] == x[i]).sum()) for i in range(n)]


def test_expanding_rank_skips_missing_values(spark):
    rows = [("t", i, v) for i, v in enumerate([3.0, None, 1.0, 3.0, 2.0, None, 9.0])]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    got = [r["p"] for r in w.expanding_pct_rank(df, {"p": ("x", 2)}).orderBy("date").collect()]
    want = pd.Series([r[2] for r in rows]).expanding(min_periods=2).rank(pct=True) * 100
    assert [None if g is None else round(g, 9) for g in got] == [None if np.isnan(v) or rows[i][2] is None else round(v, 9) for i, v in enumerate(want)]


def test_rows_in_a_window_carry_no_lists(spark, values):
    """What a key's other ranges hold is added after the window, whose sort would otherwise hold the list once per row."""
    df = frame(spark, values)
    counts = df.where("x is not null").groupBy("k", "x").agg(F.count("*").alias("n"))
    for out in (order.cumulated_in_ranges(counts, "x", ["n"], "k"), order.ranked_in_ranges(df, {"r": "x"}, "k")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "Window" in plan and "filter(" not in plan.split("Window", 1)[1]


def test_rows_of_one_value_are_dealt_over_tasks(spark):
    """A value that most rows have, and rows without one, have one rank each and need no common task."""
    df = spark.range(0, 4000, numPartitions=8).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).when(F.col("id") % 10 < 8, 0.5).alias("x"))
    out = order.ranked_in_ranges(df, {"r": "x"})
    want = df.toPandas()["x"].rank().sort_values().to_numpy()
    np.testing.assert_array_equal(out.toPandas()["r"].sort_values().to_numpy(), want)
    rows = order._in_ranges(df, order._edges(df, "x", (), 64), "x", (), 64)
    assert rows.where("x = 0.5 and not _many").isEmpty()


def test_rank_of_predictions_sorts_no_split_in_one_task(spark, sf_dir):
    from sigloom import registry

    plan = registry.queries()["evaluate_predictions"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line]
    assert windows and not any("[split#" in line for line in windows)


def test_panel_and_labels_are_exchanged_by_ticker_and_by_date_alone(spark, sf_dir):
    from sigloom.plans.diagnosis import wide

    plan = wide(spark, sf_dir).select("excess_fwd", "momentum__a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 3  # lines, suppliers, labels


@pytest.mark.parametrize("name", ["permutation_importance", "gate_univariate_ic"])
def test_panel_is_not_made_again(spark, sf_dir, name):
    """Fits, scores and ranks read a written table."""
    from sigloom import registry

    assert not any("lineitem" in f for f in registry.queries()[name](spark, sf_dir).inputFiles())


def test_ordered_pass_takes_many_series_at_once(spark, monkeypatch):
    """Series that begin and end anywhere in batches, one of them longer than what is taken together."""
    monkeypatch.setattr(w, "HELD", 64)
    rng = np.random.default_rng(3)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for k in [None, *range(40)] for i in range(300 if k == 7 else int(rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "ticker int, date int, x double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = w.in_order(df, {"e": ("x", 2 / 21), "f": (("x", "e"), 0.2)}, {"p": ("x", 3)}).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for _, part in got.groupby("ticker", dropna=False):
        part = part.sort_values("date")
        mean = lambda v, alpha: v.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        rank = part["x"].expanding(3).rank(pct=True) * 100
        np.testing.assert_array_equal(part["e"], mean(part["x"], 2 / 21))
        np.testing.assert_array_equal(part["f"], mean(part["x"] - part["e"], 0.2))
        np.testing.assert_allclose(part["p"], rank.where(part["x"].notna()), rtol=1e-12)


def test_features_are_exchanged_once_by_date(spark, sf_dir):
    """The cross sections share an exchange, and windows per ticker have one before the passes in Python and one after."""
    from sigloom.plans.features import QUERIES

    plan = QUERIES["build_features"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning(date" in line for line in plan) == 1
    assert sum("Exchange hashpartitioning(ticker" in line for line in plan) == 2  # of the lines and after the passes
    assert sum("Exchange hashpartitioning(_part" in line for line in plan) == 2


def test_features_with_statements_take_many_series_at_once(spark, sf_dir):
    """Both passes in Python go by groups of tickers, not by ticker."""
    from sigloom.plans.features import QUERIES

    plan = QUERIES["build_features_with_statements"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("FlatMapGroupsInPandas [_part" in line for line in plan) == 2


def test_features_with_statements_add_up_no_long_windows(spark, sf_dir):
    """The mean of 200 rows is made in a pass in Python, where a row does not go over its 200 one by one."""
    from sigloom.plans.features import QUERIES

    plan = QUERIES["build_features_with_statements"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "-199, currentrow" not in plan
    assert plan.count("Sort [_part") == 2 and "[_part" not in "".join(line for line in plan.splitlines() if "Window [" in line)


def test_means_in_order_equal_those_of_windows(spark, monkeypatch):
    """To the bit, with values that are missing, NaN, infinite or zero, and series shorter and longer than the frame."""
    monkeypatch.setattr(w, "HELD", 64)
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), 0.0]
    value = lambda k: odd[int(rng.integers(0, 4))] if k == 3 and rng.random() < 0.05 else None if rng.random() < 0.1 else float(rng.normal())
    rows = [(k, i, value(k)) for k in [None, *range(12)] for i in range(200 if k in (3, 7) else int(rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "ticker int, date int, x double").repartition(3)
    want = df.withColumns({"m": w.mean("x", 20, 5), "all": w.mean("x", 500, 1)}).toPandas()
    got = w.in_order(df, {}, {}, means={"m": ("x", 20, 5), "all": ("x", 500, 1)}, used=("x",)).toPandas()
    assert list(got.columns) == ["ticker", "date", "m", "all"]
    want, got = (t.sort_values(["ticker", "date"]).reset_index(drop=True) for t in (want, got))
    for c in ("m", "all"):
        np.testing.assert_array_equal(got[c], want[c])


def test_statements_are_exchanged_once_by_date_and_sector(spark, sf_dir):
    """Windows over a ticker's statements come before all cross sections."""
    from sigloom.plans.features import QUERIES

    plan = QUERIES["build_features_with_statements"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning(date" in line for line in plan) == 1


def test_sums_in_ranges_do_not_write_out_the_search(spark):
    """The join of the ranges' sums brings no test of the range below the window, where the search would stand in full."""
    from sigloom.operators.order_statistics import cumulated_in_ranges

    df = spark.createDataFrame([("a" if i % 2 else "b", float(i) if i % 50 else None, 1) for i in range(400)], "k string, x double, n long")
    out = cumulated_in_ranges(df, "x", ["n"], "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("CASE WHEN") for line in plan.splitlines()) == 1
    rows = sorted((r["k"], r["x"], r["n_before"]) for r in out.collect())
    want = [(k, x, i) for k in "ab" for i, x in enumerate(float(i) for i in range(400) if i % 50 and ("a" if i % 2 else "b") == k)]
    assert rows == want


def _written_out(df):
    return max(line.count("CASE WHEN") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Filter" in line)


def test_drift_and_auc_do_not_write_out_the_search(spark):
    """feature_drift and the AUC among the readiness checks rest on the same sums in ranges."""
    from sigloom.operators.diagnostics import feature_drift
    from sigloom.operators.metrics import cumulated

    df = spark.createDataFrame([("a" if i % 2 else "b", float(i * 7 % 390), i % 3 % 2, 1) for i in range(400)], "feature string, value double, side int, n long")
    assert _written_out(feature_drift(df)) <= 1
    one = df.groupBy("value").agg(F.sum("n").alias("n"))
    assert _written_out(cumulated(one, "value", ["n"])) <= 1
