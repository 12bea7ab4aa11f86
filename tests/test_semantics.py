"""Window semantics against pandas, and properties: no look-ahead, order of rows, scale of prices."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.functions import windows as w
from sigloom.operators import features, joins, labels, metrics, ml, panel, splits
from sigloom.ship import BATCH, ship
from sigloom.sources import scans


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(4):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))
        for i, c in enumerate(close):
            c = float(c)
            rows.append((f"T{t}", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date(), t % 2, c, c * 1.01, c * 0.99, c, float(rng.integers(100, 1000)), 50.0, 0.2, 0.1))
    cols = "ticker string, date date, sector int, open double, high double, low double, close double, volume double, delivery_qty double, fii_hold double, dii_hold double"
    return spark.createDataFrame(rows, cols).cache()


def test_rolling_and_ewm_match_pandas(bars):
    out = w.ewm(bars.withColumns({"m": w.mean("close", 10), "s": w.std("close", 10), "md": w.median("close", 20, 5)}), {"e": ("close", 2 / 21)}).toPandas().sort_values(["ticker", "date"])
    g = bars.toPandas().sort_values(["ticker", "date"]).groupby("ticker")["close"]
    np.testing.assert_allclose(out["m"], g.rolling(10).mean().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(out["s"], g.rolling(10).std().to_numpy(), rtol=1e-6)
    np.testing.assert_allclose(out["md"], g.rolling(20, min_periods=5).median().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(out["e"], g.transform(lambda x: x.ewm(span=20, adjust=False).mean()).to_numpy(), rtol=1e-9)


def test_ranks_match_pandas(bars):
    df = bars.withColumn("v", F.round("volume", -2)).withColumn("r", w.xs_pct_rank("v", "date")).toPandas()
    np.testing.assert_allclose(df["r"], df.groupby("date")["v"].rank(pct=True), rtol=1e-12)


def test_constant_series_has_no_correlation(bars):
    assert bars.withColumn("one", F.lit(0.1)).agg(w.corr("close", "one").alias("c")).first()["c"] is None


def test_features_do_not_look_ahead(bars):
    cut = "2020-02-20"
    full = features.build_features(bars).where(F.col("date") <= F.lit(cut).cast("date")).toPandas()
    past = features.build_features(bars.where(F.col("date") <= F.lit(cut).cast("date"))).toPandas()
    both = full.merge(past, on=["date", "ticker"], suffixes=("", "_p"))
    assert len(both) == len(full) == len(past)
    for c in [c for c in full.columns if "__" in c]:
        np.testing.assert_allclose(both[c], both[f"{c}_p"], rtol=1e-9, atol=1e-12, err_msg=c)


def test_price_scale_and_row_order_do_not_matter(bars):
    a = features.momentum(bars).toPandas().sort_values(["ticker", "date"])
    b = features.momentum(bars.withColumn("close", F.col("close") * 7).orderBy(F.rand(3))).toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(a["momentum__price_ret_5d"], b["momentum__price_ret_5d"], rtol=1e-9)


def test_features_skip_missing_inputs(bars):
    out = features.build_features(bars.select("date", "ticker", "close"))
    assert any(c.startswith("momentum__") for c in out.columns) and not any(c.startswith("atr__") for c in out.columns)
    bare = features.build_features(bars, blocks=())
    assert any(c.startswith("baseline__") for c in bare.columns)


def test_triple_barrier(spark):
    prices = [100, 101, 105, 90, 100, 97, 110, 100, 100, 100]
    df = spark.createDataFrame([("A", pd.Timestamp(2020, 1, i + 1).date(), float(p)) for i, p in enumerate(prices)], "ticker string, date date, close double")
    got = [r["label"] for r in labels.label_triple_barrier(df, horizon=3).orderBy("date").collect()]
    assert got == [1, 0, 0, 1, 0, 1, 0, None, None, None] or got[0] == 1 and got[-3:] == [None] * 3


def test_asof_takes_the_last_known_row(spark):
    left = spark.createDataFrame([("a", "2020-01-05"), ("a", "2020-02-01"), ("b", "2020-01-01")], "k string, d string").withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-05", 2.0), ("a", "2020-03-01", 3.0)], "k string, at string, v double").withColumn("at", F.col("at").cast("date"))
    got = {(r["k"], str(r["d"])): r["v"] for r in joins.asof(left, right, "k", "d", "at", ["v"]).collect()}
    assert got == {("a", "2020-01-05"): 2.0, ("a", "2020-02-01"): 2.0, ("b", "2020-01-01"): None}


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(500), 2), rng.integers(0, 2, 500)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "proba double, label int")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(want)


def test_errors(spark, bars):
    with pytest.raises(ValueError):
        panel.coerce_schema(bars, {"nope": "double"})
    with pytest.raises(ValueError):
        panel.coerce_schema(bars.withColumn("close", F.lit("x")), {"close": "double"})
    with pytest.raises(ValueError):
        panel.assert_panel(bars.withColumn("close", -F.col("close")), 2, 0.1)
    with pytest.raises(ValueError):
        splits.require_splits(splits.split_time(bars, "2030-01-01", "2031-01-01"), "train", "test")


def test_linear_attribution_sums_to_the_score(bars):
    df = bars.select("date", "ticker", "close", "volume")
    out = ml.attribute_linear(df, {"close": 0.5, "volume": -0.1}).toPandas()
    c, v = out["close"] - out["close"].mean(), out["volume"] - out["volume"].mean()
    total = out["top_features"].map(lambda xs: sum(x["contribution"] for x in xs))
    np.testing.assert_allclose(total, 0.5 * c - 0.1 * v, rtol=1e-6, atol=1e-9)


def test_fundamentals_from_a_page(spark):
    html = "<table><tr><th>Sales +</th><td>1,200</td><td>1,500</td></tr><tr><th>Net Profit</th><td>100</td><td>-20</td></tr></table><ul><li><span>Market Cap</span><span>₹ 3 Cr.</span></li></ul>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    got = {(r["page_id"], r["at"]): (r["revenue"], r["net_income"], r["market_cap"]) for r in scans.fundamentals_of_pages(df).collect()}
    assert got == {(1, 0): (1200.0, 100.0, 3e7), (1, 1): (1500.0, -20.0, None)}


def test_rank_per_date_without_a_cap(spark):
    from sigloom.operators import metrics

    df = spark.createDataFrame([(d, f"t{i}", ((i * 7) % 10) / 10) for d in (1, 2) for i in range(10)], "date int, ticker string, proba double")
    got = {(r["date"], r["ticker"]): r["rank"] for r in metrics.topk_per_date(df, None).collect()}
    assert got == {(d, f"t{i}"): 10 - (i * 7) % 10 for d in (1, 2) for i in range(10)}


def test_build_features_makes_two_python_passes(spark, sf_dir):
    from sigloom.operators.features import build_features
    from sigloom.plans.fixtures import panel

    plan = build_features(panel(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2


def test_csv_per_ticker_reads_the_name_of_the_file(spark, tmp_path):
    from sigloom.sources import scans

    (tmp_path / "acme.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-01-03,bad,2,1,1.5,\n")
    (tmp_path / "xyz.csv").write_text("date,open,high,low,close,volume\n2020-01-02,3,3,3,3,7\n")
    got = {(r["ticker"], str(r["date"]), r["open"], r["volume"]) for r in scans.csv_per_ticker(spark, f"file://{tmp_path}").collect()}
    assert got == {("ACME", "2020-01-02", 1.0, 100.0), ("ACME", "2020-01-03", None, None), ("XYZ", "2020-01-02", 3.0, 7.0)}


def test_selection_finds_the_feature_that_counts(spark):
    from sigloom.operators import selection

    rng = np.random.default_rng(3)
    n = 1200
    good, noise = rng.normal(size=n), rng.normal(size=n)
    gain = good + 0.3 * rng.normal(size=n)
    rows = [(d.date(), i % 20, float(good[i]), float(noise[i]), float(gain[i]), int(gain[i] > 0)) for i, d in enumerate(np.repeat(pd.date_range("2020-01-01", periods=60), 20))]
    df = spark.createDataFrame(rows, "date date, ticker long, a__good double, b__noise double, excess_fwd double, label int").cache()
    folds = spark.sql("select 1 as fold, date'2020-01-01' as train_start, date'2020-02-01' as train_end, date'2020-02-05' as test_start, date'2020-02-29' as test_end")
    kept = {r["feature"]: r["kept"] for r in selection.oos_ic_filter(df, folds, ["a__good", "b__noise"], least=0.2).collect()}
    assert kept == {"a__good": True, "b__noise": False}
    assert {r["block"]: r["kept"] for r in selection.group_selection(df, folds, ["a__good", "b__noise"], least=0.2).collect()} == {"a": True, "b": False}
    assert [r["removed"] for r in selection.backward_elimination(df, folds, ["a__good", "b__noise"], tolerance=0.05).collect()] == [None, "b__noise"]
    assert selection.gate_incremental(df, folds, ["b__noise"], "a__good").first()["passed"]
    assert not selection.gate_incremental(df, folds, ["a__good"], "b__noise").first()["passed"]
    meta = selection.meta_filter(selection.meta_model(df, ["a__good"], maxIter=3), df)
    assert meta.where("excess_fwd > 0").count() > 0.85 * meta.count()  # the best that the noise allows is 0.91


def test_breakpoints_pairs_and_clusters_of_planted_data(spark):
    from sigloom.operators import diagnostics as dg

    starts = pd.date_range("2020-01-01", periods=8, freq="21D")
    windows = spark.createDataFrame([("f", d.date(), 0.1 if i < 4 else -0.1) for i, d in enumerate(starts)], "feature string, start date, ic double")
    found = {str(r["start"]): (round(r["before"], 6), round(r["after"], 6)) for r in dg.ic_breakpoints(windows).collect()}
    assert found[str(starts[4].date())] == (0.1, -0.1) and str(starts[3].date()) in found
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    pairs = dg.corr_pairs(dg.corr_table(df, ["a", "b", "c"]), 0.8).collect()
    assert [(r["a"], r["b"], r["severity"]) for r in pairs] == [("a", "b", "high")]
    clusters = dg.corr_clusters(dg.corr_table(df, ["a", "b", "c"]), 0.8).collect()
    assert any({"a", "b"} <= set(str(v) for v in r.asDict(recursive=True).values()) or "a" in str(r) and "b" in str(r) for r in clusters)
    vif = {r["feature"]: r["vif"] for r in dg.vif(dg.corr_table(df, ["a", "b", "c"])).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [vif["a"], vif["b"], vif["c"]] == pytest.approx(want.tolist(), rel=1e-3)


def test_arrow_batches_are_bounded_where_the_session_sets_no_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    was = {key: spark.conf.get(key) for key in BATCH if key in spark.conf.getAll}
    for key in BATCH:
        spark.conf.unset(key)
    try:
        ship(spark)
        wide = spark.range(30_000, numPartitions=2).selectExpr("repeat('x', 2000) as text").mapInArrow(sizes, "n long, b long").collect()
        assert sum(r["n"] for r in wide) == 30_000
        assert max(r["n"] for r in wide) <= 4000 and max(r["b"] for r in wide) < 10 << 20
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "123")
        ship(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "123"
    finally:
        for key in BATCH:
            spark.conf.unset(key)
            if key in was:
                spark.conf.set(key, was[key])


def test_membership_keeps_strangers_and_each_row_once(spark):
    prices = spark.createDataFrame([(t, pd.Timestamp(d).date(), i) for i, (t, d) in enumerate([("a", "2020-01-01"), ("a", "2020-02-01"), ("a", "2020-03-01"), ("b", "2020-02-01"), ("c", "2020-02-01"), (None, "2020-02-01")])], "ticker string, date date, i int")
    day = lambda d: pd.Timestamp(d).date()
    members = spark.createDataFrame([("a", day("2020-01-15"), day("2020-02-15")), ("a", day("2020-01-20"), None), ("c", day("2020-05-01"), None)], "ticker string, start_date date, end_date date")
    assert sorted(r["i"] for r in joins.pit_membership(prices, members).collect()) == [1, 2, 3, 5]


def test_trades_without_a_regime_and_lost_trades(spark):
    from sigloom.operators import backtest

    day = lambda d: pd.Timestamp(d).date()
    trades = spark.createDataFrame([(day("2020-01-01"), 0.1), (day("2020-01-01"), -1.0), (day("2020-01-02"), 0.5), (day("2020-01-02"), 0.5)], "date_in date, net_ret double")
    regimes = spark.createDataFrame([(day("2020-01-01"), "bull", "low")], "date date, trend string, vol string")
    got = {(r["trend"], r["vol"]): (r["trades"], round(r["compounded"], 9)) for r in backtest.regime_trade_metrics(trades, regimes).collect()}
    assert got == {("bull", None): (2, -1.0), (None, "low"): (2, -1.0), ("bull", "low"): (2, -1.0), ("unknown", None): (2, 1.25), (None, "unknown"): (2, 1.25), ("unknown", "unknown"): (2, 1.25)}
