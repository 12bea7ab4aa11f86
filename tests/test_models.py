"""Models per regime, baselines, ensembles, risk gates and the readiness verdict, on planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.operators import diagnostics, ml, reports

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark):
    """The label follows x in calm dates, -x in wild ones, and nothing in the few odd ones."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        day = (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date()
        regime = None if i % 40 == 7 else "odd" if i % 40 == 5 else "calm" if i % 2 else "wild"
        for t in range(12):
            x, y = rng.normal(size=2)
            side = {"calm": x, "wild": -x}.get(regime, y)
            split = None if i % 60 == 59 else "train" if i < 140 else "valid" if i < 190 else "test"
            rows.append((day, t, regime, split, float(x), float(y), int(side + rng.normal() * 0.2 > 0), float(side / 100)))
    return spark.createDataFrame(rows, "date date, ticker int, regime string, split string, x double, y double, label int, excess_fwd double").cache()


def auc(score, label):
    r = pd.Series(score).rank().to_numpy()
    p, n = (label == 1).sum(), (label == 0).sum()
    return (r[label == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_each_row_goes_to_the_model_of_its_regime(planted):
    models = ml.fit_by_regime(planted, FEATURES, kind="logistic")
    assert set(models) == {"overall", "calm", "wild"}  # odd has too few rows
    got = ml.score_by_regime(models, planted).toPandas()
    assert len(got) == planted.count() and not got.duplicated(["date", "ticker"]).any()
    assert (got["model"] == got["regime"].where(got["regime"].isin(["calm", "wild"]), "overall")).all()
    for name in ("calm", "wild"):
        part = got[got["model"] == name]
        assert auc(part["proba"], part["label"].to_numpy()) > 0.95
    alone = ml.score(models["wild"], planted.where("regime = 'wild'")).toPandas().set_index(["date", "ticker"])["proba"]
    np.testing.assert_allclose(got[got["model"] == "wild"].set_index(["date", "ticker"])["proba"].sort_index(), alone.sort_index())


def test_report_against_pandas(planted):
    folds = planted.sparkSession.createDataFrame([(k, *[pd.Timestamp(d).date() for d in days]) for k, days in enumerate([("2020-01-01", "2020-03-01", "2020-03-15", "2020-04-01"), ("2020-01-01", "2020-04-01", "2020-04-15", "2020-05-10")])], "fold int, train_start date, train_end date, test_start date, test_end date")
    got = {(r["model"], r["part"]): r for r in ml.train_report(planted, FEATURES, folds, kind="logistic").collect()}
    assert {m for m, _ in got} == {"overall", "calm", "wild", "purged_cv"} and {p for m, p in got if m == "purged_cv"} == {"fold_0", "fold_1"}
    train = planted.where("split = 'train'")
    for name, part in (("calm", "test"), ("overall", "valid")):
        mine = train if name == "overall" else train.where(F.col("regime") == name)
        rows = planted.where(F.col("split") == part)
        rows = ml.score(ml.fit(mine, FEATURES, kind="logistic"), rows if name == "overall" else rows.where(F.col("regime") == name)).toPandas()
        r = got[name, part]
        assert r["n"] == len(rows)
        np.testing.assert_allclose([r["roc_auc"], r["ic"]], [auc(rows["proba"], rows["label"].to_numpy()), np.corrcoef(rows["proba"], rows["excess_fwd"])[0, 1]], atol=1e-9)
    assert got["calm", "test"]["roc_auc"] > 0.95 > 0.7 > got["overall", "test"]["roc_auc"]
    assert got["overall", "all"]["n"] == planted.where("split is not null").count()


def test_signals_are_scored_by_regime_and_ranked(planted):
    regimes = planted.select("date", "regime").distinct()
    got = ml.score_signals(planted.drop("regime"), regimes, FEATURES, days=40, kind="logistic").toPandas()
    assert got["date"].nunique() == 40 and (got.groupby("date")["proba"].rank(ascending=False, method="first") == got["rank"]).all()
    calm = got[got["model"] == "calm"]
    assert np.corrcoef(calm["x"], calm["proba"])[0, 1] > 0.7 and "overall" in set(got["model"])


def test_linear_baseline_against_newton(planted):
    rows = planted.where("split = 'train' and regime = 'calm'")
    got = {r["feature"]: r["coefficient"] for r in ml.linear_baseline(rows, FEATURES, regParam=0.05, standardization=False).collect()}
    df = rows.toPandas()
    z = (df[FEATURES] - df[FEATURES].mean()) / df[FEATURES].std()
    a, b = np.column_stack([z, np.ones(len(z))]), np.zeros(3)
    penalty = np.diag([0.05, 0.05, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a.T * (p * (1 - p))) @ a / len(a) + penalty, a.T @ (p - df["label"]) / len(a) + penalty @ b)
    np.testing.assert_allclose([got["x"], got["y"], got["intercept"]], b, atol=1e-3)


def test_ensemble_members_differ_in_dates_features_and_configuration(planted):
    rows = [ml.member(planted, i, 3, FEATURES) for i in range(3)]
    left_out = [set(planted.select("date").distinct().toPandas()["date"]) - set(r.select("date").distinct().toPandas()["date"]) for r, _ in rows]
    assert [len(x) for x in left_out] == [80, 80, 80] and not left_out[0] & left_out[1] and max(left_out[0]) < min(left_out[1]) and [c for _, c in rows] == [["y"], ["x"], ["x", "y"]]
    got = ml.ensemble(planted, planted, FEATURES, 3).toPandas()
    mine = ml.score(ml.fit(rows[1][0], ["x"], kind="logistic"), planted).toPandas()
    both = got[got["model"] == "m1"].merge(mine, on=["date", "ticker"])
    np.testing.assert_allclose(both["proba_x"], both["proba_y"])
    assert got.groupby("model")["proba"].nunique().gt(1).all() and len(got) == 3 * len(mine)


def test_risk_gates(spark):
    good = {"drawdown_60d": -0.1, "market_stress": 1.0, "rolling_win_rate": 0.6, "risk_reward": 2.0, "ret_5d": 0.0, "market_breadth": 0.5}
    bad = {"drawdown_60d": -0.15, "market_stress": 2.0, "rolling_win_rate": 0.5, "risk_reward": 1.5, "ret_5d": -0.05, "market_breadth": 0.3}  # each at its bound
    rows = [good] + [good | {k: v} for k, v in bad.items()] + [good | {"rolling_win_rate": None}, good | {"drawdown_60d": None}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} double" for k in good))
    got = {r["i"]: list(r["blocked_by"]) for r in ml.meta_risk_gates(df).collect()}
    assert got == {0: [], **{i + 1: [g] for i, g in enumerate(ml.RISK_GATES)}, 7: ["win_rate"], 8: []}
    assert [r["i"] for r in ml.meta_risk_filter(df, {"win_rate": 0.4}).collect()] == [0, 3, 8]
    assert ml.meta_risk_filter(df.select("i")).count() == len(rows)


def test_readiness(spark):
    def verdict(roc_auc=0.6, sharpe=1.0, drawdown=-0.1, passed=(True, True, False), health=80, ics=(0.05, 0.05)):
        one = lambda row, schema: spark.createDataFrame([row], schema)
        out = reports.readiness_checks(
            one((roc_auc,), "roc_auc double"), one((sharpe, drawdown), "sharpe double, max_drawdown double"), spark.createDataFrame([(p,) for p in passed], "passed boolean"),
            one((health,), "health int"), spark.createDataFrame([(x,) for x in ics], "ic double"),
        ).collect()
        return {r["verdict"] for r in out}, {r["name"] for r in out if not r["passed"]}

    assert verdict() == ({"approved"}, set())
    assert verdict(roc_auc=0.55, health=60) == ({"not ready"}, {"roc_auc", "health"})
    assert verdict(roc_auc=None, passed=(), drawdown=-0.25) == ({"not ready"}, {"roc_auc", "stress_pass_rate", "max_drawdown"})
    assert verdict(sharpe=3.5, ics=(0.01, 0.02)) == ({"not ready"}, {"plausible"}) and verdict(sharpe=3.5)[0] == {"approved"}


def test_rank_correlations_against_pandas(planted):
    df = planted.withColumn("z", F.when(F.col("ticker") > 1, F.round(F.col("x") + F.col("y"), 0))).withColumn("one", F.lit(1.0))
    names = ["x", "y", "z", "one"]
    got = {(r["a"], r["b"]): r["r"] for r in diagnostics.rank_corr_table(df, names).collect()}
    want = df.select(*names).toPandas().dropna().corr(method="spearman")
    assert all(got[a, b] is None if "one" in (a, b) else abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in got) and len(got) == 6
