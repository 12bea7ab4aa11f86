"""Scorecards, gates and alignment checks over the metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lead
from .metrics import ic, rank_ic, trade_stats


def trading_scorecard(rows: DataFrame, *keys: str, score: str = "proba", ret: str = "excess_fwd", size: str | None = None) -> DataFrame:
    """One row per keys: hit rate, profit factor and expected value of the trades, and how well the score orders returns."""
    held = rows.withColumn("_sized", F.col(score) * (F.col(size) if size else F.lit(1.0)))
    quality = held.groupBy(*keys).agg(ic(score, ret).alias("return_ic"), ic("_sized", ret).alias("contribution_ic"))
    ranks = rank_ic(rows, score, ret, *keys).drop("n")
    return reduce(lambda a, b: a.join(b, list(keys), "left"), [trade_stats(rows, ret, *keys), quality, ranks])


def decision_gate(card: DataFrame, expected_value: float = 0.001, profit_factor: float = 1.0, hit_rate: float = 0.55) -> DataFrame:
    """Adds the first bound that a scorecard misses, or "pass"; a missing profit factor has no loss behind it."""
    reason = (
        F.when(F.col("expected_value") < expected_value, "expected_value")
        .when(F.col("profit_factor") < profit_factor, "profit_factor")
        .when(F.col("hit_rate") < hit_rate, "hit_rate")
        .otherwise("pass")
    )
    return card.withColumn("decision", reason)


def target_gap(table: DataFrame, column: str = "ic", target: float = 0.08) -> DataFrame:
    """Adds the band of a coefficient, its distance from the target and that as a share of what there is."""
    x = F.col(column)
    band = F.when(x < 0.02, "noise").when(x < 0.05, "marginal").when(x < target, "viable").otherwise("strong")
    return table.withColumns({"band": F.when(x.isNotNull(), band), "gap": F.lit(target) - x, "needed": F.try_divide(F.lit(target) - x, x)})


def pred_truth_join(scores: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Rows that have both a score and a truth; of the scores, only the columns that the truth lacks."""
    keys = keys or ("date", "ticker")
    return truth.join(scores.select(*keys, *[c for c in scores.columns if c not in truth.columns]), list(keys))


def fwd_alignment_join(stored: DataFrame, prices: DataFrame, horizon: int = 10, column: str = "fwd_ret") -> DataFrame:
    """Each stored forward return beside the one that the prices give now, and their distance."""
    again = prices.select("date", "ticker", (F.try_divide(lead("close", horizon), F.col("close")) - 1).alias("recomputed"))
    out = stored.select("date", "ticker", F.col(column).alias("stored")).join(again, ["date", "ticker"], "left")
    return out.withColumn("distance", F.abs(F.col("stored") - F.col("recomputed")))


READY = {"roc_auc": 0.55, "sharpe": 0.5, "max_drawdown": -0.25, "stress_pass_rate": 0.5, "health": 60.0}


def readiness_checks(auc: DataFrame, summary: DataFrame, stress: DataFrame, drift: DataFrame, daily_ic: DataFrame) -> DataFrame:
    """One row per check (name, value, bound, passed), and the verdict on all of them.

    auc: roc_auc of the test rows; summary: sharpe and max_drawdown of the backtest; stress: passed per scenario; drift:
    health; daily_ic: ic per date. Each bound must be exceeded; a missing value counts 0. A Sharpe ratio above 3 with a
    mean IC below 0.03 points to leakage and fails the check `plausible`, whose value is that IC.
    """
    rate = stress.agg(F.avg(F.col("passed").cast("double")).alias("stress_pass_rate"))
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [auc.select("roc_auc"), summary.select("sharpe", "max_drawdown"), rate, drift.select("health"), daily_ic.agg(F.avg("ic").alias("mean_ic"))])  # one row each
    value = {name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in (*READY, "mean_ic")}
    checks = [F.struct(F.lit(name).alias("name"), value[name].alias("value"), F.lit(bound).alias("bound"), (value[name] > bound).alias("passed")) for name, bound in READY.items()]
    checks.append(F.struct(F.lit("plausible").alias("name"), value["mean_ic"].alias("value"), F.lit(0.03).alias("bound"), (~((value["sharpe"] > 3) & (value["mean_ic"] < 0.03))).alias("passed")))
    out = one.select(F.array(*checks).alias("_c")).withColumn("verdict", F.when(F.forall("_c", lambda c: c["passed"]), "approved").otherwise("not ready"))
    return out.select(F.explode("_c").alias("_r"), "verdict").select("_r.*", "verdict")
